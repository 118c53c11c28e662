"""Gaussian naive Bayes with variance smoothing, from one aggregation of moments."""

from __future__ import annotations

import math

from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import LABEL
from repeatbuy.operators.prepare import FEATURES
from repeatbuy.operators.saving import SavedModel


class GaussianBayesModel(SavedModel):
    """Classes with their rows, and per feature mean and smoothed variance."""

    def __init__(self, classes: list[dict]):
        super().__init__()
        self.classes = classes

    def facts(self) -> dict:
        return {"classes": self.classes}

    @classmethod
    def rebuilt(cls, facts, parts, spark, table):
        return cls(facts["classes"])

    def _transform(self, rows: DataFrame) -> DataFrame:
        """Probabilities of the classes from the joint log-likelihood, all in one expression."""
        total = sum(c["rows"] for c in self.classes)
        x = vector_to_array(FEATURES)
        logs = []
        for c in self.classes:
            constant = math.log(c["rows"] / total) - 0.5 * sum(math.log(2 * math.pi * v) for v in c["variance"])
            known = F.array(*[
                F.struct(F.lit(m).alias("m"), F.lit(v).alias("v")) for m, v in zip(c["mean"], c["variance"], strict=True)
            ])
            far = F.zip_with(x, known, lambda a, k: (a - k["m"]) * (a - k["m"]) / k["v"])
            logs.append(F.lit(constant) - 0.5 * F.aggregate(far, F.lit(0.0), lambda s, d: s + d))
        scored = rows.withColumn("_logs", F.array(*logs))
        top = F.array_max("_logs")
        weights = F.transform("_logs", lambda v: F.exp(v - top))
        scored = scored.withColumn("_weights", weights)
        sums = F.aggregate("_weights", F.lit(0.0), lambda s, v: s + v)
        scored = scored.withColumn("_shares", F.transform("_weights", lambda v: v / sums))
        best = F.array_position("_shares", F.array_max("_shares")).cast("int")
        names = F.array(*[F.lit(float(c["label"])) for c in self.classes])
        return (
            scored.withColumn("probability", array_to_vector("_shares"))
            .withColumn("prediction", F.element_at(names, best))
            .drop("_logs", "_weights", "_shares")
        )


class GaussianBayes(Estimator):
    """Estimator: variances are those of the population, plus ``smoothing`` times the greatest
    variance of a feature over all rows."""

    def __init__(self, smoothing: float = 1e-9):
        super().__init__()
        self.smoothing = smoothing

    def copy(self, extra=None):
        return GaussianBayes(self.smoothing)

    def _fit(self, train: DataFrame) -> GaussianBayesModel:
        x = vector_to_array(FEATURES)
        n = train.select(F.size(x)).first()
        features = range(n[0] if n else 0)
        moments = [f(x[i]).alias(f"{name}{i}") for i in features for name, f in (("m", F.avg), ("v", F.var_pop))]
        found = train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("rows"), *moments).orderBy(LABEL).collect()
        total = sum(r["rows"] for r in found)
        spread = []
        for i in features:
            mean = sum(r["rows"] * r[f"m{i}"] for r in found) / total
            spread.append(sum(r["rows"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in found) / total)
        extra = self.smoothing * max(spread, default=0.0)
        return GaussianBayesModel([
            {
                "label": float(r[LABEL]),
                "rows": r["rows"],
                "mean": [r[f"m{i}"] for i in features],
                # Without any variance a class still needs a width.
                "variance": [(r[f"v{i}"] + extra) or 1e-300 for i in features],
            }
            for r in found
        ])
