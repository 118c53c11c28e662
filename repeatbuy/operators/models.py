"""Classifiers on assembled feature vectors, ensembles, search and importance.

Every ``fit_*`` takes a frame from ``prepare.select_features`` and returns something with
``transform`` that ``score`` understands.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import LABEL
from repeatbuy.operators.extra_trees import fit_extra_trees  # noqa: F401
from repeatbuy.operators.naive_bayes import GaussianBayes
from repeatbuy.operators.prepare import FEATURES
from repeatbuy.operators.saving import SavedModel
from repeatbuy.plans.staging import stage

COLUMNS = {"featuresCol": FEATURES, "labelCol": LABEL}
SEED = 42


def logistic_regression(**params) -> LogisticRegression:
    return LogisticRegression(**COLUMNS, **params)


def gaussian_nb(smoothing: float = 1e-9) -> GaussianBayes:
    return GaussianBayes(smoothing)


def decision_tree(**params) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(seed=SEED, **COLUMNS, **params)


def random_forest(**params) -> RandomForestClassifier:
    """Default forest; the tuned one has 200 trees with leaves of 10 rows."""
    return RandomForestClassifier(seed=SEED, **COLUMNS, **params)


def gradient_boosting(**params) -> GBTClassifier:
    return GBTClassifier(seed=SEED, **COLUMNS, **params)


def linear_svc(**params) -> LinearSVC:
    return LinearSVC(**COLUMNS, **params)


def mlp(n_features: int, hidden: Sequence[int] = (30, 20, 10, 20), **params):
    """Dense net; the other layout in use is hidden=(32, 16, 8)."""
    layers = [n_features, *hidden, 2]
    return MultilayerPerceptronClassifier(layers=layers, seed=SEED, **COLUMNS, **params)


def bagging(trees: int = 10, **params) -> RandomForestClassifier:
    """Bootstrapped trees that see every feature at every split."""
    return random_forest(
        numTrees=trees, featureSubsetStrategy="all", bootstrap=True, **params
    )


# --- scoring -------------------------------------------------------------------------------


def class1_probability(scored: DataFrame) -> Column:
    """Probability of class 1; a model that only has margins gets their logistic."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    margin = vector_to_array("rawPrediction")[1]
    return 1 / (1 + F.exp(-margin))


def score(model, rows: DataFrame, keys: Sequence[str] = ("cid",)) -> DataFrame:
    """Prediction frame: keys, truth, probability and default class of every row."""
    scored = model.transform(rows)
    return scored.select(
        *keys,
        F.col(LABEL).cast("int").alias("y_test"),
        class1_probability(scored).alias("y_test_prob"),
        F.col("prediction").cast("int").alias("y_test_prediction"),
    )


class Averaged(SavedModel):
    """Mean class-1 probability of several models, row by row in one pass."""

    _made = itertools.count()

    def __init__(self, models: Sequence):
        super().__init__()
        self.models = list(models)
        self.name = f"_mean{next(self._made)}"  # averages may be nested

    def parts(self) -> Sequence:
        return self.models

    @classmethod
    def rebuilt(cls, facts, parts, spark, table):
        return cls(parts)

    def _transform(self, rows: DataFrame) -> DataFrame:
        names = [f"{self.name}_{i}" for i in range(len(self.models))]
        out = rows
        for name, model in zip(names, self.models):
            scored = model.transform(out)
            added = [c for c in scored.columns if c not in out.columns]
            out = scored.withColumn(name, class1_probability(scored)).drop(*added)
        mean = sum((F.col(n) for n in names), start=F.lit(0.0)) / len(names)
        p = F.col(self.name)
        return (
            out.withColumn(self.name, mean)
            .withColumn("probability", array_to_vector(F.array(1 - p, p)))
            .withColumn("prediction", (p > 0.5).cast("double"))
            .drop(self.name, *names)
        )


def soft_voting(models: Sequence) -> Averaged:
    return Averaged(models)


# --- boosting by re-weighting --------------------------------------------------------------


class Boosted(SavedModel):
    """Weighted vote of stumps."""

    def __init__(self, stumps: Sequence[tuple[float, object]]):
        super().__init__()
        self.stumps = list(stumps)

    def parts(self) -> Sequence:
        return [stump for _, stump in self.stumps]

    def facts(self) -> dict:
        return {"weights": [weight for weight, _ in self.stumps]}

    @classmethod
    def rebuilt(cls, facts, parts, spark, table):
        return cls(list(zip(facts["weights"], parts, strict=True)))

    def _transform(self, rows: DataFrame) -> DataFrame:
        out = rows
        for i, (_, stump) in enumerate(self.stumps):
            scored = stump.transform(out)
            added = [c for c in scored.columns if c not in out.columns]
            out = scored.withColumn(f"_v{i}", 2 * F.col("prediction") - 1).drop(*added)
        total = sum(abs(a) for a, _ in self.stumps) or 1.0
        names = [f"_v{i}" for i in range(len(self.stumps))]
        vote = sum(
            (F.col(n) * a for n, (a, _) in zip(names, self.stumps)), start=F.lit(0.0)
        ) / total
        return (
            out.withColumn("_vote", vote)
            .withColumn(
                "probability",
                array_to_vector(
                    F.array(1 / (1 + F.exp(F.col("_vote"))), 1 / (1 + F.exp(-F.col("_vote"))))
                ),
            )
            .withColumn("prediction", (F.col("_vote") > 0).cast("double"))
            .drop("_vote", *names)
        )


def fit_ada_boost(
    train: DataFrame, rounds: int = 50, rate: float = 1.0, depth: int = 1, stage_every: int = 5
) -> Boosted:
    """SAMME with two classes: misses gain weight after every stump.

    The weights are a column; every few rounds they are written out so the plan stays short.
    """
    rows = train.withColumn("_w", F.lit(1.0))
    stumps = []
    for i in range(rounds):
        stump = decision_tree(maxDepth=depth, weightCol="_w").fit(rows)
        scored = stump.transform(rows)
        miss = (F.col("prediction") != F.col(LABEL)).cast("double")
        sums = scored.agg(
            F.sum(F.col("_w") * miss).alias("wrong"), F.sum("_w").alias("all")
        ).first()
        error = sums["wrong"] / sums["all"]
        if error >= 0.5:
            break
        weight = rate * math.log((1 - max(error, 1e-12)) / max(error, 1e-12))
        stumps.append((weight, stump))
        if error <= 0:
            break
        grown = F.col("_w") * F.exp(F.lit(weight) * miss) / F.lit(sums["all"]) * F.lit(1e6)
        rows = scored.withColumn("_w", grown).select(*train.columns, "_w")
        if (i + 1) % stage_every == 0:
            rows = stage(rows, "weights")
    return Boosted(stumps)


# --- stacking ------------------------------------------------------------------------------


class Stacked(SavedModel):
    """Base models' probabilities fed to a final model."""

    def __init__(self, bases: Sequence, final):
        super().__init__()
        self.bases, self.final = list(bases), final

    def parts(self) -> Sequence:
        return [*self.bases, self.final]

    @classmethod
    def rebuilt(cls, facts, parts, spark, table):
        return cls(parts[:-1], parts[-1])

    def _transform(self, rows: DataFrame) -> DataFrame:
        return self.final.transform(_base_scores(self.bases, rows)).drop("_bases")


def _base_scores(bases: Sequence, rows: DataFrame) -> DataFrame:
    out = rows
    for i, model in enumerate(bases):
        scored = model.transform(out)
        added = [c for c in scored.columns if c not in out.columns]
        out = scored.withColumn(f"_b{i}", class1_probability(scored)).drop(*added)
    names = [f"_b{i}" for i in range(len(bases))]
    return VectorAssembler(inputCols=names, outputCol="_bases").transform(out).drop(*names)


def fit_stacking(
    train: DataFrame, bases: Sequence, final=None, fold: str = "fold", folds: int = 3
) -> Stacked:
    """Bases are fitted on all folds but one and score that one; the final model learns from these
    out-of-fold probabilities. Bases refitted on all of train serve new rows."""
    parts = []
    for f in range(folds):
        rest, held = train.filter(F.col(fold) != f), train.filter(F.col(fold) == f)
        parts.append(_base_scores([b.fit(rest) for b in bases], held))
    meta = stage(
        reduce(DataFrame.unionByName, parts).select(LABEL, "_bases"), "stacking"
    )
    final = final or GBTClassifier(maxDepth=3, maxIter=10, seed=SEED)
    final = final.copy({final.featuresCol: "_bases", final.labelCol: LABEL})
    return Stacked([b.fit(train) for b in bases], final.fit(meta))


# --- search --------------------------------------------------------------------------------


def with_folds(rows: DataFrame, folds: int, cid: str = "cid") -> DataFrame:
    """Fold number by customer, so no customer sits on both sides of a fold."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(cid), F.lit(folds)).cast("int"))


def grid_search(
    train: DataFrame, estimator, grid: Mapping[str, Iterable], folds: int = 10,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Cross-validated search over a parameter grid; ``train`` has a ``fold`` column."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=builder.build(),
        evaluator=BinaryClassificationEvaluator(labelCol=LABEL, metricName="areaUnderPR"),
        numFolds=folds, foldCol="fold", parallelism=parallelism,
    ).fit(train)


# The tuning grids, in the library's parameter names. L1 / L2 penalties are
# elasticNetParam 1 / 0, regParam is the inverse of the penalty weight C; log loss is entropy. Without
# counterpart: solvers, boosting by class probabilities (SAMME.R), and a depth of 60, as Spark ML's
# trees end at 30.
GRIDS = {
    "logistic": {"regParam": [10.0, 1.0], "elasticNetParam": [0.0, 1.0], "maxIter": [200]},
    "gnb": {"smoothing": [1e-9, 1e-10, 1e-8, 1e-11]},
    "forest": {
        "numTrees": [10, 50, 200], "impurity": ["gini", "entropy"], "maxDepth": [30],
        "minWeightFractionPerNode": [0.0, 0.2, 0.5],
    },
    "extra": {
        "trees": [10, 50, 200], "criterion": ["gini", "entropy"], "depth": [30],
        "min_share": [0.0, 0.2, 0.5],
    },
    "ada": {"rounds": [10, 50, 100, 200], "rate": [0.1, 1.0, 10.0]},
    "boosted": {"stepSize": [0.1], "maxDepth": [3, 5], "maxIter": [100]},
}


def search_fits(
    train: DataFrame, fit: Callable[..., object], grid: Mapping[str, Iterable], folds: int = 10,
) -> DataFrame:
    """Grid search for models that are fitted by a function rather than an estimator.

    ``fit(rows, **params)`` is tried on every fold; the metric is the area under the
    precision-recall curve, as in ``grid_search``.
    """
    judge = BinaryClassificationEvaluator(
        labelCol=LABEL, rawPredictionCol="probability", metricName="areaUnderPR"
    )
    rows = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values))
        metrics = []
        for f in range(folds):
            model = fit(train.filter(F.col("fold") != f), **params)
            metrics.append(judge.evaluate(model.transform(train.filter(F.col("fold") == f))))
        text = ", ".join(sorted(f"{k}={v}" for k, v in params.items()))
        rows.append((text, float(np.mean(metrics)), float(np.std(metrics))))
    return _local(rows, "params string, metric double, metric_std double")


def grid_results(found: CrossValidatorModel) -> DataFrame:
    """Mean and deviation of the metric per parameter combination."""
    rows = []
    for i, params in enumerate(found.getEstimatorParamMaps()):
        text = ", ".join(sorted(f"{p.name}={v}" for p, v in params.items()))
        std = found.stdMetrics[i] if found.stdMetrics else None
        rows.append((text, float(found.avgMetrics[i]), None if std is None else float(std)))
    return _local(rows, "params string, metric double, metric_std double")


def cv_accuracy(train: DataFrame, estimator, folds: int = 5) -> DataFrame:
    """Mean accuracy over the folds and twice its deviation."""
    found = CrossValidator(
        estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy"),
        numFolds=folds, foldCol="fold", parallelism=2,
    ).fit(train)
    rows = [(float(found.avgMetrics[0]), 2 * float(found.stdMetrics[0]))]
    return _local(rows, "accuracy double, spread double")


def _local(rows, schema: str) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame(rows, schema)


# --- importance and batches ----------------------------------------------------------------


def model_importance(model, columns: Sequence[str]) -> DataFrame:
    """Coefficients of a linear model or impurity importances of trees, by name."""
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    return _local(
        [(c, float(v)) for c, v in zip(columns, values.toArray())],
        "feature string, importance double",
    )


def pick_reduced(importance: DataFrame, n: int) -> list[str]:
    """Names of the n most important features."""
    return [r["feature"] for r in importance.orderBy(F.desc("importance"), "feature").take(n)]


def train_runs(
    runs: Mapping[str, DataFrame], fit: Callable[[DataFrame], object],
    measure: Callable[[object, str], DataFrame],
) -> DataFrame:
    """Fit one kind of model on many prepared runs and stack their measures."""
    out = [
        measure(fit(train), run).withColumn("run", F.lit(run)) for run, train in runs.items()
    ]
    return reduce(DataFrame.unionByName, out)


def save_model(model, path: str) -> None:
    """Any model here, ensembles with their parts; its class's ``load`` reads it back."""
    model.write().overwrite().save(path)
