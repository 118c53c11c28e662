"""Preparing model tables: feature vectors, scaling, balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import LABEL
from repeatbuy.functions.skew import Sizes, attach, numbered
from repeatbuy.operators.neighbours import distinct_points, nearest_points
from repeatbuy.plans.staging import discard, stage

FEATURES = "features"


def select_features(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Key columns, label and one feature vector."""
    out = VectorAssembler(inputCols=list(columns), outputCol=FEATURES).transform(rows)
    return out.select(*keep, F.col(LABEL).cast("double").alias(LABEL), FEATURES)


def reduced_features(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep some of the assembled features, by name."""
    return (
        VectorSlicer(inputCol=FEATURES, outputCol="_kept", names=list(names))
        .transform(rows)
        .drop(FEATURES)
        .withColumnRenamed("_kept", FEATURES)
    )


class Scale:
    """(x − shift) ÷ width per column; the numbers come from one aggregate over train."""

    def __init__(self, shift: dict[str, float], width: dict[str, float]):
        self.shift, self.width = shift, width

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {c: (F.col(c) - self.shift[c]) / self.width[c] for c in self.shift}
        )


def standard_scale(train: DataFrame, columns: Sequence[str]) -> Scale:
    """Mean 0 and population deviation 1 on train; a constant column is only shifted."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return Scale({c: row[f"m_{c}"] or 0.0 for c in columns}, {c: row[f"s_{c}"] or 1.0 for c in columns})


def max_scale(train: DataFrame, columns: Sequence[str]) -> Scale:
    """Divide by the train maximum; a column whose maximum is 0 is left alone."""
    row = train.agg(*[F.max(c).alias(c) for c in columns]).first()
    return Scale({c: 0.0 for c in columns}, {c: float(row[c] or 0.0) or 1.0 for c in columns})


# --- neighbours ----------------------------------------------------------------------------


def _uniform(seed: int, *of: Column) -> Column:
    """Numbers in [0, 1) that depend on the given values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def smote(
    rows: DataFrame, columns: Sequence[str], key: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Balance the classes: add class-1 rows on the line between a class-1 row and one of its k
    nearest class-1 neighbours.

    All class-1 rows are each other's candidates, through an exact neighbour join of their distinct
    points; ties come in the order of the columns. Copies of a row are its neighbours. Every class-1
    row yields the same number of new rows, and the remainder goes to rows in hash order. A row
    without a place (an unknown feature) is repeated as it is. New rows carry NULL in ``key``; they are
    written, the others are read where they lie.
    """
    counts = rows.agg(
        F.count_if(F.col(LABEL) == 1).alias("ones"), F.count_if(F.col(LABEL) == 0).alias("zeros")
    ).first()
    ones, missing = counts["ones"], counts["zeros"] - counts["ones"]
    if ones < 2 or missing <= 0:
        return rows.select(key, *columns, LABEL)
    whole, rest = divmod(missing, ones)
    columns = list(columns)
    typed = [F.col(c).cast("double").alias(c) for c in columns]
    positive = rows.filter(F.col(LABEL) == 1)
    pool, spent = distinct_points(positive, columns, "point"), []

    # The k nearest of each point, a copy in a place of its own; the point itself counts once less.
    near = nearest_points(pool.withColumnRenamed("point", "ask"), pool, columns, k + 1, seed, spent)
    others = F.col("weight") - (F.col("ask") == F.col("point")).cast("int")
    near = near.join(pool.select("point", "weight"), "point").withColumn("others", F.least(others, F.lit(k)))
    listed = F.sort_array(F.collect_list(F.struct("rank", "point", "others")))
    places = F.flatten(F.transform(listed, lambda x: F.array_repeat(x["point"], x["others"].cast("int"))))
    near = near.groupBy("ask").agg(F.slice(places, 1, k).alias("others"))

    minority_rows = stage(numbered(positive.select(key, *typed), key, seed), "minority")
    extra = (F.col("_place") <= rest).cast("int")
    minority = minority_rows.withColumn("_times", F.lit(whole) + extra).filter("_times > 0").drop(key)
    sizes = Sizes(minority, staged=True)
    own = attach(minority, pool.select(*columns, F.col("point").alias("ask")), columns, "left", sizes)
    own = stage(own, "minority-points")
    sizes = Sizes(own, staged=True)
    listed = attach(own.filter("ask is not null").select("ask", "_place", "_times"), near, ["ask"], "left", sizes)
    copies = listed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    pick = (_uniform(seed, F.col("_place"), F.col("copy"), F.lit(0)) * F.size("others")).cast("int") + 1
    picked = copies.select(
        "ask",
        F.when(F.size("others") > 0, F.element_at("others", pick)).otherwise(F.col("ask")).alias("point"),
        _uniform(seed, F.col("_place"), F.col("copy"), F.lit(1)).alias("step"),
    )
    picked = stage(picked, "picked")
    sizes = Sizes(picked, staged=True)
    start = pool.select(F.col("point").alias("ask"), F.struct(*columns).alias("from"))
    end = pool.select("point", F.struct(*columns).alias("to"))
    moved = attach(attach(picked, start, ["ask"], sizes=sizes), end, ["point"], sizes=sizes)
    new = moved.select(
        *[(F.col(f"from.`{c}`") + F.col("step") * (F.col(f"to.`{c}`") - F.col(f"from.`{c}`"))).alias(c) for c in columns]
    )
    again = own.filter("ask is null").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    moved = stage(new.unionByName(again.select(*columns)), "made")
    for table in (pool, minority_rows, own, picked, *spent):
        discard(table)
    original = rows.select(key, *typed, LABEL)
    key_type = dict(original.dtypes)[key]
    made = moved.select(
        F.lit(None).cast(key_type).alias(key), *columns, F.lit(1).cast(dict(rows.dtypes)[LABEL]).alias(LABEL)
    )
    return original.unionByName(made)


def _share(near: Column, n: Column) -> Column:
    """Share of class 1 among the ``n`` nearest rows; ``near`` lists rank, weight and ones by point.
    A point's rows vote with their mean where not all of them are among the ``n``."""
    zero = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("taken"), F.lit(0.0).alias("ones"))

    def step(state, point):
        take = F.least(point["weight"].cast("double"), state["left"])
        return F.struct(
            (state["left"] - take).alias("left"),
            (state["taken"] + take).alias("taken"),
            (state["ones"] + take * point["ones"] / point["weight"]).alias("ones"),
        )

    start = zero.withField("left", n.cast("double"))
    return F.aggregate(near, start, step, lambda s: F.when(s["taken"] > 0, s["ones"] / s["taken"]))


def knn_votes(
    train: DataFrame, test: DataFrame, columns: Sequence[str], key: str, k: int = 10,
    seed: int = 42, up_to: int | None = None,
) -> DataFrame:
    """Class-1 votes among the k nearest train rows of every test row.

    All distinct points of ``train`` are candidates, through an exact neighbour join. Train rows at
    one point vote with their mean; points at the same distance come in the order of their columns.
    Without train rows, or without a place (an unknown feature), a test row's probability and class
    are NULL. With ``up_to`` the result has a row per number of neighbours 1 … up_to.
    """
    columns = list(columns)
    pool = distinct_points(train, columns, "point", ones=(F.col(LABEL) == 1).cast("long"))
    asked = distinct_points(test, columns, "ask")
    near = nearest_points(asked, pool, columns, k if up_to is None else up_to, seed)
    near = near.join(pool.select("point", "weight", "ones"), "point")
    near = near.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("rank", "weight", "ones"))).alias("_near"))
    near = asked.select("ask", *columns).join(near, "ask", "left").drop("ask")
    rows = stage(
        test.select(
            F.col(key).cast("string").alias(key), *[F.col(c).cast("double").alias(c) for c in columns],
            F.col(LABEL).cast("int").alias("y_test"),
        ),
        "asked-rows",
    )
    voted = attach(rows, near, columns, "left", Sizes(rows, staged=True))
    sizes = [k] if up_to is None else list(range(1, up_to + 1))
    voted = voted.withColumn("neighbours", F.explode(F.array(*map(F.lit, sizes))))
    voted = voted.withColumn("y_test_prob", _share(F.col("_near"), F.col("neighbours")))
    return voted.select(
        key, "neighbours", "y_test", "y_test_prob", (F.col("y_test_prob") > 0.5).cast("int").alias("y_test_prediction")
    )


def knn_error_curve(votes: DataFrame) -> DataFrame:
    """Error rate per number of neighbours."""
    wrong = (F.col("y_test") != F.col("y_test_prediction")).cast("double")
    return votes.groupBy("neighbours").agg(F.avg(wrong).alias("error_rate"))
