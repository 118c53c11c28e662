"""Cleaning, filters and audits of the order lines and the class hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import LOYAL_LABELS, NO_LABEL, REQUIRED, ROLLUP_KEYS
from repeatbuy.functions.skew import Sizes, attach
from repeatbuy.plans.staging import stage

FEW = 10_000  # rows of a key list that may be broadcast


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def null_counts(df: DataFrame) -> DataFrame:
    """One row: NULLs per column, counted in a single pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def equality_lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def drop_missing(lines: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    return lines.dropna(subset=list(required))


def range_filter(lines: DataFrame, min_price: float = 300, min_quantity: float = 0) -> DataFrame:
    return lines.filter((F.col("price") > min_price) & (F.col("quantity") > min_quantity))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def fill_label(lines: DataFrame, value: str = NO_LABEL) -> DataFrame:
    return lines.fillna(value, subset=["segmentationlabel"])


def patch_hierarchy(classes: DataFrame, parents: Mapping[object, object]) -> DataFrame:
    """Overwrite the parent of the listed classes; the patch is a literal map."""
    if not parents:
        return classes
    patch = F.create_map(*[F.lit(v) for pair in parents.items() for v in pair])
    return classes.withColumn(
        "primaryparentid", F.coalesce(patch[F.col("classid")], F.col("primaryparentid"))
    )


def parent_name(classes: DataFrame) -> DataFrame:
    """Name of every class's parent; NULL for the root or an unknown parent."""
    parent = classes.select(
        F.col("classid").alias("primaryparentid"), F.col("class_name").alias("parent_name")
    )
    parent = parent.groupBy("primaryparentid").agg(F.min("parent_name").alias("parent_name"))
    return classes.join(parent, "primaryparentid", "left").select(
        *classes.columns, "parent_name"
    )


def basket_count(lines: DataFrame) -> DataFrame:
    return lines.groupBy("cid").agg(F.count_distinct("bid").alias("baskets"))


def min_orders(lines: DataFrame, n: int = 2, sizes: Sizes | None = None) -> DataFrame:
    """Keep the lines of customers with more than ``n`` baskets."""
    enough = basket_count(lines).filter(F.col("baskets") > n).select("cid")
    return attach(lines, enough, ["cid"], "left_semi", sizes)


def volume_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Baskets before and after a filter, customers and lines left."""
    stages = [("before", before), ("after", after)]
    rows = [
        df.agg(
            F.lit(name).alias("stage"),
            F.count_distinct("cid", "bid").alias("baskets"),
            F.count_distinct("cid").alias("customers"),
            F.count("*").alias("lines"),
        )
        for name, df in stages
    ]
    return rows[0].unionByName(rows[1])


def class_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("classid").agg(F.count("*").alias("rep"))


def rare_class_report(lines: DataFrame, classes: DataFrame, below: int = 100) -> DataFrame:
    """Classes with few lines, with their name and their parent's count."""
    counts = class_counts(lines)
    parent = counts.select(
        F.col("classid").alias("primaryparentid"), F.col("rep").alias("parent_rep")
    )
    return (
        counts.filter(F.col("rep") < below)
        .join(classes, "classid")
        .join(parent, "primaryparentid", "left")
        .select("classid", "rep", "class_name", "primaryparentid", "parent_rep")
    )


def drop_rare_classes(
    lines: DataFrame, below: int = 25, sizes: Sizes | None = None
) -> DataFrame:
    """Drop the lines of classes that have fewer than ``below`` lines."""
    rare = class_counts(lines).filter(F.col("rep") < below).select("classid")
    if sizes is not None and sizes.staged:
        rare = stage(rare, "rare")
        if rare.count() <= FEW:
            return lines.join(F.broadcast(rare), "classid", "left_anti")  # no shuffle of the lines
    return attach(lines, rare, ["classid"], "left_anti", sizes)


def parse_timestamp(df: DataFrame, column: str = "checkoutdate") -> DataFrame:
    """Text with microseconds to a timestamp without time zone."""
    pattern = F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.withColumn(column, F.to_timestamp_ntz(F.col(column), pattern))


def category_rollup(lines: DataFrame) -> DataFrame:
    """Item lines to category lines: price and quantity summed, money to the cent."""
    return lines.groupBy(*ROLLUP_KEYS).agg(
        F.round(F.sum("price"), 2).alias("price"), F.sum("quantity").alias("quantity")
    )


def loyal_cohort(lines: DataFrame, labels: Sequence[str] = LOYAL_LABELS) -> DataFrame:
    """Customers with any line carrying one of the labels."""
    return lines.filter(F.col("segmentationlabel").isin(list(labels))).select("cid").distinct()


def keep_cohort(
    rows: DataFrame, cohort: DataFrame, sizes: Sizes | None = None
) -> DataFrame:
    return attach(rows, cohort.select("cid").distinct(), ["cid"], "left_semi", sizes)


def gap_cutoff(rows: DataFrame, otli: int) -> DataFrame:
    return rows.filter(F.col("days_since_prior_order") <= otli)


def zero_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c) == 0).alias(c) for c in columns])


def inf_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    inf = float("inf")
    return df.agg(*[F.count_if(F.col(c).cast("double").isin(inf, -inf)).alias(c) for c in columns])


def row_audit(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every named intermediate."""
    counts = [
        df.agg(F.lit(name).alias("stage"), F.count("*").alias("rows"))
        for name, df in stages.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
