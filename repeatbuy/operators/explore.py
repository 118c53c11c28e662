"""The aggregates behind the exploratory figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.expr import ratio
from repeatbuy.functions.fixed import WEEKDAYS
from repeatbuy.functions.skew import Sizes, attach, ordered
from repeatbuy.operators.clean import basket_count, parent_name
from repeatbuy.plans.staging import stage


def class_tree(classes: DataFrame) -> DataFrame:
    return parent_name(classes).select("class_name", "parent_name")


def _per_class(classes: DataFrame, rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("classid").agg(F.count("*").alias("counts"))
    return parent_name(classes).join(counts, "classid", "left").select(
        "class_name", "parent_name", F.coalesce("counts", F.lit(0)).alias("counts")
    )


def items_per_class(classes: DataFrame, items: DataFrame) -> DataFrame:
    return _per_class(classes, items)


def lines_per_class(classes: DataFrame, lines: DataFrame) -> DataFrame:
    return _per_class(classes, lines)


def _with_share(counts: DataFrame, n: str, name: str) -> DataFrame:
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(name, ratio(F.col(n), total))


def segment_share(lines: DataFrame) -> DataFrame:
    """Customers per segment; a customer counts under the greatest of their labels."""
    per_customer = lines.groupBy("cid").agg(F.max("segmentationlabel").alias("segmentationlabel"))
    counts = per_customer.groupBy("segmentationlabel").agg(F.count("*").alias("customers"))
    return _with_share(counts, "customers", "share")


def weekday_share(lines: DataFrame) -> DataFrame:
    day = F.weekday("checkoutdate")
    counts = lines.groupBy(day.alias("day_of_week")).agg(F.count("*").alias("counts"))
    names = F.create_map(*[F.lit(v) for p in enumerate(WEEKDAYS) for v in p])
    named = counts.withColumn("day_name", names[F.col("day_of_week")])
    return _with_share(named, "counts", "share")


def _capped(value: Column, top: int) -> Column:
    """Whole number as text, everything above ``top`` pooled."""
    return F.when(value > top, f"{top}<").otherwise(F.floor(value).cast("string"))


def quantity_histogram(lines: DataFrame, top: int = 10) -> DataFrame:
    bucket = _capped(F.col("quantity"), top).alias("quantity")
    counts = lines.groupBy(bucket).agg(F.count("*").alias("counts"))
    return _with_share(counts, "counts", "share")


def lines_per_day(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.to_date("checkoutdate").alias("date")).agg(
        F.count("*").alias("orders_count")
    )


def cart_size_histogram(lines: DataFrame, top: int = 30) -> DataFrame:
    """Customers per mean basket size."""
    sizes = lines.groupBy("cid", "bid").agg(F.count("*").alias("n")).groupBy("cid").agg(
        F.avg("n").alias("n")
    )
    counts = sizes.groupBy(_capped(F.col("n"), top).alias("cart_size")).agg(
        F.count("*").alias("counts")
    )
    return _with_share(counts, "counts", "share")


def equal_bins(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Count per bin of ``bins`` equal bins between the smallest and the largest value."""
    lo = values.agg(F.min(column).cast("double")).scalar()
    hi = values.agg(F.max(column).cast("double")).scalar()
    place = F.floor(F.try_divide(F.col(column) - lo, hi - lo) * bins)
    bin_ = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    return values.groupBy(bin_.alias("bin")).agg(F.count("*").alias("counts"))


def unit_price_histogram(lines: DataFrame, bins: int = 159) -> DataFrame:
    prices = lines.select(ratio("price", "quantity").alias("unit_price"))
    return equal_bins(prices, "unit_price", bins)


def basket_gap_histogram(timeline: DataFrame, bins: int = 121) -> DataFrame:
    gaps = timeline.select("days_since_prior_order").dropna()
    return equal_bins(gaps, "days_since_prior_order", bins)


def variety_in_repeat_categories(lines: DataFrame, more_than: int = 10) -> DataFrame:
    """Distinct items of (customer, category) pairs with many lines, and their mean."""
    pairs = (
        lines.groupBy("cid", "catid", "iid")
        .agg(F.count("*").alias("n"))
        .groupBy("cid", "catid")
        .agg(F.sum("n").alias("n"), F.count("*").alias("items"))
        .filter(F.col("n") > more_than)
        .select("cid", "catid", "items")
    )
    return pairs.withColumn("mean_items", pairs.agg(F.avg("items")).scalar())


def customer_scatter(
    lines: DataFrame, timeline: DataFrame, segments: Sequence[str]
) -> DataFrame:
    """Mean gap, baskets and segment per customer, for the given segments."""
    gaps = (
        timeline.filter(F.col("days_since_prior_order").isNotNull())
        .groupBy("cid")
        .agg(F.avg("days_since_prior_order").alias("days_between_orders"))
    )
    labels = lines.groupBy("cid").agg(F.max("segmentationlabel").alias("segmentationlabel"))
    return (
        gaps.join(basket_count(lines), "cid")
        .join(labels, "cid")
        .filter(F.col("segmentationlabel").isin(list(segments)))
    )


def quartiles(rows: DataFrame, key: str, value: str, pieces: int = 200) -> DataFrame:
    """Exact quartiles per key by linear interpolation, without holding a key in one task.

    Values are counted per (key, value), then numbered in chunks cut at approximate quantiles.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    cut = QuantileDiscretizer(
        numBuckets=pieces, inputCol=value, outputCol="_piece", relativeError=0.2 / pieces
    ).fit(counts)
    placed = ordered(
        cut.transform(counts), [key], F.col("_piece"), [value],
        running={"_upto": F.col("_n")}, total={"_all": F.col("_n")},
    )

    def at(position: Column) -> Column:
        here = (F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto"))
        return F.max(F.when(here, F.col(value)))

    picks = []
    for i, q in enumerate((0.25, 0.5, 0.75), 1):
        h = (F.col("_all") - 1) * F.lit(q)
        picks += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"),
                  F.max(h - F.floor(h)).alias(f"_w{i}")]
    out = placed.groupBy(key).agg(*picks, F.max("_all").alias("n"))
    return out.select(key, "n", *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"q{i}")
        for i in (1, 2, 3)
    ])


def cart_cost_by_segment(lines: DataFrame) -> DataFrame:
    """Box-plot numbers of the customers' mean basket cost, per segment."""
    spend = lines.groupBy("cid").agg(
        F.round(F.sum("price"), 2).alias("_spend"),
        F.max("segmentationlabel").alias("segmentationlabel"),
    )
    cost = stage(
        spend.join(basket_count(lines), "cid").select(
            "segmentationlabel", ratio("_spend", "baskets").alias("cost")
        ),
        "cost",
    )
    boxes = quartiles(cost, "segmentationlabel", "cost")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    # An unknown segment is one of its own: filled values and a flag stand for it in the join.
    named = {
        "_segment": F.coalesce("segmentationlabel", F.lit("")),
        "_known": F.col("segmentationlabel").isNotNull(),
    }
    rows = cost.withColumns(named)
    boxes = boxes.withColumns(named).drop("segmentationlabel")
    inside = attach(rows, boxes, list(named), sizes=Sizes(rows, staged=True)).filter(
        F.col("cost").between(F.col("q1") - reach, F.col("q3") + reach)
    )
    return inside.groupBy("segmentationlabel").agg(
        F.max("n").alias("customers"),
        *[F.max(q).alias(q) for q in ("q1", "q2", "q3")],
        F.min("cost").alias("whisker_low"), F.max("cost").alias("whisker_high"),
    )
