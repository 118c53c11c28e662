"""Long gaps between baskets and k-sigma limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.expr import ratio
from repeatbuy.functions.skew import Sizes, attach
from repeatbuy.operators.timeline import group_stats


def long_gaps(timeline: DataFrame, otli: int) -> DataFrame:
    """Baskets followed by more than ``otli`` days without one."""
    return timeline.filter(F.col("days_until_next") > otli)


def gap_summary(timeline: DataFrame, otli: int) -> DataFrame:
    """Per customer with long gaps: how many, in how many orders, and the first two baskets' ids."""

    def at(n):
        return F.max(F.when(F.col("order_number") == n, F.col("bid")))

    return long_gaps(timeline, otli).groupBy("cid").agg(
        F.count("*").alias("gaps"),
        F.max("total_orders").alias("total_orders"),
        F.max("order_number").alias("last_gap"),
        at(1).alias("first_bid"),
        at(2).alias("second_bid"),
    )


def gap_ratio_customers(gaps: DataFrame) -> DataFrame:
    """Customers to drop: three or more long gaps that make up over a tenth of their orders."""
    many = (F.col("gaps") >= 3) & (ratio("gaps", "total_orders") > 0.1)
    return gaps.filter(many).select("cid")


def single_gap_rule(gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(customers, baskets) to drop for customers with exactly one long gap."""
    one = gaps.filter(F.col("gaps") == 1)
    few = ((F.col("total_orders") < 6) & (F.col("last_gap") >= 2)) | (F.col("total_orders") < 4)
    baskets = one.filter(F.col("first_bid").isNotNull())
    return one.filter(few).select("cid"), baskets.select("cid", F.col("first_bid").alias("bid"))


def double_gap_rule(gaps: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(customers, baskets) to drop for customers with exactly two long gaps.

    ``strict`` spares customers whose two gaps are their first two orders.
    """
    two = gaps.filter(F.col("gaps") == 2)
    early = F.col("last_gap") <= 2
    orders = F.col("total_orders")
    few = ((orders < 9) & ~early) | (orders < 7) if strict else orders < 9
    baskets = two.filter(early).select(
        "cid", F.explode(F.array("first_bid", "second_bid")).alias("bid")
    )
    return two.filter(few).select("cid"), baskets


def gap_verdict(timeline: DataFrame, otli: int, strict: bool = False):
    """(customers, baskets) all gap rules drop; each customer falls under one rule."""
    gaps = gap_summary(timeline, otli)
    one_cid, one_bid = single_gap_rule(gaps)
    two_cid, two_bid = double_gap_rule(gaps, strict)
    return gap_ratio_customers(gaps).union(one_cid).union(two_cid), one_bid.union(two_bid)


def remove_gap_outliers(
    lines: DataFrame, timeline: DataFrame, otli: int, strict: bool = False,
    sizes: Sizes | None = None,
) -> DataFrame:
    """Lines without the dropped customers and baskets."""
    customers, baskets = gap_verdict(timeline, otli, strict)
    sizes = sizes or Sizes(lines)
    kept = attach(lines, customers, ["cid"], "left_anti", sizes)
    return attach(kept, baskets, ["cid", "bid"], "left_anti", sizes)


def ksigma_filter(
    rows: DataFrame, keys: list[str], value: str, k: float, keep_undefined_std: bool = False,
    sizes: Sizes | None = None,
) -> DataFrame:
    """Rows up to mean + k sample deviations of their group.

    A group of one row is kept whatever its value. In larger groups an unknown value is dropped,
    and so is a value whose deviation is undefined because it is the only known one;
    ``keep_undefined_std`` keeps the latter.
    """
    limit = F.col("group_mean") + F.lit(k) * F.col("group_std")
    keep = (F.col("group_rows") == 1) | (F.col(value) <= limit)
    if keep_undefined_std:
        keep = keep | (F.col("group_std").isNull() & F.col(value).isNotNull())
    return group_stats(rows, keys, value, sizes).filter(keep).select(*rows.columns)


def gap_probe(
    timeline: DataFrame, otli: int = 60, least: int = 3, sizes: Sizes | None = None
) -> DataFrame:
    """Long gaps of customers with at least ``least`` of them, next to their mean and deviation."""
    gap = F.col("days_since_prior_order")
    stats = (
        timeline.groupBy("cid")
        .agg(
            F.avg(gap).alias("gap_avg"),
            F.stddev_samp(gap).alias("gap_std"),
            F.count_if(gap > otli).alias("long_gaps"),
        )
        .filter(F.col("long_gaps") >= least)
    )
    return attach(timeline.filter(gap > otli), stats, ["cid"], sizes=sizes).select(
        "cid", "bid", "order_number", "total_orders", "long_gaps", "days_since_prior_order",
        "gap_avg", "gap_std", (gap - F.col("gap_avg")).alias("gap_minus_avg"),
    )
