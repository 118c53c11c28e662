"""Holding out each customer's latest baskets as labels.

``lines`` are enriched lines carrying the columns of ``timeline.holdout_columns``. Level k removes
the last k baskets: level 1 is the test holdout, 2 and 3 are training holdouts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import LABEL, Grain
from repeatbuy.functions.skew import Sizes, attach


def rebase_days(lines: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Days counted back from the customer's newest line."""
    newest = lines.groupBy("cid").agg(F.min("days").alias("_newest"))
    return (
        attach(lines, newest, ["cid"], sizes=sizes)
        .withColumn("days", F.col("days") - F.col("_newest"))
        .drop("_newest")
    )


def last_basket(baskets: DataFrame) -> DataFrame:
    """Last basket of every customer by (checkoutdate, bid)."""
    return (
        baskets.groupBy("cid")
        .agg(F.max(F.struct("checkoutdate", "bid")).alias("_last"))
        .select("cid", F.col("_last.bid").alias("bid"), F.col("_last.checkoutdate").alias("checkoutdate"))
    )


def prior_history(lines: DataFrame, level: int) -> DataFrame:
    """Lines left when the last ``level`` baskets are gone, days re-based to the last of them."""
    return lines.filter(F.col("from_last") > level).withColumn(
        "days", F.col("days") - F.col(f"anchor_{level}")
    )


def label_set(
    lines: DataFrame, grain: Grain, level: int, context: bool = False
) -> DataFrame:
    """What the customer could buy again in the label basket, and whether they did.

    A row per product bought before; products first bought in the label basket are left out.
    ``context`` adds gap, weekday and date of the label basket, and drops labels without a gap.
    """
    date = F.col(f"label_date_{level}")
    kept = lines.filter(F.col("from_last") >= level).filter(
        (F.col("checkoutdate") != date) | (F.col(grain.flag) == 1)
    )
    ids = [c for c in ("catid", "classid") if c != grain.key]
    latest = F.struct("checkoutdate", "bid", *ids)
    labels = kept.groupBy("cid", grain.key).agg(
        F.max(latest).alias("_latest"),
        F.max(f"label_bid_{level}").alias("bid"),
        F.max(date).alias("_date"),
        F.max(f"label_gap_{level}").alias("_gap"),
        F.max(f"label_dow_{level}").alias("_dow"),
    )
    columns = [
        "cid", "bid", grain.key, *[F.col(f"_latest.{c}").alias(c) for c in ids],
        (F.col("_latest.checkoutdate") == F.col("_date")).cast("int").alias(LABEL),
    ]
    if context:
        labels = labels.filter(F.col("_gap").isNotNull())
        columns += [
            F.col("_gap").alias("days_since_prior_order"),
            F.col("_dow").alias("day_of_week"),
            F.col("_date").alias("checkoutdate"),
        ]
    return labels.select(*columns)


def gap_lines(lines: DataFrame, level: int) -> DataFrame:
    """Lines with a gap before their basket, label baskets left out.

    The label basket stays when it yields no label row, that is when all baskets of the customer
    share one timestamp.
    """
    no_label = (F.col("from_last") == level) & (F.col("checkoutdate") == F.col("first_date"))
    return lines.filter(
        F.col("days_since_prior_order").isNotNull()
        & ((F.col("from_last") > level) | no_label)
    )


def context_columns(
    labels: DataFrame, baskets: DataFrame, sizes: Sizes | None = None
) -> DataFrame:
    """Gap, weekday and date of the label basket on each label row; first baskets drop out."""
    context = baskets.filter(F.col("days_since_prior_order").isNotNull()).select(
        "cid", "bid", "days_since_prior_order",
        F.weekday("checkoutdate").alias("day_of_week"), "checkoutdate",
    )
    return attach(labels, context, ["cid", "bid"], sizes=sizes)


def customer_bucket(cid="cid"):
    """0 … 999, a portable integer hash of the customer id."""
    return F.pmod(F.pmod(F.col(cid).cast("bigint"), F.lit(1000)) * 7919 + 104729, F.lit(1000))


def customer_split(train: DataFrame, test: DataFrame, percent: int = 70):
    """Split test customers; rows of the first share move to train."""
    learn = customer_bucket() < percent * 10
    return train.unionByName(test.filter(learn)), test.filter(~learn)
