"""Price and interval features of categories.

``gapped`` are history rows of one holdout level with the columns of ``timeline.purchase_gaps``.
With ``ksigma`` the values above mean + k deviations of their group are left out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.expr import ratio
from repeatbuy.operators.outliers import ksigma_filter


def price_day_ratio(zero_days: str = "null", days: Column | None = None) -> Column:
    """Price per day until the next purchase; 0 days count as unknown ("null") or as 1 ("one")."""
    days = F.col("days_to_next_purchase") if days is None else days
    if zero_days == "one":
        days = F.when(days == 0, 1).otherwise(days)
    return ratio(F.col("price"), days)


def mean_price_day_ratio(zero_days: str = "null") -> Column:
    """Mean price per day of a group. With "null" an unknown mean is 0."""
    mean = F.avg(price_day_ratio(zero_days))
    return F.coalesce(mean, F.lit(0.0)) if zero_days == "null" else mean


def last_price_ratio() -> Column:
    """Price of a (customer, category)'s last purchase per day since then (plus 0.4)."""
    since = ratio(F.col("price"), F.col("days") + F.lit(0.4))
    return F.max(F.when(F.col("is_last"), since))


def ave_price_day_ratio(
    gapped: DataFrame, keys: list[str], name: str, zero_days: str = "null",
    ksigma: float | None = None,
) -> DataFrame:
    if ksigma is None:
        return gapped.groupBy(*keys).agg(mean_price_day_ratio(zero_days).alias(name))
    rows = gapped.select(*keys, price_day_ratio(zero_days).alias("_ratio"))
    mean = F.avg("_ratio")
    if zero_days == "null":
        mean = F.coalesce(mean, F.lit(0.0))
    return ksigma_filter(rows, keys, "_ratio", ksigma).groupBy(*keys).agg(mean.alias(name))


def days_price_ratio_since_prior(gapped: DataFrame) -> DataFrame:
    return gapped.groupBy("cid", "catid").agg(
        last_price_ratio().alias("user_days_price_ratio_since_prior")
    )


def _usual(means: DataFrame, ksigma: float | None) -> Column:
    """Mean over the categories' means, without the unusually large ones."""
    if ksigma is not None:
        limit = means.agg(F.avg("_mean") + F.lit(ksigma) * F.stddev_samp("_mean")).scalar()
        one = means.agg(F.count("*") == 1).scalar()
        means = means.filter((F.col("_mean") <= limit) | one)
    return means.agg(F.avg("_mean")).scalar()


def days_between_cat_orders(gapped: DataFrame, ksigma: float | None = None) -> DataFrame:
    """Mean days between a customer's purchases per category; unknown ← mean over categories."""
    value = "days_since_prior_purchase"
    rows = gapped.select("catid", value)
    if ksigma is not None:
        rows = ksigma_filter(rows, ["catid"], value, ksigma)
    means = rows.groupBy("catid").agg(F.avg(value).alias("_mean"))
    return means.select(
        "catid", F.coalesce("_mean", _usual(means, ksigma)).alias("days_between_cat_orders")
    )


def days_between_user_cat_orders(gapped: DataFrame, ksigma: float | None = None) -> DataFrame:
    """Mean days between purchases per (customer, category)."""
    value, keys = "days_since_prior_purchase", ["cid", "catid"]
    rows = gapped.select(*keys, value)
    if ksigma is not None:
        rows = ksigma_filter(rows, keys, value, ksigma)
    return rows.groupBy(*keys).agg(F.avg(value).alias("days_between_user_cat_orders"))


def fill_hierarchical(rows: DataFrame, constant: bool = False) -> DataFrame:
    """Unknown user values from the category, unknown category values from the train mean.

    ``rows`` carries the train mean as ``train_price_day_ratio``. ``constant`` puts that mean on
    every row instead of only on the unknown ones.
    """
    usual = F.col("train_price_day_ratio")
    overall = usual if constant else F.coalesce("ave_price_day_ratio", usual)
    out = rows.withColumn("ave_price_day_ratio", overall)
    out = out.withColumns(
        {
            "user_ave_price_day_ratio": F.coalesce(
                "user_ave_price_day_ratio", "ave_price_day_ratio"
            ),
            "days_between_user_cat_orders": F.coalesce(
                "days_between_user_cat_orders", "days_between_cat_orders"
            ),
        }
    ).drop("train_price_day_ratio")
    numbers = [n for n, t in out.dtypes if t in ("int", "bigint", "double")]
    return out.fillna(0, subset=numbers)


def ratio_features(rows: DataFrame) -> DataFrame:
    """Ratios between a row's own columns."""
    gap, dpr = "days_since_prior_order", "user_days_price_ratio_since_prior"
    return rows.withColumns(
        {
            "since_prior_days_ratio": ratio(gap, "days_between_orders"),
            "since_prior_days_cat_ratio": ratio(gap, "days_between_cat_orders"),
            "since_prior_days_user_cat_ratio": ratio(gap, "days_between_user_cat_orders"),
            "user_unique_cat_ratio": ratio("user_unique_cats", "user_total_cats"),
            "user_DPR_user_ratio": ratio(dpr, "user_ave_price_day_ratio"),
            "user_DPR_tot_ratio": ratio(dpr, "ave_price_day_ratio"),
        }
    )
