"""Purchase flags and basket timelines.

Baskets of a customer are ordered by (checkoutdate, bid). Everything ordered goes through
``ordered`` with one chunk per hour, so a customer with a third of all baskets is spread over hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatbuy.functions.skew import Sizes, attach, ordered

BASKET_ORDER = ["checkoutdate", "bid"]
LEVELS = (1, 2, 3)


def hour() -> Column:
    """Chunk of the ordered operators: hours since 1970 on the basket's own clock."""
    return F.unix_date(F.to_date("checkoutdate")) * 24 + F.hour("checkoutdate")


def first_checkout(lines: DataFrame, key: str, name: str) -> DataFrame:
    """First checkout of every (customer, key)."""
    return lines.groupBy("cid", key).agg(F.min("checkoutdate").alias(name))


def first_purchase(lines: DataFrame, key: str, name: str, sizes: Sizes | None = None) -> DataFrame:
    """The first checkout of the line's (customer, key), on each line."""
    return attach(lines, first_checkout(lines, key, name), ["cid", key], sizes=sizes)


def _flag(first: str) -> Column:
    return F.when(F.col("checkoutdate") == F.col(first), 0).otherwise(1)


def reorder_flags(lines: DataFrame) -> DataFrame:
    """0 on lines of the first purchase, 1 later; at class, category and (if present) item grain."""
    flags = {
        "first_checkout": "reordered",
        "cat_first_checkout": "cat_reordered",
        "class_first_checkout": "class_reordered",
    }
    return lines.withColumns({f: _flag(d) for d, f in flags.items() if d in lines.columns})


def weekday(df: DataFrame) -> DataFrame:
    """Monday = 0 … Sunday = 6."""
    return df.withColumn("day_of_week", F.weekday("checkoutdate"))


FIRST_NAMES = {
    "iid": "first_checkout", "catid": "cat_first_checkout", "classid": "class_first_checkout",
}


def enrich(lines: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """First-purchase dates, re-order flags and weekday on every line."""
    sizes = sizes or Sizes(lines)
    out, names = lines, {key: name for key, name in FIRST_NAMES.items() if key in lines.columns}
    if sizes.plain(["cid"]):
        # As the joins, without lines whose key is unknown.
        out = out.dropna(subset=["cid", *names])
        for key, name in names.items():
            out = out.withColumn(name, F.min("checkoutdate").over(Window.partitionBy("cid", key)))
        return weekday(reorder_flags(out))
    for key, name in names.items():
        out = attach(out, first_checkout(lines, key, name), ["cid", key], "inner", sizes)
    return weekday(reorder_flags(out))


def basket_rows(lines: DataFrame) -> DataFrame:
    """One row per basket."""
    return lines.groupBy("cid", "bid").agg(
        F.max("checkoutdate").alias("checkoutdate"), F.max("days").alias("days")
    )


def basket_gap(baskets: DataFrame) -> DataFrame:
    """Days since the customer's previous basket; NULL on the first."""
    prior = ordered(baskets, ["cid"], hour(), BASKET_ORDER, prev={"_prior_days": F.col("days")})
    return prior.select(
        *baskets.columns, (F.col("_prior_days") - F.col("days")).alias("days_since_prior_order")
    )


def basket_timeline(baskets: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Gap from the last basket, gap to the next, order number from 1, orders in total."""
    out = ordered(
        baskets, ["cid"], hour(), BASKET_ORDER,
        running={"order_number": F.lit(1)},
        total={"total_orders": F.lit(1)},
        prev={"_prior_days": F.col("days")},
        nxt={"_next_days": F.col("days")},
        sizes=sizes,
    )
    return out.select(
        *baskets.columns,
        (F.col("_prior_days") - F.col("days")).cast("int").alias("days_since_prior_order"),
        (F.col("days") - F.col("_next_days")).cast("int").alias("days_until_next"),
        "order_number",
        "total_orders",
    )


def days_since_prior(lines: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Lines of every basket but the first, with the gap before the basket."""
    gaps = basket_gap(basket_rows(lines)).filter(F.col("days_since_prior_order").isNotNull())
    gaps = gaps.select("cid", "bid", F.col("days_since_prior_order").cast("int"))
    return attach(lines, gaps, ["cid", "bid"], sizes=sizes)


def holdout_columns(
    timeline: DataFrame, levels=LEVELS, sizes: Sizes | None = None
) -> DataFrame:
    """Mark what each holdout level needs, per customer, on every basket.

    ``from_last`` is 1 for the customer's last basket. For level k the k-th basket from the end is
    the label basket: its bid, date, weekday and gap, and ``anchor_k``, the days counter that
    history is re-based to.
    """
    baskets = timeline.withColumn(
        "from_last", F.col("total_orders") - F.col("order_number") + 1
    )
    picks = [F.min("checkoutdate").alias("first_date")]
    for k in levels:
        at = F.col("from_last") == k
        picks += [
            F.max(F.when(at, F.col("bid"))).alias(f"label_bid_{k}"),
            F.max(F.when(at, F.col("checkoutdate"))).alias(f"label_date_{k}"),
            F.max(F.when(at, F.weekday("checkoutdate"))).alias(f"label_dow_{k}"),
            F.max(F.when(at, F.col("days_since_prior_order"))).alias(f"label_gap_{k}"),
            F.min(F.when(F.col("from_last") >= k, F.col("days"))).alias(f"anchor_{k}"),
        ]
    customers = baskets.groupBy("cid").agg(*picks)
    return attach(baskets, customers, ["cid"], "inner", sizes)


def with_timeline(
    lines: DataFrame, baskets: DataFrame, sizes: Sizes | None = None
) -> DataFrame:
    """Basket attributes on every line of the basket."""
    extra = baskets.drop("checkoutdate", "days")
    return attach(lines, extra, ["cid", "bid"], "inner", sizes)


def last_per_group(lines: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The latest row of every group by (checkoutdate, bid), then the given columns."""
    order = F.struct(*dict.fromkeys([*BASKET_ORDER, *columns]))
    return lines.groupBy(*keys).agg(F.max(order).alias("_last")).select(
        *keys, *[F.col(f"_last.{c}").alias(c) for c in columns]
    )


def purchase_gaps(rows: DataFrame, keys: list[str], sizes: Sizes | None = None) -> DataFrame:
    """Days since the previous and until the next purchase of the same group.

    ``next_from_last`` tells which basket the next purchase sits in, so one pass serves every
    holdout level (see ``at_level``).
    """
    ahead = {"_next_days": F.col("days")}
    if "from_last" in rows.columns:
        ahead["next_from_last"] = F.col("from_last")
    out = ordered(
        rows, keys, hour(), [*BASKET_ORDER, "classid"],
        prev={"_prior_days": F.col("days")}, nxt=ahead, sizes=sizes,
    )
    return out.select(
        *rows.columns,
        (F.col("_prior_days") - F.col("days")).alias("days_since_prior_purchase"),
        (F.col("days") - F.col("_next_days")).alias("days_to_next_purchase"),
        *[F.col(c) for c in ahead if c != "_next_days"],
    )


def at_level(gapped: DataFrame, level: int) -> DataFrame:
    """History rows of a holdout level, days re-based.

    A next purchase that was held out is unknown; ``is_last`` marks the last purchase left.
    """
    known = F.coalesce(F.col("next_from_last") > level, F.lit(False))
    return (
        gapped.filter(F.col("from_last") > level)
        .withColumn("days_to_next_purchase", F.when(known, F.col("days_to_next_purchase")))
        .withColumn("days", F.col("days") - F.col(f"anchor_{level}"))
        .withColumn("is_last", ~known)
        .drop("next_from_last")
    )


def group_stats(rows: DataFrame, keys: list[str], value: str, sizes: Sizes | None = None) -> DataFrame:
    """Mean, sample deviation and row count of the group, on every row."""
    stats = rows.groupBy(*keys).agg(
        F.avg(value).alias("group_mean"),
        F.stddev_samp(value).alias("group_std"),
        F.count("*").alias("group_rows"),
    )
    return attach(rows, stats, keys, sizes=sizes)
