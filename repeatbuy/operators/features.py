"""Customer, product, category, pair and time features.

``lines`` are enriched lines with holdout columns, ``baskets`` the basket timeline with the same.
Every feature is a group-by that combines partial results before the shuffle; nothing collects a
key's lines.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.expr import ratio, share
from repeatbuy.functions.fixed import CLASS_GROUPS, ITEM, Grain
from repeatbuy.functions.skew import Sizes, attach, ordered
from repeatbuy.operators.holdout import gap_lines
from repeatbuy.operators.outliers import ksigma_filter
from repeatbuy.operators.timeline import BASKET_ORDER

# --- customer ------------------------------------------------------------------------------


def user_reorder_rate(history: DataFrame, grain: Grain) -> DataFrame:
    name = "user_reorder_rate" if grain == ITEM else "user_cat_reorder_rate"
    return history.groupBy("cid").agg(F.avg(grain.flag).alias(name))


def user_totals(history: DataFrame, grain: Grain) -> DataFrame:
    """Lines, and lines per basket."""
    name = "user_total_products" if grain == ITEM else "user_total_cats"
    return (
        history.groupBy("cid")
        .agg(F.count("*").alias(name), F.max("order_number").alias("_baskets"))
        .select("cid", name, ratio(name, "_baskets").alias("user_avg_cart_size"))
    )


def ksigma_cart_size(history: DataFrame, ksigma: float) -> DataFrame:
    """Mean basket size without the customer's unusually large baskets."""
    baskets = history.groupBy("cid", "bid").agg(F.count("*").alias("_size"))
    return ksigma_filter(baskets, ["cid"], "_size", ksigma).groupBy("cid").agg(
        F.avg("_size").alias("user_avg_cart_size")
    )


def days_between_orders(
    baskets: DataFrame, level: int, ksigma: float | None = None
) -> DataFrame:
    """Mean gap between the baskets of the history; customers with one basket drop out."""
    gap = "days_since_prior_order"
    kept = baskets.filter((F.col("from_last") > level) & F.col(gap).isNotNull())
    if ksigma is not None:
        kept = ksigma_filter(kept.select("cid", gap), ["cid"], gap, ksigma)
    return kept.groupBy("cid").agg(F.avg(gap).alias("days_between_orders"))


def user_variety(history: DataFrame, key: str, flag: str, plural: str) -> DataFrame:
    """Distinct keys, distinct re-ordered keys and their ratio, per customer."""
    unique, again = f"user_unique_{plural}", f"user_reordered_{plural}"
    return (
        history.groupBy("cid", key)
        .agg(F.max(flag).alias("_again"))
        .groupBy("cid")
        .agg(F.count("*").alias(unique), F.sum("_again").alias(again))
        .withColumn(f"{again}_ratio", ratio(again, unique))
    )


def user_features(
    lines: DataFrame, baskets: DataFrame, grain: Grain, level: int,
    ksigma: float | None = None, gap_share: bool = False,
) -> DataFrame:
    """All customer features. Customers with one basket or no re-order are not in the table.

    ``gap_share`` adds the share of the customer's lines bought after the label basket's gap.
    """
    history = lines.filter(F.col("from_last") > level)
    item = grain == ITEM
    total = "user_total_products" if item else "user_total_cats"
    columns = [
        F.avg(grain.flag).alias("user_reorder_rate" if item else "user_cat_reorder_rate"),
        F.count("*").alias(total),
        ratio(F.count("*"), F.max("order_number")).alias("user_avg_cart_size"),
    ]
    if gap_share:
        columns.append(label_gap_share(level).alias(GAP_NAMES[("cid",)]))
    out = history.groupBy("cid").agg(*columns)
    if ksigma is not None:
        out = out.drop("user_avg_cart_size").join(ksigma_cart_size(history, ksigma), "cid")
    out = out.join(days_between_orders(baskets, level, ksigma), "cid")
    varieties = [("catid", "cats"), ("classid", "classes")]
    if item:
        varieties.insert(0, ("iid", "products"))
    for key, plural in varieties:
        variety = user_variety(history, key, grain.flag, plural)
        out = out.join(variety.filter(F.col(f"user_reordered_{plural}") > 0), "cid")
    return out


# --- product and category ------------------------------------------------------------------


def reorder_rate(history: DataFrame, key: str, flag: str, name: str) -> DataFrame:
    """Share of the key's lines that are re-orders; 0 when there is none."""
    return history.groupBy(key).agg(F.avg(flag).alias(name))


def product_reorder_rate(history: DataFrame) -> DataFrame:
    return reorder_rate(history, "iid", "reordered", "product_reorder_rate")


def cat_reorder_rate(history: DataFrame) -> DataFrame:
    return reorder_rate(history, "catid", "cat_reordered", "cat_reorder_rate")


def class_flags(products: DataFrame, groups: Mapping[str, list] = CLASS_GROUPS) -> DataFrame:
    """0/1 per product group, from the class id."""
    return products.withColumns(
        {name: F.col("classid").isin(ids).cast("int") for name, ids in groups.items()}
    )


def reduced_class_features(
    products: DataFrame, key: str, groups: Mapping[str, list] = CLASS_GROUPS,
    rank: int = 3, rounds: int = 25, seed: int = 42,
) -> DataFrame:
    """Rank-3 non-negative factors of the group flags, rows scaled to length 1.

    Products with equal flags get equal factors, so the factorisation runs on the distinct flag
    patterns, each weighted by the square root of its number of products; scaling a row does not
    change it once it is normalised. There are at most 2^groups patterns, so they may be broadcast.
    """
    names = list(groups)
    code = sum(
        (F.col(n) * F.lit(1 << i) for i, n in enumerate(names)), start=F.lit(0)
    ).cast("int")
    one = products.groupBy(key).agg(F.min("classid").alias("classid"))
    flagged = class_flags(one, groups)
    flagged = flagged.withColumn("_pattern", code)
    cells = flagged.groupBy("_pattern", *names).agg(F.sqrt(F.count("*")).alias("_weight"))
    triples = cells.select(
        "_pattern",
        F.posexplode(F.array(*[F.col(n) * F.col("_weight") for n in names])).alias(
            "_flag", "_value"
        ),
    )
    als = ALS(
        rank=rank, maxIter=rounds, regParam=1e-6, nonnegative=True, seed=seed,
        numUserBlocks=1, numItemBlocks=1,  # at most 2^groups x groups cells
        userCol="_pattern", itemCol="_flag", ratingCol="_value",
    )
    factors = als.fit(triples).userFactors.select(
        F.col("id").alias("_pattern"), array_to_vector("features").alias("_raw")
    )
    unit = Normalizer(p=2.0, inputCol="_raw", outputCol="_unit").transform(factors)
    reduced = unit.select("_pattern", vector_to_array("_unit").alias("_unit"))
    return flagged.join(F.broadcast(reduced), "_pattern").select(
        key,
        *[F.col("_unit")[i].alias(f"p_reduced_feat_{i + 1}") for i in range(rank)],
    )


# --- pairs ---------------------------------------------------------------------------------

RATE_NAMES = {"iid": "u_p", "catid": "u_t", "classid": "u_c"}


def pair_order_rate(
    history: DataFrame, key: str, sizes: Sizes | None = None
) -> DataFrame:
    """Lines of the pair divided by all lines of the customer."""
    pairs = history.groupBy("cid", key).agg(F.count("*").alias("_lines"))
    users = history.groupBy("cid").agg(F.count("*").alias("_all"))
    name = f"{RATE_NAMES[key]}_order_rate"
    return attach(pairs, users, ["cid"], "inner", sizes or Sizes(history)).select(
        "cid", key, ratio("_lines", "_all").alias(name)
    )


def pair_reorder_rate(history: DataFrame, grain: Grain) -> DataFrame:
    name = f"{RATE_NAMES[grain.key]}_reorder_rate"
    return history.groupBy("cid", grain.key).agg(F.avg(grain.flag).alias(name))


def orders_since_last(lines: DataFrame, key: str, level: int) -> DataFrame:
    """Baskets placed after the last one with the key, within the history."""
    history = lines.filter(F.col("from_last") > level)
    name = f"{RATE_NAMES[key]}_orders_since_last"
    return history.groupBy("cid", key).agg(
        (F.min("from_last") - F.lit(level + 1)).alias(name)
    )


# Order numbers per chunk when runs are followed; bounds the rows of a window.
STREAK_CHUNK = 4096


def streak_walk(purchases: DataFrame, keys: list[str], sizes: Sizes | None = None) -> DataFrame:
    """Distinct orders of every key, numbered, each with the order that follows.

    ``run`` and ``repeats`` together tell the runs of consecutive order numbers apart; a repeated
    order number ends one run and starts the next. One walk over all orders serves every holdout
    level, because a level only cuts orders off at the end.
    """
    orders = purchases.groupBy(*keys, "order_number").agg(
        F.count("*").alias("_lines"), F.max("from_last").alias("from_last")
    )
    repeat = F.when(F.col("_lines") > 1, 1).otherwise(0)
    walked = ordered(
        orders, keys, F.floor(F.col("order_number") / STREAK_CHUNK), ["order_number"],
        running={"_place": F.lit(1), "repeats": repeat},
        nxt={"next_order": F.col("order_number"), "next_from_last": F.col("from_last")},
        sizes=sizes,
    )
    return walked.select(
        *keys, "order_number", "from_last", "next_order", "next_from_last", "repeats",
        (F.col("order_number") - F.col("_place")).alias("run"),
    )


def max_streak(
    walk: DataFrame, keys: list[str], level: int, name: str, include_open: bool = False
) -> DataFrame:
    """Longest run of consecutive order numbers in the history of a level, counted in steps.

    The run that reaches the last purchase is only counted with ``include_open``.
    """
    goes_on = F.coalesce(F.col("next_from_last") > level, F.lit(False))
    step = goes_on & (F.col("next_order") - F.col("order_number") == 1)
    runs = (
        walk.filter(F.col("from_last") > level)
        .groupBy(*keys, "run", "repeats")
        .agg(F.count_if(step).alias("_steps"), F.max(~goes_on).alias("_open"))
    )
    steps = F.col("_steps")
    counted = steps if include_open else F.when(F.col("_open"), 0).otherwise(steps)
    return runs.groupBy(*keys).agg(F.max(counted).alias(name))


def pair_columns(key: str, flag: str, level: int) -> list[Column]:
    """Aggregates over the history lines of a (customer, key).

    The gap share is taken at the gap before the customer's label basket, the only one the
    label rows look up, so no (key, gap) table has to be joined for it.
    """
    prefix = RATE_NAMES[key]
    return [
        F.count("*").alias(f"{prefix}_lines"),
        F.avg(flag).alias(f"{prefix}_reorder_rate"),
        (F.min("from_last") - F.lit(level + 1)).alias(f"{prefix}_orders_since_last"),
        label_gap_share(level).alias(GAP_NAMES[("cid", key)]),
    ]


def last_columns(*columns: str) -> list[Column]:
    """The columns of a group's latest row, as ``timeline.last_per_group``."""
    latest = F.max(F.struct(*dict.fromkeys([*BASKET_ORDER, *columns])))
    return [latest[c].alias(c) for c in columns]


def pair_summary(lines: DataFrame, key: str, flag: str, level: int) -> DataFrame:
    """Everything a plain group-by gives about (customer, key) in the history of a level."""
    history = lines.filter(F.col("from_last") > level)
    return history.groupBy("cid", key).agg(*pair_columns(key, flag, level))


def label_gap_share(level: int) -> Column:
    """Share of a group's lines that came after the same gap as the label basket."""
    gap = F.col("days_since_prior_order")
    return ratio(F.count_if(gap == F.col(f"label_gap_{level}")), F.count(gap))


def user_product_features(
    lines: DataFrame, walk: DataFrame, level: int, sizes: Sizes | None = None
) -> DataFrame:
    """Pair features at item grain; ``walk`` is the streak walk of (customer, item); 
    since-last of the item's category and class come by key."""
    history = lines.filter(F.col("from_last") > level)
    out = (
        history.groupBy("cid", "iid")
        .agg(*pair_columns("iid", "reordered", level), *last_columns("catid", "classid"))
        .join(max_streak(walk, ["cid", "iid"], level, "max_streak"), ["cid", "iid"])
        .drop(GAP_NAMES[("cid", "iid")])
    )
    users = history.groupBy("cid").agg(F.count("*").alias("_all"))
    sizes = sizes or Sizes(history)
    out = attach(out, users, ["cid"], "inner", sizes)
    for key in ("catid", "classid"):
        out = attach(out, orders_since_last(lines, key, level), ["cid", key], "inner", sizes)
    return out.select(
        "cid", "iid", ratio("u_p_lines", "_all").alias("u_p_order_rate"), "u_p_reorder_rate",
        "u_p_orders_since_last", "u_t_orders_since_last", "u_c_orders_since_last", "max_streak",
    )


def user_cat_features(
    lines: DataFrame, walk: DataFrame, level: int, by_class: bool = True,
    sizes: Sizes | None = None,
) -> DataFrame:
    """Pair features at category grain; ``by_class=False`` leaves the class distance out."""
    history = lines.filter(F.col("from_last") > level)
    out = (
        history.groupBy("cid", "catid")
        .agg(*pair_columns("catid", "cat_reordered", level), *last_columns("classid"))
        .join(max_streak(walk, ["cid", "catid"], level, "max_streak_cat"), ["cid", "catid"])
        .drop(GAP_NAMES[("cid", "catid")])
    )
    users = history.groupBy("cid").agg(F.count("*").alias("_all"))
    sizes = sizes or Sizes(history)
    out = attach(out, users, ["cid"], "inner", sizes)
    if by_class:
        out = attach(
            out, orders_since_last(lines, "classid", level), ["cid", "classid"], "inner", sizes
        )
    return out.select(
        "cid", "catid", ratio("u_t_lines", "_all").alias("u_t_order_rate"), "u_t_reorder_rate",
        *(["u_t_orders_since_last", "u_c_orders_since_last"] if by_class else []),
        "max_streak_cat",
    )


# --- time ----------------------------------------------------------------------------------

WEEK_NAMES = {
    "iid": "product_week_reorder_rate",
    "catid": "cat_week_reorder_rate",
    "classid": "class_week_reorder_rate",
}
GAP_NAMES = {
    ("iid",): "p_days_since_prior_order_reorder_rate",
    ("catid",): "t_days_since_prior_order_reorder_rate",
    ("classid",): "c_days_since_prior_order_reorder_rate",
    ("cid",): "u_days_since_prior_order_reorder_rate",
    ("cid", "iid"): "u_p_days_since_prior_reorder_rate",
    ("cid", "catid"): "u_t_days_since_prior_reorder_rate",
    ("cid", "classid"): "u_c_days_since_prior_reorder_rate",
}


def week_share(dsp: DataFrame, key: str) -> DataFrame:
    """Share of the key's lines that fall on each weekday."""
    return share(dsp, [key], ["day_of_week"], WEEK_NAMES[key])


def gap_share(dsp: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Share of the keys' lines bought after each gap."""
    return share(dsp, list(keys), ["days_since_prior_order"], GAP_NAMES[keys])


def time_features(lines: DataFrame, level: int, keys: list[str]):
    """(feature table, join keys) of the weekday and gap shares of the given product keys."""
    dsp = gap_lines(lines, level)
    out = [(week_share(dsp, k), [k, "day_of_week"]) for k in keys]
    return out + [(gap_share(dsp, (k,)), [k, "days_since_prior_order"]) for k in keys]


