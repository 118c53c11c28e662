"""Model inputs: label rows with every feature joined by key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatbuy.functions.expr import ratio, zero_to_one
from repeatbuy.functions.fixed import CATEGORY, ITEM, LABEL, Grain
from repeatbuy.functions.skew import Sizes, attach
from repeatbuy.operators import features, holdout, price
from repeatbuy.operators.clean import gap_cutoff
from repeatbuy.operators.timeline import LEVELS, at_level
from repeatbuy.plans.orders import Orders
from repeatbuy.plans.staging import stage, stage_by_customer

FEW = 200_000  # rows of a feature table that may be broadcast
IDS = {"cid", "bid", "iid", "catid", "classid", LABEL, "checkoutdate"}


def _fill_zero(df: DataFrame) -> DataFrame:
    return df.fillna(0, subset=[c for c in df.columns if c not in IDS])


def _labels(orders: Orders, grain: Grain, level: int, pairs: DataFrame, by_class: DataFrame) -> DataFrame:
    """Label rows with the features of their own (customer, product) and (customer, class), staged.

    All sides are grouped within customers; where the lines lie by customer no join needs a shuffle.
    """
    labels = holdout.label_set(orders.lines, grain, level, context=True)
    own = labels.join(pairs, ["cid", grain.key])
    return stage_by_customer(
        attach(own, by_class, ["cid", "classid"], "inner", orders.sizes), "labels", orders.sizes
    )


def _by_class(orders: Orders, grain: Grain, level: int, ksigma: float | None = None):
    """Customer features on every (customer, class): one join carries both onto the labels."""
    classes = features.pair_summary(orders.lines, "classid", "class_reordered", level)
    users = features.user_features(
        orders.lines, orders.baskets, grain, level, ksigma, gap_share=True
    )
    return classes.drop("u_c_lines", "u_c_reorder_rate").join(users, "cid")


def _join_all(labels: DataFrame, tables) -> DataFrame:
    """The tables are written first, so that the label rows aren't shuffled for small ones."""
    sizes = Sizes(labels, staged=True)
    out = labels
    for table, on, how in tables:
        out = _beside(out, stage(table, "features"), on, how, sizes)
    return out


def _beside(rows: DataFrame, table: DataFrame, on: list[str], how: str, sizes: Sizes) -> DataFrame:
    """``attach`` for a written table; one of few rows is sent to the label rows instead."""
    few = table.count() <= FEW
    return rows.join(F.broadcast(table), on, how) if few else attach(rows, table, on, how, sizes)


def _time(orders: Orders, level: int, keys: list[str]):
    return [(t, on, "left") for t, on in features.time_features(orders.lines, level, keys)]


def model_input_item(
    orders: Orders, level: int, reduced: DataFrame | None = None
) -> DataFrame:
    """Item-grain model table of one holdout level; ``reduced`` adds the class factors.

    Inner joins define the population: customers without features leave with all their labels.
    """
    lines = orders.lines
    history = lines.filter(F.col("from_last") > level)

    def pairs(key: str, flag: str, streak: str) -> DataFrame:
        on = ["cid", key]
        summary = features.pair_summary(lines, key, flag, level)
        return summary.join(features.max_streak(orders.walks[key], on, level, streak), on)

    tables = [
        (pairs("catid", "cat_reordered", "max_streak_cat"), ["cid", "catid"], "inner"),
        (features.product_reorder_rate(history), ["iid"], "inner"),
        (features.cat_reorder_rate(history), ["catid"], "inner"),
        *_time(orders, level, ["iid", "catid", "classid"]),
    ]
    if reduced is not None:
        tables.append((reduced, ["iid"], "left"))
    own = pairs("iid", "reordered", "max_streak")
    labels = _labels(orders, ITEM, level, own, _by_class(orders, ITEM, level))
    return _fill_zero(
        _join_all(labels, tables).withColumns(
            {
                "u_p_order_rate": ratio("u_p_lines", "user_total_products"),
                "u_t_order_rate": ratio("u_t_lines", "user_total_products"),
            }
        ).drop("u_p_lines", "u_t_lines")
    )


def _category(orders: Orders, level: int, zero_days: str, ksigma: float | None,
              reduced: DataFrame | None, intervals: bool) -> DataFrame:
    pair = ["cid", "catid"]
    gapped = at_level(orders.gapped, level)
    by_cat = [F.avg("cat_reordered").alias("cat_reorder_rate")]
    by_pair = [
        *features.pair_columns("catid", "cat_reordered", level),
        price.last_price_ratio().alias("user_days_price_ratio_since_prior"),
    ]
    if ksigma is None:
        mean = price.mean_price_day_ratio(zero_days)
        by_cat.append(mean.alias("ave_price_day_ratio"))
        by_pair.append(mean.alias("user_ave_price_day_ratio"))
    cats = gapped.groupBy("catid").agg(*by_cat)
    pairs = gapped.groupBy(*pair).agg(*by_pair).join(
        features.max_streak(orders.walks["catid"], pair, level, "max_streak_cat"), pair
    )
    if ksigma is not None:
        per_day = partial(
            price.ave_price_day_ratio, gapped, zero_days=zero_days, ksigma=ksigma
        )
        cats = cats.join(per_day(["catid"], "ave_price_day_ratio"), "catid")
        pairs = pairs.join(per_day(pair, "user_ave_price_day_ratio"), pair)
    if intervals:
        cat_days = price.days_between_cat_orders(gapped, ksigma)
        cats = cats.join(zero_to_one(cat_days, ["days_between_cat_orders"]), "catid")
        pair_days = price.days_between_user_cat_orders(gapped, ksigma)
        pairs = pairs.join(zero_to_one(pair_days, ["days_between_user_cat_orders"]), pair)
    tables = [
        (cats, ["catid"], "inner"),
        *_time(orders, level, ["catid", "classid"]),
    ]
    if reduced is not None:
        tables.append((reduced, ["catid"], "left"))
    labels = _labels(orders, CATEGORY, level, pairs, _by_class(orders, CATEGORY, level, ksigma))
    return _join_all(labels, tables).withColumn(
        "u_t_order_rate", ratio("u_t_lines", "user_total_cats")
    ).drop("u_t_lines")


def model_input_category(
    orders: Orders, level: int, reduced: DataFrame | None = None
) -> DataFrame:
    """Category-grain model table of one holdout level."""
    return _fill_zero(_category(orders, level, "null", None, reduced, intervals=False))


# --- several holdouts at once --------------------------------------------------------------


def per_level(
    rows: DataFrame, keys: list[str], name: str,
    make: Callable[[int], tuple[Column, Mapping[str, Column]]], levels: Sequence[int] = LEVELS,
) -> DataFrame:
    """One aggregation for all holdout levels: a row per key, with an array of a struct per level.

    ``make(level)`` gives the condition for a row to take part and the aggregates over such rows; the
    struct is NULL where the key has none. The scan, the shuffle and the rows are those of one level.
    """
    structs = []
    for level in levels:
        inside, columns = make(level)
        made = F.struct(*[c.alias(n) for n, c in columns.items()])
        structs.append(F.when(F.count_if(inside) > 0, made))
    return rows.groupBy(*keys).agg(F.array(*structs).alias(name))


def _history(level: int) -> Column:
    return F.col("from_last") > level


def _label_levels(orders: Orders, grain: Grain) -> DataFrame:
    """``holdout.label_set`` with context, for every level."""
    ids = [c for c in ("catid", "classid") if c != grain.key]
    latest = F.struct("checkoutdate", "bid", *ids)

    def make(level: int):
        date = F.col(f"label_date_{level}")
        inside = (F.col("from_last") >= level) & ((F.col("checkoutdate") != date) | (F.col(grain.flag) == 1))
        last = F.max(F.when(inside, latest))
        of = {n: F.max(F.when(inside, F.col(f"label_{c}_{level}"))) for n, c in (
            ("bid", "bid"), ("days_since_prior_order", "gap"), ("day_of_week", "dow"), ("checkoutdate", "date"),
        )}
        bought = (last["checkoutdate"] == of["checkoutdate"]).cast("int")
        return inside, of | {c: last[c] for c in ids} | {LABEL: bought}

    return per_level(orders.lines, ["cid", grain.key], "_label", make)


def _pair_levels(orders: Orders, grain: Grain) -> DataFrame:
    """Pair features of every level at category grain, with prices and intervals."""

    def make(level: int):
        inside = _history(level)
        known = F.coalesce(F.col("next_from_last") > level, F.lit(False))
        per_day = price.price_day_ratio("one", F.when(known, F.col("days_to_next_purchase")))
        since = ratio(F.col("price"), F.col("days") - F.col(f"anchor_{level}") + F.lit(0.4))
        gap = F.col("days_since_prior_order")
        return inside, {
            "u_t_lines": F.count_if(inside),
            "u_t_reorder_rate": F.avg(F.when(inside, F.col(grain.flag))),
            "u_t_orders_since_last": F.min(F.when(inside, F.col("from_last"))) - F.lit(level + 1),
            features.GAP_NAMES[("cid", grain.key)]: ratio(
                F.count_if(inside & (gap == F.col(f"label_gap_{level}"))), F.count(F.when(inside, gap))
            ),
            "user_days_price_ratio_since_prior": F.max(F.when(inside & ~known, since)),
            "user_ave_price_day_ratio": F.avg(F.when(inside, per_day)),
            "days_between_user_cat_orders": F.avg(F.when(inside, F.col("days_since_prior_purchase"))),
        }

    return per_level(orders.gapped, ["cid", grain.key], "_pair", make)


def _streak_levels(walk: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``features.max_streak`` of every level."""
    steps = []
    for level in LEVELS:
        goes_on = F.coalesce(F.col("next_from_last") > level, F.lit(False))
        step = _history(level) & goes_on & (F.col("next_order") - F.col("order_number") == 1)
        ends = F.max(F.when(_history(level), ~goes_on))  # NULL where the run has no history
        steps.append(F.when(ends.isNotNull(), F.when(ends, 0).otherwise(F.count_if(step))).alias(f"_{level}"))
    runs = walk.groupBy(*keys, "run", "repeats").agg(*steps)
    return runs.groupBy(*keys).agg(
        F.array(*[F.when(F.count(f"_{k}") > 0, F.struct(F.max(f"_{k}").alias(name))) for k in LEVELS]).alias("_streak")
    )


def _customer_levels(orders: Orders, grain: Grain, classes: DataFrame) -> DataFrame:
    """``features.user_features`` of every level, with the gap share."""
    gap = F.col("days_since_prior_order")

    def plain(level: int):
        inside = _history(level)
        n = F.count_if(inside)
        return inside, {
            "user_cat_reorder_rate": F.avg(F.when(inside, F.col(grain.flag))),
            "user_total_cats": n,
            "user_avg_cart_size": ratio(n, F.max(F.when(inside, F.col("order_number")))),
            features.GAP_NAMES[("cid",)]: ratio(
                F.count_if(inside & (gap == F.col(f"label_gap_{level}"))), F.count(F.when(inside, gap))
            ),
        }

    def between(level: int):
        inside = _history(level) & gap.isNotNull()
        return inside, {"days_between_orders": F.avg(F.when(inside, gap))}

    def variety(source: str, plural: str):
        unique, again = f"user_unique_{plural}", f"user_reordered_{plural}"

        def make(level: int):
            own = F.col(source)[level - 1]["again"]
            return own == 1, {
                unique: F.count(own), again: F.sum(own), f"{again}_ratio": ratio(F.sum(own), F.count(own)),
            }

        return make

    again = per_level(
        orders.lines, ["cid", "catid"], "_kept",
        lambda level: (_history(level), {"again": F.max(F.when(_history(level), F.col(grain.flag)))}),
    )
    out = per_level(orders.lines, ["cid"], "_user", plain)
    out = out.join(per_level(orders.baskets, ["cid"], "_between", between), "cid")
    out = out.join(per_level(again, ["cid"], "_cats", variety("_kept", "cats")), "cid")
    return out.join(per_level(classes, ["cid"], "_classes", variety("_class", "classes")), "cid")


def _class_levels(orders: Orders, grain: Grain) -> DataFrame:
    """What a (customer, class) contributes to the labels and to the customer's variety."""
    gap = F.col("days_since_prior_order")

    def make(level: int):
        inside = _history(level)
        return inside, {
            "u_c_orders_since_last": F.min(F.when(inside, F.col("from_last"))) - F.lit(level + 1),
            features.GAP_NAMES[("cid", "classid")]: ratio(
                F.count_if(inside & (gap == F.col(f"label_gap_{level}"))), F.count(F.when(inside, gap))
            ),
            "again": F.max(F.when(inside, F.col(grain.flag))),
        }

    return per_level(orders.lines, ["cid", "classid"], "_class", make)


def _category_levels(orders: Orders, grain: Grain) -> DataFrame:
    """Category features of every level; unknown intervals ← mean over the level's categories."""

    def make(level: int):
        inside = _history(level)
        known = F.coalesce(F.col("next_from_last") > level, F.lit(False))
        per_day = price.price_day_ratio("one", F.when(known, F.col("days_to_next_purchase")))
        return inside, {
            "cat_reorder_rate": F.avg(F.when(inside, F.col(grain.flag))),
            "ave_price_day_ratio": F.avg(F.when(inside, per_day)),
            "days_between_cat_orders": F.avg(F.when(inside, F.col("days_since_prior_purchase"))),
        }

    means = stage(per_level(orders.gapped, [grain.key], "_cat", make), "categories")
    days = "days_between_cat_orders"
    usual = [means.agg(F.avg(F.col("_cat")[k - 1][days])).scalar() for k in LEVELS]
    filled = []
    for k, mean in zip(LEVELS, usual, strict=True):
        own = F.col("_cat")[k - 1]
        value = F.coalesce(own[days], mean)
        filled.append(F.when(own.isNotNull(), own.withField(days, F.when(value == 0, 1.0).otherwise(value))))
    return means.select(grain.key, F.array(*filled).alias("_cat"))


def _share_levels(lines: DataFrame, key: str) -> DataFrame:
    """Weekday and gap shares of a key's lines, for every level: key, kind, value and the shares.

    One count per (key, value), as in ``expr.share``. A written table: its size is known to the
    planner, so the label rows aren't shuffled for it where it is small.
    """
    dsp = lines.filter(F.col("days_since_prior_order").isNotNull())
    parts = []
    for by in ("day_of_week", "days_since_prior_order"):
        counts = []
        for level in LEVELS:
            no_label = (F.col("from_last") == level) & (F.col("checkoutdate") == F.col("first_date"))
            counts.append(F.count_if(_history(level) | no_label).alias(f"_{level}"))
        held = dsp.groupBy(key, F.col(by).alias("value")).agg(*counts)
        all_of = Window.partitionBy(key)
        shares = [
            F.when(F.col(f"_{k}") > 0, ratio(F.col(f"_{k}"), F.sum(f"_{k}").over(all_of))) for k in LEVELS
        ]
        parts.append(held.select(key, F.lit(by).alias("kind"), "value", F.array(*shares).alias("shares")))
    return stage(parts[0].unionByName(parts[1]), "shares")


def category_levels(orders: Orders, reduced: DataFrame | None = None) -> DataFrame:
    """Label rows of all holdout levels (column ``level``) with interval features, in one program.

    Each family of features is one aggregation over one scan, whatever the number of levels; tables
    are joined by key, and a row picks the struct of its level. Staged.
    """
    grain, pair = CATEGORY, ["cid", "catid"]
    pairs = _pair_levels(orders, grain).join(
        _streak_levels(orders.walks[grain.key], pair, "max_streak_cat"), pair
    )
    # All three are grouped by the pair, so these joins need no further shuffle.
    wide = _label_levels(orders, grain).join(pairs, pair)
    rows = wide.select(*pair, F.explode(F.array(*map(F.lit, LEVELS))).alias("level"), "_label", "_pair", "_streak")

    def picked(df: DataFrame, *names: str) -> DataFrame:
        """The fields of each table's struct of the row's level; rows without one leave."""
        kept = [c for c in df.columns if c not in names]
        now = df.select(*kept, *[F.element_at(c, F.col("level")).alias(c) for c in names])
        return now.dropna(subset=list(names)).select(*kept, *[f"{c}.*" for c in names])

    labels = picked(rows, "_label", "_pair", "_streak").filter("days_since_prior_order is not null")
    classes = stage_by_customer(_class_levels(orders, grain), "classes", orders.sizes)
    by_class = classes.join(_customer_levels(orders, grain, classes), "cid")
    sizes = orders.sizes
    out = attach(labels, by_class, ["cid", "classid"], "inner", sizes)
    out = picked(out, "_class", "_user", "_between", "_cats", "_classes").drop("again")
    out = picked(_beside(out, _category_levels(orders, grain), ["catid"], "inner", sizes), "_cat")
    for key in ("catid", "classid"):
        shares = _share_levels(orders.lines, key)
        for by, name in (("day_of_week", features.WEEK_NAMES[key]), ("days_since_prior_order", features.GAP_NAMES[(key,)])):
            own = shares.filter(F.col("kind") == by).select(key, F.col("value").alias(by), "shares")
            out = _beside(out, own, [key, by], "left", sizes)
            out = out.withColumn(name, F.element_at("shares", F.col("level"))).drop("shares")
    if reduced is not None:
        out = attach(out, reduced, ["catid"], "left", sizes)
    out = out.withColumn("u_t_order_rate", ratio("u_t_lines", "user_total_cats")).drop("u_t_lines")
    ones = ["days_between_orders", "days_between_user_cat_orders"]
    return stage_by_customer(zero_to_one(out, ones), "holdouts", sizes)


def stacked_frames(
    orders: Orders, ksigma: float | None = None, reduced: DataFrame | None = None
) -> dict[int, DataFrame]:
    """Label rows with interval features of the test (1) and both training holdouts (2, 3).

    Without ``ksigma`` all come from one program; its limits depend on the level's rows.
    """
    if ksigma is None:
        rows = category_levels(orders, reduced)
        return {level: rows.filter(F.col("level") == level).drop("level") for level in LEVELS}
    frames = {}
    for level in LEVELS:
        rows = _category(orders, level, "one", ksigma, reduced, intervals=True)
        frames[level] = stage(zero_to_one(rows, ["days_between_orders"]), "holdout")
    return frames


def stack(
    frames: Mapping[int, DataFrame], otli: int | None = None, constant: bool = False
) -> DataFrame:
    """Holdouts under one another, unknown prices and intervals filled, ratios added.

    ``split`` tells train from test. ``otli`` cuts rows whose label basket came after a longer gap.
    """
    usual = frames[2].agg(F.avg("ave_price_day_ratio")).scalar()
    parts = [
        frames[level].withColumn("split", F.lit("test" if level == 1 else "train"))
        for level in sorted(frames)
    ]
    both = reduce(DataFrame.unionByName, parts).withColumn("train_price_day_ratio", usual)
    out = price.ratio_features(price.fill_hierarchical(both, constant))
    return out if otli is None else gap_cutoff(out, otli)


def model_input_stacked(
    orders: Orders, ksigma: float | None = None, otli: int | None = None,
    constant: bool = False, reduced: DataFrame | None = None,
) -> DataFrame:
    """Two training holdouts stacked, and the test holdout, with interval and ratio features."""
    return stack(stacked_frames(orders, ksigma, reduced), otli, constant)
