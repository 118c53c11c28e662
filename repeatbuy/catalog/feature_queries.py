"""Customer, product, pair, time and price features at both grains."""

from __future__ import annotations

from pyspark.sql import functions as F

from repeatbuy.catalog.registry import query
from repeatbuy.functions.fixed import CATEGORY, ITEM, RATIO_FEATURES
from repeatbuy.operators import features, holdout, price, timeline
from repeatbuy.plans import inputs
from repeatbuy.sources.fixture import FIXTURE_GROUPS

GRAINS = {"item": ITEM, "cat": CATEGORY}


def orders(ws, suffix):
    return ws.item if suffix == "item" else ws.category


def history(ws, suffix, level=1):
    return orders(ws, suffix).lines.filter(F.col("from_last") > level)


def gap_lines(ws, suffix="item"):
    return holdout.gap_lines(orders(ws, suffix).lines, 1)


def gapped(ws):
    return timeline.at_level(ws.category.gapped, 1)


for _s, _g in GRAINS.items():

    @query(f"f01_user_reorder_rate_{_s}")
    def _(ws, s=_s, g=_g):
        return features.user_reorder_rate(history(ws, s), g)

    @query(f"f03_user_total_products_{_s}" if _s == "item" else "f03_user_total_cats_cat")
    def _(ws, s=_s, g=_g):
        return features.user_totals(history(ws, s), g).drop("user_avg_cart_size")

    @query(f"f04_user_avg_cart_size_{_s}")
    def _(ws, s=_s, g=_g):
        return features.user_totals(history(ws, s), g).select("cid", "user_avg_cart_size")

    @query(f"f05_days_between_orders_{_s}")
    def _(ws, s=_s, g=_g):
        return features.days_between_orders(orders(ws, s).baskets, 1)

    @query(f"f07_user_reordered_cats_{_s}")
    def _(ws, s=_s, g=_g):
        return features.user_variety(history(ws, s), "catid", g.flag, "cats").drop(
            "user_unique_cats"
        )

    @query(f"f08_user_reordered_classes_{_s}")
    def _(ws, s=_s, g=_g):
        return features.user_variety(history(ws, s), "classid", g.flag, "classes").drop(
            "user_unique_classes"
        )

    @query(f"f09_user_features_{_s}")
    def _(ws, s=_s, g=_g):
        return features.user_features(orders(ws, s).lines, orders(ws, s).baskets, g, 1)

    @query(f"f11_cat_reorder_rate_{_s}")
    def _(ws, s=_s):
        return features.cat_reorder_rate(history(ws, s))

    @query(f"f14_order_rate_{_s}")
    def _(ws, s=_s, g=_g):
        return features.pair_order_rate(
            history(ws, s), g.key, ws.sizes("item" if s == "item" else "category")
        )

    @query(f"f15_reorder_rate_{_s}")
    def _(ws, s=_s, g=_g):
        return features.pair_reorder_rate(history(ws, s), g)

    @query(f"f17_u_t_orders_since_last_{_s}")
    def _(ws, s=_s):
        return features.orders_since_last(orders(ws, s).lines, "catid", 1)

    @query(f"f18_u_c_orders_since_last_{_s}")
    def _(ws, s=_s):
        return features.orders_since_last(orders(ws, s).lines, "classid", 1)

    @query(f"f23_cat_week_reorder_rate_{_s}")
    def _(ws, s=_s):
        return features.week_share(gap_lines(ws, s), "catid")

    @query(f"f24_class_week_reorder_rate_{_s}")
    def _(ws, s=_s):
        return features.week_share(gap_lines(ws, s), "classid")

    @query(f"f26_t_days_since_prior_order_reorder_rate_{_s}")
    def _(ws, s=_s):
        return features.gap_share(gap_lines(ws, s), ("catid",))

    @query(f"f27_c_days_since_prior_order_reorder_rate_{_s}")
    def _(ws, s=_s):
        return features.gap_share(gap_lines(ws, s), ("classid",))

    @query(f"f28_u_days_since_prior_order_reorder_rate_{_s}")
    def _(ws, s=_s):
        return features.gap_share(gap_lines(ws, s), ("cid",))

    @query(f"f30_u_t_days_since_prior_reorder_rate_{_s}")
    def _(ws, s=_s):
        return features.gap_share(gap_lines(ws, s), ("cid", "catid"))

    @query(f"f31_u_c_days_since_prior_reorder_rate_{_s}")
    def _(ws, s=_s):
        return features.gap_share(gap_lines(ws, s), ("cid", "classid"))


for _key, _plural in (("iid", "products"), ("catid", "cats"), ("classid", "classes")):

    @query(f"f02_user_unique_{_plural}")
    def _(ws, key=_key, plural=_plural):
        variety = features.user_variety(history(ws, "item"), key, "reordered", plural)
        return variety.select("cid", f"user_unique_{plural}")


@query("f06_user_reordered_products")
def _(ws):
    return features.user_variety(history(ws, "item"), "iid", "reordered", "products").drop(
        "user_unique_products"
    )


@query("f10_product_reorder_rate")
def _(ws):
    return features.product_reorder_rate(history(ws, "item"))


@query("f12_class_flags")
def _(ws):
    return features.class_flags(ws.raw.select("iid", "classid").distinct(), FIXTURE_GROUPS)


@query("f13_reduced_class_features_item")
def _(ws):
    return features.reduced_class_features(ws.raw, "iid", FIXTURE_GROUPS)


@query("f13_reduced_class_features_cat")
def _(ws):
    return features.reduced_class_features(ws.raw, "catid", FIXTURE_GROUPS)


@query("f16_u_p_orders_since_last")
def _(ws):
    return features.orders_since_last(ws.item.lines, "iid", 1)


@query("f19_max_streak")
def _(ws):
    return features.max_streak(ws.item.walks["iid"], ["cid", "iid"], 1, "max_streak")


@query("f19_max_streak_cat_item")
def _(ws):
    return features.max_streak(ws.item.walks["catid"], ["cid", "catid"], 1, "max_streak_cat")


@query("f19_max_streak_cat_cat")
def _(ws):
    return features.max_streak(ws.category.walks["catid"], ["cid", "catid"], 1, "max_streak_cat")


@query("f19_max_streak_class_open")
def _(ws):
    walk = features.streak_walk(ws.category.lines, ["cid", "classid"])
    return features.max_streak(
        walk, ["cid", "classid"], 1, "max_streak_class", include_open=True
    )


@query("f20_user_product_features")
def _(ws):
    return features.user_product_features(ws.item.lines, ws.item.walks["iid"], 1, ws.sizes("item"))


@query("f21_user_cat_features_item")
def _(ws):
    return features.user_cat_features(
        ws.item.lines, ws.item.walks["catid"], 1, by_class=False, sizes=ws.sizes("item")
    )


@query("f21_user_cat_features_cat")
def _(ws):
    return features.user_cat_features(ws.category.lines, ws.category.walks["catid"], 1, sizes=ws.sizes("category"))


@query("f22_product_week_reorder_rate")
def _(ws):
    return features.week_share(gap_lines(ws), "iid")


@query("f25_p_days_since_prior_order_reorder_rate")
def _(ws):
    return features.gap_share(gap_lines(ws), ("iid",))


@query("f29_u_p_days_since_prior_reorder_rate")
def _(ws):
    return features.gap_share(gap_lines(ws), ("cid", "iid"))


for _zero, _v in (("null", "v1"), ("one", "v2")):

    @query(f"f32_ave_price_day_ratio_{_v}")
    def _(ws, zero=_zero):
        return price.ave_price_day_ratio(gapped(ws), ["catid"], "ave_price_day_ratio", zero)

    @query(f"f33_user_ave_price_day_ratio_{_v}")
    def _(ws, zero=_zero):
        return price.ave_price_day_ratio(
            gapped(ws), ["cid", "catid"], "user_ave_price_day_ratio", zero
        )


@query("f34_user_days_price_ratio_since_prior")
def _(ws):
    return price.days_price_ratio_since_prior(gapped(ws))


@query("f35_days_between_cat_orders")
def _(ws):
    return price.days_between_cat_orders(gapped(ws))


@query("f36_days_between_user_cat_orders")
def _(ws):
    return price.days_between_user_cat_orders(gapped(ws))




@query("f37_ratio_features")
def _(ws):
    rows = inputs.stack(ws.holdouts).filter(F.col("split") == "test")
    return rows.select("cid", "catid", *RATIO_FEATURES)


@query("f38_fill_hierarchical")
def _(ws):
    rows = inputs.stack(ws.holdouts).filter(F.col("split") == "train")
    return rows.select(
        "cid", "bid", "catid", "days_between_user_cat_orders", "user_ave_price_day_ratio",
        "ave_price_day_ratio",
    )


@query("f38_fill_constant")
def _(ws):
    rows = inputs.stack(ws.holdouts, constant=True)
    return rows.select("cid", "bid", "catid", "split", "ave_price_day_ratio", "user_DPR_tot_ratio")
