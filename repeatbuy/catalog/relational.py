"""Sources, cleaning, joins, windows, holdout, outliers and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from repeatbuy.catalog.registry import query
from repeatbuy.functions.expr import zero_to_one
from repeatbuy.functions.fixed import (
    CATEGORY,
    CATEGORY_COLUMNS,
    CLASS_COLUMNS,
    ITEM,
    ITEM_COLUMNS,
    ORDER_COLUMNS,
)
from repeatbuy.functions.skew import attach
from repeatbuy.operators import clean, explore, features, holdout, outliers, price, timeline
from repeatbuy.plans import inputs
from repeatbuy.plans.grid import parameter_grid
from repeatbuy.plans.orders import build_orders, category_lines, popular_lines, valid_lines
from repeatbuy.plans.staging import fresh_path
from repeatbuy.sources import fixture, tables

# Parameters that bite on the fixture.
MIN_PRICE, RARE, OTLI = 5000, 10000, 365
CORE = ["cid", "bid", "iid", "catid", "classid", "quantity", "price"]
PATCH = {"PROMO": "ECONOMY", "SMALL": "MEDIUM"}


def with_holes(ws):
    """Lines with NULLs put in by rule."""
    return ws.raw.withColumns(
        {
            "quantity": F.when(F.col("quantity") != 1, F.col("quantity")),
            "marketid": F.when(F.col("marketid") != 7, F.col("marketid")),
            "segmentationlabel": F.when(
                F.col("segmentationlabel") != "FURNITURE", F.col("segmentationlabel")
            ),
        }
    )


def history(ws, level=1, grain=ITEM):
    return holdout.prior_history((ws.item if grain == ITEM else ws.category).lines, level)


# --- sources and sinks ---------------------------------------------------------------------


def _through_csv(ws, rows, names, read):
    """The rows as a file of the source's layout, read back by the library's reader."""
    path = fresh_path(ws.spark, "csv")
    return read(ws.spark, path, fixture.write_source_csv(rows, path, names))


@query("s01_read_orders")
def _(ws):
    return clean.parse_timestamp(_through_csv(ws, ws.raw, ORDER_COLUMNS, tables.read_orders))


@query("s02_read_class")
def _(ws):
    return _through_csv(ws, ws.classes, CLASS_COLUMNS, tables.read_class)


@query("s03_read_category")
def _(ws):
    return _through_csv(ws, fixture.categories(ws.spark, ws.sf_dir), CATEGORY_COLUMNS, tables.read_category)


@query("s04_read_items")
def _(ws):
    return _through_csv(ws, fixture.items(ws.spark, ws.sf_dir), ITEM_COLUMNS, tables.read_items)


@query("s05_rename_columns")
def _(ws):
    raw = fixture.table(ws.spark, ws.sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    names = {"o_orderkey": "bid", "o_custkey": "cid", "o_orderdate": "checkoutdate"}
    return tables.rename_columns(raw, names)


def _feature_store(ws):
    path = fresh_path(ws.spark, "features")
    for split, level in (("test", 1), ("train", 2)):
        labels = holdout.label_set(ws.category.lines, CATEGORY, level)
        tables.write_features(labels, path, "1", split)
    return path


@query("s06_write_features")
def _(ws):
    stored = ws.spark.read.parquet(_feature_store(ws))
    return stored.groupBy(F.col("run").cast("int").alias("run"), "split").agg(
        F.count("*").alias("rows"), F.sum("reorder_label").alias("positives")
    )


@query("s07_read_features")
def _(ws):
    return tables.read_features(ws.spark, _feature_store(ws), "1", "test").drop("run", "split")


@query("s08_versioned_write")
def _(ws):
    path = fresh_path(ws.spark, "runs")
    baskets = ws.category.baskets.select("cid", "bid", "days")
    for run, otli in (("1", OTLI), ("2", 2 * OTLI)):
        tables.write_features(baskets.filter(F.col("days") <= otli), path, run, "train")
    return ws.spark.read.parquet(path).select("cid", "bid", F.col("run").cast("int").alias("run"))


@query("s09_write_balanced")
def _(ws):
    path = fresh_path(ws.spark, "balanced")
    tables.write_table(ws.frames.balanced, path)
    stored = tables.read_table(ws.spark, path)
    return stored.groupBy("reorder_label").agg(F.count("*").alias("rows"))


@query("s10_write_cohort")
def _(ws):
    path = fresh_path(ws.spark, "cohort")
    tables.write_table(clean.loyal_cohort(ws.raw, fixture.FIXTURE_LOYAL), path)
    return tables.read_table(ws.spark, path)


@query("s12_drop_columns")
def _(ws):
    return tables.drop_columns(ws.raw, "segmentationlabel", "marketid", "days", "checkoutdate")


# --- cleaning ------------------------------------------------------------------------------


@query("c01_distinct_rows")
def _(ws):
    return clean.distinct_rows(ws.raw.select("cid", "catid", "classid"))


@query("c02_null_counts")
def _(ws):
    return clean.null_counts(with_holes(ws))


@query("c03_null_rows")
def _(ws):
    return clean.null_rows(fixture.categories(ws.spark, ws.sf_dir), "cat_name")


@query("c04_equality_lookup")
def _(ws):
    return clean.equality_lookup(ws.classes, "primaryparentid", "ROOT")


@query("c05_drop_missing")
def _(ws):
    return clean.drop_missing(with_holes(ws)).select(*CORE, "marketid")


@query("c06_range_filter")
def _(ws):
    return clean.range_filter(ws.raw, MIN_PRICE).select(*CORE)


@query("c07_distinct_values")
def _(ws):
    return clean.distinct_values(ws.raw, "segmentationlabel")


@query("c08_fill_label")
def _(ws):
    return clean.fill_label(with_holes(ws)).select("cid", "bid", "iid", "segmentationlabel")


@query("c09_patch_hierarchy")
def _(ws):
    return clean.patch_hierarchy(ws.classes, PATCH)


@query("c10_parent_name")
def _(ws):
    return clean.parent_name(ws.classes)


@query("c11_basket_count")
def _(ws):
    return clean.basket_count(ws.raw)


@query("c12_min_orders")
def _(ws):
    return clean.min_orders(ws.raw, 8).select(*CORE)


@query("c13_volume_stats")
def _(ws):
    return clean.volume_stats(ws.raw, clean.min_orders(ws.raw, 8))


@query("c14_class_counts")
def _(ws):
    return clean.class_counts(ws.raw)


@query("c15_rare_class_report")
def _(ws):
    return clean.rare_class_report(ws.raw, clean.patch_hierarchy(ws.classes, PATCH), RARE)


@query("c16_drop_rare_classes")
def _(ws):
    return clean.drop_rare_classes(ws.raw, RARE).select(*CORE)


@query("c17_parse_timestamp")
def _(ws):
    text = F.date_format("checkoutdate", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    baskets = timeline.basket_rows(ws.raw).withColumn("checkoutdate", text)
    return clean.parse_timestamp(baskets)


@query("c18_category_rollup")
def _(ws):
    return clean.category_rollup(ws.raw)


@query("c19_loyal_cohort")
def _(ws):
    return clean.loyal_cohort(ws.raw, fixture.FIXTURE_LOYAL)


@query("c20_keep_cohort")
def _(ws):
    labels = holdout.label_set(ws.category.lines, CATEGORY, 1)
    return clean.keep_cohort(labels, clean.loyal_cohort(ws.raw, fixture.FIXTURE_LOYAL), ws.sizes("category"))


@query("c21_gap_cutoff")
def _(ws):
    labels = holdout.label_set(ws.category.lines, CATEGORY, 1, context=True)
    return clean.gap_cutoff(labels, OTLI)


def _price_table(ws):
    gapped = timeline.at_level(ws.category.gapped, 1)
    pairs = price.ave_price_day_ratio(gapped, ["cid", "catid"], "user_ave_price_day_ratio")
    return pairs.join(price.days_price_ratio_since_prior(gapped), ["cid", "catid"])


PRICE_COLUMNS = ["user_ave_price_day_ratio", "user_days_price_ratio_since_prior"]


@query("c22_zero_counts")
def _(ws):
    return clean.zero_counts(_price_table(ws), PRICE_COLUMNS)


@query("c23_inf_counts")
def _(ws):
    return clean.inf_counts(_price_table(ws), PRICE_COLUMNS)


@query("c24_zero_to_one")
def _(ws):
    gaps = ws.category.baskets.select(
        "cid", "bid", F.col("days_since_prior_order").cast("double").alias("gap")
    )
    return zero_to_one(gaps, ["gap"])


@query("c25_row_audit")
def _(ws):
    return clean.row_audit(
        {
            "raw": ws.raw,
            "valid": valid_lines(ws.raw, MIN_PRICE),
            "popular": popular_lines(ws.raw, 8, RARE),
            "rolled": clean.category_rollup(ws.raw),
            "labels": holdout.label_set(ws.category.lines, CATEGORY, 1),
        }
    )


# --- joins ---------------------------------------------------------------------------------


@query("j01_inner_equi")
def _(ws):
    labels = holdout.label_set(ws.item.lines, ITEM, 1)
    return attach(labels, features.product_reorder_rate(history(ws, 1)), ["iid"], sizes=ws.sizes("item"))


@query("j02_left_equi")
def _(ws):
    labels = holdout.label_set(ws.item.lines, ITEM, 1, context=True).drop("checkoutdate")
    week = features.week_share(holdout.gap_lines(ws.item.lines, 1), "iid")
    return attach(labels, week, ["iid", "day_of_week"], "left", ws.sizes("item"))


@query("j03_semi")
def _(ws):
    cohort = clean.loyal_cohort(ws.raw, fixture.FIXTURE_LOYAL)
    return attach(ws.raw, cohort, ["cid"], "left_semi", ws.sizes("raw")).select(*CORE)


@query("j04_anti")
def _(ws):
    last = holdout.last_basket(timeline.basket_rows(ws.raw)).select("cid", "bid")
    return attach(ws.raw, last, ["cid", "bid"], "left_anti", ws.sizes("raw")).select(*CORE)


@query("j05_full_outer")
def _(ws):
    """Both sides have the same customers, so the outer join equals an inner one."""
    last = ws.item.lines.groupBy("cid", "iid").agg(F.max("order_number").alias("last_order"))
    users = ws.item.lines.groupBy("cid").agg(F.max("order_number").alias("orders"))
    return attach(last, users, ["cid"], sizes=ws.sizes("item"))


@query("j06_self_join")
def _(ws):
    parent = ws.classes.select(
        F.col("classid").alias("primaryparentid"), F.col("primaryparentid").alias("grandparent")
    ).distinct()
    return ws.classes.join(parent, "primaryparentid", "left").select(
        "classid", "primaryparentid", "grandparent"
    )


@query("j07_level_aligned_divide")
def _(ws):
    return features.pair_order_rate(ws.item.lines, "catid", ws.sizes("item"))


@query("j08_composite_isin")
def _(ws):
    often = ws.raw.groupBy("cid", "catid").agg(F.count("*").alias("n")).filter("n > 2")
    return attach(ws.raw, often.select("cid", "catid"), ["cid", "catid"], "left_semi", ws.sizes("raw")).select(*CORE)


# --- windows and set operations ------------------------------------------------------------


for _key, _name in timeline.FIRST_NAMES.items():

    @query("w01_" + {"iid": "first_purchase_item", "catid": "first_purchase_cat",
                     "classid": "first_purchase_class"}[_key])
    def _(ws, key=_key, name=_name):
        return timeline.first_purchase(ws.raw.select("cid", "bid", *timeline.FIRST_NAMES, "checkoutdate"), key, name, ws.sizes("raw"))


@query("w02_reorder_flags")
def _(ws):
    return timeline.enrich(ws.raw).select(
        "cid", "bid", "iid", "reordered", "cat_reordered", "class_reordered"
    )


@query("w03_weekday")
def _(ws):
    return timeline.weekday(timeline.basket_rows(ws.raw)).select("cid", "bid", "day_of_week")


@query("w04_basket_gap")
def _(ws):
    return timeline.basket_gap(timeline.basket_rows(ws.raw))


@query("w05_days_since_prior")
def _(ws):
    return timeline.days_since_prior(ws.raw, ws.sizes("raw")).select(
        "cid", "bid", "iid", "price", "days_since_prior_order"
    )


def _timeline(ws):
    return timeline.basket_timeline(timeline.basket_rows(ws.raw))


@query("w06_gap_to_next")
def _(ws):
    return _timeline(ws).select("cid", "bid", "days_until_next")


@query("w07_order_number")
def _(ws):
    return _timeline(ws).select("cid", "bid", "order_number")


@query("w08_total_orders")
def _(ws):
    return _timeline(ws).select("cid", "bid", "total_orders")


@query("w09_last_per_group_item")
def _(ws):
    return timeline.last_per_group(
        clean.category_rollup(ws.raw), ["cid"], ["bid", "checkoutdate"]
    )


@query("w09_last_per_group_pair")
def _(ws):
    return timeline.last_per_group(ws.raw, ["cid", "iid"], ["bid", "price"])


@query("w09_last_per_group_cat")
def _(ws):
    return timeline.last_per_group(
        clean.category_rollup(ws.raw), ["cid", "catid"], ["bid", "price"]
    )


@query("w10_lead_purchase")
def _(ws):
    gaps = timeline.purchase_gaps(clean.category_rollup(ws.raw), ["cid", "catid"])
    return gaps.select(
        "cid", "catid", "bid", "days_since_prior_purchase", "days_to_next_purchase"
    )


@query("w11_group_transform")
def _(ws):
    gaps = ws.category.baskets.select("cid", "bid", "days_since_prior_order")
    stats = timeline.group_stats(gaps, ["cid"], "days_since_prior_order", ws.sizes("category"))
    inside = F.col("days_since_prior_order") <= F.col("group_mean") + F.col("group_std")
    return stats.withColumn("inside", inside.cast("int"))


@query("w12_sort")
def _(ws):
    return timeline.basket_rows(ws.raw).orderBy("cid", F.desc("checkoutdate"), "bid")


@query("u01_union_all")
def _(ws):
    train = holdout.label_set(ws.category.lines, CATEGORY, 2)
    more = holdout.label_set(ws.category.lines, CATEGORY, 3)
    return train.unionByName(more)


@query("u03_distinct_keys")
def _(ws):
    return ws.raw.select("iid", "classid", "catid").distinct()


# --- holdout -------------------------------------------------------------------------------


@query("h01_rebase_days")
def _(ws):
    return holdout.rebase_days(ws.raw, ws.sizes("raw")).select("cid", "bid", "iid", "days")


@query("h02_last_basket")
def _(ws):
    return holdout.last_basket(timeline.basket_rows(ws.raw))


for _grain, _suffix in ((ITEM, "item"), (CATEGORY, "cat")):

    @query(f"h03_prior_history_{_suffix}")
    def _(ws, grain=_grain):
        return history(ws, 1, grain).select("cid", "bid", grain.key, "price", "days")

    @query(f"h04_label_set_{_suffix}")
    def _(ws, grain=_grain):
        lines = (ws.item if grain == ITEM else ws.category).lines
        return holdout.label_set(lines, grain, 1)

    @query(f"h05_rolling_holdout_{_suffix}")
    def _(ws, grain=_grain):
        lines = (ws.item if grain == ITEM else ws.category).lines
        levels = [
            holdout.label_set(lines, grain, k).withColumn("level", F.lit(k)) for k in (1, 2, 3)
        ]
        return levels[0].unionByName(levels[1]).unionByName(levels[2])

    @query(f"h06_context_columns_{_suffix}")
    def _(ws, grain=_grain):
        orders = ws.item if grain == ITEM else ws.category
        return holdout.context_columns(
            holdout.label_set(orders.lines, grain, 1), orders.baskets,
            ws.sizes("item" if grain == ITEM else "category"),
        )


@query("h07_customer_split")
def _(ws):
    sets = [holdout.label_set(ws.category.lines, CATEGORY, k) for k in (2, 1)]
    train, test = holdout.customer_split(*sets)
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


@query("h08_model_input_item")
def _(ws):
    return inputs.model_input_item(ws.item, 1)


@query("h08_model_input_item_train")
def _(ws):
    return inputs.model_input_item(ws.item, 2)


@query("h09_model_input_category")
def _(ws):
    return inputs.model_input_category(ws.category, 1)


@query("h09_model_input_category_train")
def _(ws):
    return inputs.model_input_category(ws.category, 2)


@query("h10_model_input_stacked")
def _(ws):
    return inputs.stack(ws.holdouts)


# --- outliers ------------------------------------------------------------------------------


@query("x01_basket_timeline")
def _(ws):
    return _timeline(ws)


@query("x02_long_gaps")
def _(ws):
    return outliers.long_gaps(ws.category.baskets, OTLI).select("cid", "bid", "days_until_next")


@query("x03_gap_ratio_customers")
def _(ws):
    return outliers.gap_ratio_customers(outliers.gap_summary(ws.category.baskets, OTLI))


def _rule(customers, baskets):
    nothing = F.lit(None).cast("bigint").alias("bid")
    return customers.select("cid", nothing).unionByName(baskets.select("cid", "bid"))


@query("x04_single_gap_rule")
def _(ws):
    return _rule(*outliers.single_gap_rule(outliers.gap_summary(ws.category.baskets, OTLI)))


@query("x05_double_gap_rule")
def _(ws):
    return _rule(*outliers.double_gap_rule(outliers.gap_summary(ws.category.baskets, OTLI)))


@query("x05_double_gap_rule_strict")
def _(ws):
    gaps = outliers.gap_summary(ws.category.baskets, OTLI)
    return _rule(*outliers.double_gap_rule(gaps, strict=True))


@query("x06_remove_gap_outliers")
def _(ws):
    orders = ws.category
    kept = outliers.remove_gap_outliers(orders.lines, orders.baskets, OTLI, sizes=ws.sizes("category"))
    return kept.select("cid", "bid", "catid", "price")


@query("x07_ksigma_filter_cart_size")
def _(ws):
    sizes = ws.category.lines.groupBy("cid", "bid").agg(F.count("*").alias("cart_size"))
    return outliers.ksigma_filter(sizes, ["cid"], "cart_size", 1, sizes=ws.sizes("category"))


@query("x07_ksigma_filter_gap")
def _(ws):
    gaps = ws.category.baskets.select("cid", "bid", "days_since_prior_order")
    return outliers.ksigma_filter(gaps, ["cid"], "days_since_prior_order", 2, sizes=ws.sizes("category"))


@query("x07_ksigma_filter_cat_gap")
def _(ws):
    gaps = ws.category.gapped.select("cid", "bid", "catid", "days_since_prior_purchase")
    return outliers.ksigma_filter(
        gaps, ["cid", "catid"], "days_since_prior_purchase", 2, sizes=ws.sizes("category")
    )


@query("x08_ksigma_features_user")
def _(ws):
    return features.user_features(ws.category.lines, ws.category.baskets, CATEGORY, 1, ksigma=2)


@query("x08_ksigma_features_cat")
def _(ws):
    gapped = timeline.at_level(ws.category.gapped, 1)
    ratio = price.ave_price_day_ratio(gapped, ["catid"], "ave_price_day_ratio", "one", 2)
    return ratio.join(price.days_between_cat_orders(gapped, 2), "catid")


@query("x08_ksigma_features_user_cat")
def _(ws):
    gapped = timeline.at_level(ws.category.gapped, 1)
    pair = ["cid", "catid"]
    ratio = price.ave_price_day_ratio(gapped, pair, "user_ave_price_day_ratio", "one", 2)
    return ratio.join(price.days_between_user_cat_orders(gapped, 2), pair)


@query("x09_parameter_grid")
def _(ws):
    path = fresh_path(ws.spark, "grid")
    report = parameter_grid(ws.raw, path, ksigmas=(2,), otlis=(OTLI,), least_orders=(4,))
    return report.drop("seconds")


@query("x09_stacked_without_outliers")
def _(ws):
    orders = build_orders(category_lines(ws.raw, min_orders=4), True, OTLI)
    return inputs.model_input_stacked(orders, ksigma=2, otli=OTLI)


@query("x10_gap_probe")
def _(ws):
    return outliers.gap_probe(ws.category.baskets, 60, 3, ws.sizes("category"))


# --- exploration ---------------------------------------------------------------------------


@query("e01_class_tree")
def _(ws):
    return explore.class_tree(ws.classes)


@query("e02_items_per_class")
def _(ws):
    return explore.items_per_class(ws.classes, fixture.items(ws.spark, ws.sf_dir))


@query("e03_lines_per_class")
def _(ws):
    return explore.lines_per_class(ws.classes, ws.raw)


@query("e04_segment_share")
def _(ws):
    return explore.segment_share(ws.raw)


@query("e05_weekday_share")
def _(ws):
    return explore.weekday_share(ws.raw)


@query("e06_quantity_histogram")
def _(ws):
    return explore.quantity_histogram(ws.raw)


@query("e07_lines_per_day")
def _(ws):
    return explore.lines_per_day(ws.raw)


@query("e08_cart_size_histogram")
def _(ws):
    return explore.cart_size_histogram(ws.raw, 5)


@query("e09_unit_price_histogram")
def _(ws):
    return explore.unit_price_histogram(ws.raw)


@query("e10_basket_gap_histogram")
def _(ws):
    return explore.basket_gap_histogram(ws.category.baskets)


@query("e11_variety_in_repeat_categories")
def _(ws):
    return explore.variety_in_repeat_categories(ws.raw, 2)


@query("e12_customer_scatter_loyal")
def _(ws):
    return explore.customer_scatter(ws.raw, ws.category.baskets, fixture.FIXTURE_LOYAL)


@query("e12_customer_scatter_other")
def _(ws):
    return explore.customer_scatter(ws.raw, ws.category.baskets, ["FURNITURE", "HOUSEHOLD"])


@query("e13_cart_cost_by_segment")
def _(ws):
    return explore.cart_cost_by_segment(ws.raw)
