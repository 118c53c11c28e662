"""Grains, source column names, class groups and model feature lists."""

from __future__ import annotations

from typing import NamedTuple


class Grain(NamedTuple):
    """What a row of the model stands for: the product key and its re-order flag."""

    key: str
    flag: str


ITEM = Grain("iid", "reordered")
CATEGORY = Grain("catid", "cat_reordered")

# Source column -> canonical column.
ORDER_COLUMNS = {
    "id": "bid",
    "id.1": "cid",
    "id.2": "catid",
    "categoryid": "classid",
    "id.3": "iid",
    "quantitystepcount": "quantity",
    "totaloriginalprice": "price",
    "?column?": "days",
}
CLASS_COLUMNS = {"id": "classid", "name": "class_name"}
CATEGORY_COLUMNS = {"id": "catid", "name": "cat_name"}
ITEM_COLUMNS = {
    "id": "iid",
    "name": "item_name",
    "categoryid": "classid",
    "typeid": "catid",
    "id.1": "brandid",
    "name.1": "brand_name",
}

# Class ids of the seven product groups.
CLASS_GROUPS = {
    "is_milk": [51],
    "is_summer_produce": [57],
    "is_fruit": [21],
    "is_dairy": [2, 55],
    "is_protein": [156, 68],
    "is_snack": [131, 132, 133],
    "is_staple": [9, 45, 92, 69, 71],
}

REQUIRED = ["classid", "catid", "iid", "quantity", "price", "marketid"]
LOYAL_LABELS = ["champion", "loyal"]
NO_LABEL = "unlabeled"
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Columns that identify a category line when item lines are rolled up.
ROLLUP_KEYS = [
    "bid", "cid", "checkoutdate", "classid", "catid", "segmentationlabel", "days", "marketid",
]

LABEL = "reorder_label"

# Model features at item grain.
ITEM_FEATURES = [
    "days_since_prior_order", "day_of_week", "user_reorder_rate",
    "user_unique_products", "user_total_products", "user_avg_cart_size",
    "days_between_orders", "user_reordered_products", "user_reordered_products_ratio",
    "user_unique_cats", "user_reordered_cats", "user_reordered_cats_ratio",
    "user_unique_classes", "user_reordered_classes", "user_reordered_classes_ratio",
    "product_week_reorder_rate", "cat_week_reorder_rate", "class_week_reorder_rate",
    "p_days_since_prior_order_reorder_rate", "t_days_since_prior_order_reorder_rate",
    "c_days_since_prior_order_reorder_rate", "u_days_since_prior_order_reorder_rate",
    "u_p_days_since_prior_reorder_rate", "u_t_days_since_prior_reorder_rate",
    "u_c_days_since_prior_reorder_rate", "product_reorder_rate",
    "p_reduced_feat_1", "p_reduced_feat_2", "p_reduced_feat_3",
    "u_p_order_rate", "u_p_reorder_rate", "u_p_orders_since_last",
    "u_t_orders_since_last", "u_c_orders_since_last", "max_streak", "max_streak_cat",
    "cat_reorder_rate", "u_t_order_rate", "u_t_reorder_rate",
]

# Model features at category grain.
CATEGORY_FEATURES = [
    "days_since_prior_order", "day_of_week", "user_cat_reorder_rate",
    "user_total_cats", "user_avg_cart_size", "days_between_orders",
    "user_unique_cats", "user_reordered_cats", "user_ave_price_day_ratio",
    "user_days_price_ratio_since_prior", "user_reordered_cats_ratio",
    "user_unique_classes", "user_reordered_classes", "user_reordered_classes_ratio",
    "cat_week_reorder_rate", "class_week_reorder_rate",
    "t_days_since_prior_order_reorder_rate", "ave_price_day_ratio",
    "c_days_since_prior_order_reorder_rate", "u_days_since_prior_order_reorder_rate",
    "u_t_days_since_prior_reorder_rate", "u_c_days_since_prior_reorder_rate",
    "cat_reorder_rate", "p_reduced_feat_1", "p_reduced_feat_2", "p_reduced_feat_3",
    "u_t_order_rate", "u_t_reorder_rate", "u_t_orders_since_last",
    "u_c_orders_since_last", "max_streak_cat",
]

# Ratio features added by the stacked category model.
RATIO_FEATURES = [
    "since_prior_days_ratio", "since_prior_days_cat_ratio", "since_prior_days_user_cat_ratio",
    "user_unique_cat_ratio", "user_DPR_user_ratio", "user_DPR_tot_ratio",
]
STACKED_FEATURES = CATEGORY_FEATURES + [
    "days_between_cat_orders", "days_between_user_cat_orders",
] + RATIO_FEATURES

# The reduced list picked from boosted-tree importance.
REDUCED_FEATURES = [
    "days_since_prior_order", "day_of_week", "user_avg_cart_size", "user_unique_classes",
    "user_reordered_classes", "class_week_reorder_rate",
    "t_days_since_prior_order_reorder_rate", "days_between_cat_orders", "cat_reorder_rate",
    "u_t_reorder_rate", "u_t_orders_since_last", "u_c_orders_since_last", "max_streak_cat",
    "since_prior_days_user_cat_ratio", "user_DPR_user_ratio",
]
