"""SQL for features, model inputs, preparation and evaluation."""

from __future__ import annotations

from repeatbuy.catalog.oracle import (
    GAPS, KEPT, LINES, OTLI, SQL, baskets, cat, clean, div, holdout, item, ksigma,
    numbered, of, rate, rnd, with_,
)
from repeatbuy.functions.fixed import (
    CATEGORY, CATEGORY_FEATURES, ITEM, ITEM_FEATURES, RATIO_FEATURES, REDUCED_FEATURES,
)
from repeatbuy.operators.evaluate import RECALLS, THRESHOLDS
from repeatbuy.sources.fixture import FIXTURE_GROUPS

GRAINS = {"item": ITEM, "cat": CATEGORY}
WHOLE = {
    "days_since_prior_order", "day_of_week", "user_unique_products", "user_total_products",
    "user_reordered_products", "user_unique_cats", "user_total_cats", "user_reordered_cats",
    "user_unique_classes", "user_reordered_classes", "u_p_orders_since_last",
    "u_t_orders_since_last", "u_c_orders_since_last", "max_streak", "max_streak_cat",
}


# --- building blocks -----------------------------------------------------------------------


def variety(key: str, flag: str, plural: str) -> str:
    again = f"count(DISTINCT CASE WHEN {flag} = 1 THEN {key} END)"
    return (f"count(DISTINCT {key}) AS user_unique_{plural}, {again} AS user_reordered_{plural}, "
            f"{div(again, f'count(DISTINCT {key})')} AS user_reordered_{plural}_ratio")


def users(grain, k: int, sigma: float | None = None) -> list[str]:
    """uf_k: customer features, for customers with a gap and a re-order in the history."""
    f = grain.flag
    names = ("user_reorder_rate", "user_total_products") if grain == ITEM else (
        "user_cat_reorder_rate", "user_total_cats")
    kinds = [("catid", "cats"), ("classid", "classes")]
    if grain == ITEM:
        kinds.insert(0, ("iid", "products"))
    cart = f"SELECT cid, bid, count(*) AS size FROM prior_{k} GROUP BY cid, bid"
    gap = f"SELECT cid, days_since_prior_order FROM hb_{k} WHERE days_since_prior_order IS NOT NULL"
    if sigma is not None:
        cart = ksigma(f"({cart})", "cid", "size", sigma)
        gap = ksigma(f"({gap})", "cid", "days_since_prior_order", sigma)
    return [f"""uf_{k} AS (
  SELECT * FROM (
    SELECT cid, avg({f}) AS {names[0]}, count(*) AS {names[1]},
           {', '.join(variety(key, f, plural) for key, plural in kinds)}
    FROM prior_{k} GROUP BY cid HAVING max({f}) = 1)
  JOIN (SELECT cid, avg(size) AS user_avg_cart_size FROM ({cart}) GROUP BY cid) USING (cid)
  JOIN (SELECT cid, avg(days_since_prior_order) AS days_between_orders FROM ({gap}) GROUP BY cid)
    USING (cid))"""]


def streak(src: str, keys: str, name: str, open_: bool = False) -> str:
    closed = "" if open_ else "AND run < breaks"
    return f"""SELECT {keys}, coalesce(max(steps), 0) AS {name} FROM (
  SELECT {keys}, run, count(*) FILTER (WHERE d = 1 {closed}) AS steps FROM (
    SELECT *, max(run) OVER (PARTITION BY {keys}) AS breaks FROM (
      SELECT *, sum(CASE WHEN d <> 1 THEN 1 ELSE 0 END)
               OVER (PARTITION BY {keys} ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, lead(ord) OVER (PARTITION BY {keys} ORDER BY rn) - ord AS d FROM (
          SELECT {keys}, ord, row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS rn FROM {src}))))
  GROUP BY {keys}, run) GROUP BY {keys}"""


def since_last(k: int, key: str, name: str) -> str:
    return f"""SELECT x.cid, x.{key}, y.top - x.at AS {name}
  FROM (SELECT cid, {key}, max(ord) AS at FROM num_{k} GROUP BY cid, {key}) x
  JOIN (SELECT cid, max(ord) AS top FROM num_{k} GROUP BY cid) y USING (cid)"""


def order_rate(k: int, key: str, name: str) -> str:
    return f"""SELECT cid, {key}, {div('n', 'm')} AS {name}
  FROM (SELECT cid, {key}, count(*) AS n FROM prior_{k} GROUP BY cid, {key})
  JOIN (SELECT cid, count(*) AS m FROM prior_{k} GROUP BY cid) USING (cid)"""


def share(k: int, within: str, by: str, name: str) -> str:
    return f"""SELECT {within}, {by}, {div('n', 'm')} AS {name}
  FROM (SELECT {within}, {by}, count(*) AS n FROM dsp_{k} GROUP BY {within}, {by})
  JOIN (SELECT {within}, count(*) AS m FROM dsp_{k} GROUP BY {within}) USING ({within})"""


WEEK = [("iid", "product_week_reorder_rate"), ("catid", "cat_week_reorder_rate"),
        ("classid", "class_week_reorder_rate")]
GAP = [("iid", "p_days_since_prior_order_reorder_rate"),
       ("catid", "t_days_since_prior_order_reorder_rate"),
       ("classid", "c_days_since_prior_order_reorder_rate"),
       ("cid", "u_days_since_prior_order_reorder_rate"),
       ("cid, iid", "u_p_days_since_prior_reorder_rate"),
       ("cid, catid", "u_t_days_since_prior_reorder_rate"),
       ("cid, classid", "u_c_days_since_prior_reorder_rate")]


def gapped(k: int) -> str:
    return f"""gapped_{k} AS (
  SELECT *, lag(days) OVER w - days AS since, days - lead(days) OVER w AS nxt FROM prior_{k}
  WINDOW w AS (PARTITION BY cid, catid ORDER BY checkoutdate, bid, classid))"""


def price_day(k: int, keys: str, name: str, zero: str, sigma: float | None = None) -> str:
    days = "nullif(nxt, 0)" if zero == "null" else "CASE WHEN nxt = 0 THEN 1 ELSE nxt END"
    rows = f"SELECT {keys}, price / CAST({days} AS DOUBLE) AS v FROM gapped_{k}"
    if sigma is not None:
        rows = ksigma(f"({rows})", keys, "v", sigma)
    mean = "coalesce(avg(v), 0)" if zero == "null" else "avg(v)"
    return f"SELECT {keys}, {mean} AS {name} FROM ({rows}) GROUP BY {keys}"


def since_price(k: int) -> str:
    return f"""SELECT cid, catid, price / (days + CAST(0.4 AS DOUBLE)) AS user_days_price_ratio_since_prior
  FROM prior_{k} QUALIFY row_number() OVER (
    PARTITION BY cid, catid ORDER BY checkoutdate DESC, bid DESC, classid DESC) = 1"""


def cat_days(k: int, sigma: float | None = None) -> str:
    rows = f"SELECT catid, since FROM gapped_{k}"
    usual = "SELECT avg(m) FROM means"
    if sigma is not None:
        rows = ksigma(f"({rows})", "catid", "since", sigma)
        usual += f""" WHERE (SELECT count(*) FROM means) = 1
    OR m <= (SELECT avg(m) + {sigma} * stddev_samp(m) FROM means)"""
    return f"""SELECT catid, coalesce(m, ({usual})) AS days_between_cat_orders
  FROM (WITH means AS (SELECT catid, avg(since) AS m FROM ({rows}) GROUP BY catid)
        SELECT catid, m, ({usual}) AS u FROM means)""".replace(
        f"coalesce(m, ({usual}))", "coalesce(m, u)")


def pair_days(k: int, sigma: float | None = None) -> str:
    rows = f"SELECT cid, catid, since FROM gapped_{k}"
    if sigma is not None:
        rows = ksigma(f"({rows})", "cid, catid", "since", sigma)
    return f"SELECT cid, catid, avg(since) AS days_between_user_cat_orders FROM ({rows}) GROUP BY cid, catid"


# --- single features -----------------------------------------------------------------------


def final(ctes: list[str], select: str, *floats: str) -> str:
    """Last step: round the named columns, keep the others."""
    replace = ", ".join(rnd(c) for c in floats)
    return with_(ctes, f"SELECT * REPLACE ({replace}) FROM ({select})")


for _s, _g in GRAINS.items():
    _h, _f = of(_g), _g.flag
    _rate = "user_reorder_rate" if _s == "item" else "user_cat_reorder_rate"
    _total = "user_total_products" if _s == "item" else "user_total_cats"
    SQL[f"f01_user_reorder_rate_{_s}"] = final(_h, rate("prior_1", "cid", _f, _rate), _rate)
    SQL["f03_user_total_products_item" if _s == "item" else "f03_user_total_cats_cat"] = with_(
        _h, f"SELECT cid, count(*) AS {_total} FROM prior_1 GROUP BY cid")
    SQL[f"f04_user_avg_cart_size_{_s}"] = final(_h, """
SELECT cid, avg(n) AS user_avg_cart_size FROM (
  SELECT cid, bid, count(*) AS n FROM prior_1 GROUP BY cid, bid) GROUP BY cid""", "user_avg_cart_size")
    SQL[f"f05_days_between_orders_{_s}"] = final(_h, """
SELECT cid, avg(days_since_prior_order) AS days_between_orders FROM hb_1
WHERE days_since_prior_order IS NOT NULL GROUP BY cid""", "days_between_orders")
    for _n, _key, _plural in (("f07", "catid", "cats"), ("f08", "classid", "classes")):
        SQL[f"{_n}_user_reordered_{_plural}_{_s}"] = final(_h, f"""
SELECT * EXCLUDE (user_unique_{_plural}) FROM (
  SELECT cid, {variety(_key, _f, _plural)} FROM prior_1 GROUP BY cid)""",
            f"user_reordered_{_plural}_ratio")
    _ratios = ["user_reordered_cats_ratio", "user_reordered_classes_ratio", "user_avg_cart_size",
               "days_between_orders", _rate]
    if _s == "item":
        _ratios.append("user_reordered_products_ratio")
    SQL[f"f09_user_features_{_s}"] = final(_h + users(_g, 1), "SELECT * FROM uf_1", *_ratios)
    SQL[f"f11_cat_reorder_rate_{_s}"] = final(
        _h, rate("prior_1", "catid", "cat_reordered", "cat_reorder_rate"), "cat_reorder_rate")
    _p = "u_p" if _s == "item" else "u_t"
    SQL[f"f14_order_rate_{_s}"] = final(
        _h, order_rate(1, _g.key, f"{_p}_order_rate"), f"{_p}_order_rate")
    SQL[f"f15_reorder_rate_{_s}"] = final(
        _h, rate("prior_1", f"cid, {_g.key}", _f, f"{_p}_reorder_rate"), f"{_p}_reorder_rate")
    SQL[f"f17_u_t_orders_since_last_{_s}"] = with_(
        _h, since_last(1, "catid", "u_t_orders_since_last"))
    SQL[f"f18_u_c_orders_since_last_{_s}"] = with_(
        _h, since_last(1, "classid", "u_c_orders_since_last"))
    for _n, (_key, _name) in zip(("f22", "f23", "f24"), WEEK):
        if _key != "iid" or _s == "item":
            _q = f"{_n}_{_name}" + ("" if _key == "iid" else f"_{_s}")
            SQL[_q] = final(_h, share(1, _key, "day_of_week", _name), _name)
    for _n, (_key, _name) in zip(("f25", "f26", "f27", "f28", "f29", "f30", "f31"), GAP):
        if "iid" not in _key or _s == "item":
            _q = f"{_n}_{_name}" + ("" if "iid" in _key else f"_{_s}")
            SQL[_q] = final(_h, share(1, _key, "days_since_prior_order", _name), _name)

for _key, _plural in (("iid", "products"), ("catid", "cats"), ("classid", "classes")):
    SQL[f"f02_user_unique_{_plural}"] = with_(item(), f"""
SELECT cid, count(DISTINCT {_key}) AS user_unique_{_plural} FROM prior_1 GROUP BY cid""")
SQL["f06_user_reordered_products"] = final(item(), f"""
SELECT * EXCLUDE (user_unique_products) FROM (
  SELECT cid, {variety('iid', 'reordered', 'products')} FROM prior_1 GROUP BY cid)""",
    "user_reordered_products_ratio")
SQL["f10_product_reorder_rate"] = final(
    item(), rate("prior_1", "iid", "reordered", "product_reorder_rate"), "product_reorder_rate")
SQL["f12_class_flags"] = with_([LINES], "SELECT DISTINCT iid, classid, " + ", ".join(
    f"CASE WHEN classid IN ({', '.join(repr(v) for v in ids)}) THEN 1 ELSE 0 END AS {name}"
    for name, ids in FIXTURE_GROUPS.items()) + " FROM lines")
SQL["f16_u_p_orders_since_last"] = with_(item(), since_last(1, "iid", "u_p_orders_since_last"))
SQL["f19_max_streak"] = with_(item(), streak("num_1", "cid, iid", "max_streak"))
SQL["f19_max_streak_cat_item"] = with_(item(), streak("num_1", "cid, catid", "max_streak_cat"))
SQL["f19_max_streak_cat_cat"] = with_(cat(), streak("num_1", "cid, catid", "max_streak_cat"))
SQL["f19_max_streak_class_open"] = with_(
    cat(), streak("num_1", "cid, classid", "max_streak_class", True))
_LATEST = """(SELECT cid, {key}, {ids} FROM prior_1 QUALIFY row_number() OVER (
  PARTITION BY cid, {key} ORDER BY checkoutdate DESC, bid DESC) = 1)"""
SQL["f20_user_product_features"] = final(item(), f"""
SELECT cid, iid, u_p_order_rate, u_p_reorder_rate, u_p_orders_since_last, u_t_orders_since_last,
       u_c_orders_since_last, max_streak
FROM ({order_rate(1, 'iid', 'u_p_order_rate')})
JOIN ({rate('prior_1', 'cid, iid', 'reordered', 'u_p_reorder_rate')}) USING (cid, iid)
JOIN ({since_last(1, 'iid', 'u_p_orders_since_last')}) USING (cid, iid)
JOIN ({streak('num_1', 'cid, iid', 'max_streak')}) USING (cid, iid)
JOIN {_LATEST.format(key='iid', ids='catid, classid')} USING (cid, iid)
JOIN ({since_last(1, 'catid', 'u_t_orders_since_last')}) USING (cid, catid)
JOIN ({since_last(1, 'classid', 'u_c_orders_since_last')}) USING (cid, classid)""",
    "u_p_order_rate", "u_p_reorder_rate")
_CAT_PAIR = f"""({order_rate(1, 'catid', 'u_t_order_rate')})
JOIN ({rate('prior_1', 'cid, catid', 'cat_reordered', 'u_t_reorder_rate')}) USING (cid, catid)
JOIN ({streak('num_1', 'cid, catid', 'max_streak_cat')}) USING (cid, catid)"""
SQL["f21_user_cat_features_item"] = final(
    item(), f"SELECT * FROM {_CAT_PAIR}", "u_t_order_rate", "u_t_reorder_rate")
SQL["f21_user_cat_features_cat"] = final(cat(), f"""
SELECT cid, catid, u_t_order_rate, u_t_reorder_rate, u_t_orders_since_last, u_c_orders_since_last,
       max_streak_cat FROM {_CAT_PAIR}
JOIN ({since_last(1, 'catid', 'u_t_orders_since_last')}) USING (cid, catid)
JOIN {_LATEST.format(key='catid', ids='classid')} USING (cid, catid)
JOIN ({since_last(1, 'classid', 'u_c_orders_since_last')}) USING (cid, classid)""",
    "u_t_order_rate", "u_t_reorder_rate")
PRICE = cat() + [gapped(1)]
for _v, _zero in (("v1", "null"), ("v2", "one")):
    for _n, _keys, _name in (("f32", "catid", "ave_price_day_ratio"),
                             ("f33", "cid, catid", "user_ave_price_day_ratio")):
        SQL[f"{_n}_{_name}_{_v}"] = final(PRICE, price_day(1, _keys, _name, _zero), _name)
SQL["f34_user_days_price_ratio_since_prior"] = final(
    PRICE, since_price(1), "user_days_price_ratio_since_prior")
SQL["f35_days_between_cat_orders"] = final(PRICE, cat_days(1), "days_between_cat_orders")
SQL["f36_days_between_user_cat_orders"] = final(
    PRICE, pair_days(1), "days_between_user_cat_orders")

# --- cleaning counts on price features -----------------------------------------------------

_PRICES = f"""({price_day(1, 'cid, catid', 'user_ave_price_day_ratio', 'null')})
JOIN ({since_price(1)}) USING (cid, catid)"""
SQL["c22_zero_counts"] = with_(PRICE, f"""
SELECT count(*) FILTER (WHERE user_ave_price_day_ratio = 0) AS user_ave_price_day_ratio,
       count(*) FILTER (WHERE user_days_price_ratio_since_prior = 0) AS user_days_price_ratio_since_prior
FROM {_PRICES}""")
SQL["c23_inf_counts"] = with_(PRICE, f"""
SELECT count(*) FILTER (WHERE isinf(user_ave_price_day_ratio)) AS user_ave_price_day_ratio,
       count(*) FILTER (WHERE isinf(user_days_price_ratio_since_prior)) AS user_days_price_ratio_since_prior
FROM {_PRICES}""")
SQL["c24_zero_to_one"] = with_(clean(CATEGORY) + [baskets("e", "b")], """
SELECT cid, bid, CAST(CASE WHEN days_since_prior_order = 0 THEN 1 ELSE days_since_prior_order END
  AS DOUBLE) AS gap FROM b""")
SQL["c25_row_audit"] = with_(clean(CATEGORY) + holdout(CATEGORY, 1) + [
    "often AS (SELECT * FROM lines WHERE cid IN (SELECT cid FROM lines GROUP BY cid HAVING count(DISTINCT bid) > 8))",
    "counts AS (SELECT classid, count(*) AS rep FROM often GROUP BY classid)"], """
SELECT 'raw' AS stage, count(*) AS rows FROM lines
UNION ALL SELECT 'valid', count(*) FROM lines WHERE price > 5000 AND quantity > 0
UNION ALL SELECT 'popular', count(*) FROM often WHERE classid NOT IN (SELECT classid FROM counts WHERE rep < 10000)
UNION ALL SELECT 'rolled', count(*) FROM (SELECT DISTINCT bid, cid, checkoutdate, classid, catid,
  segmentationlabel, days, marketid FROM lines)
UNION ALL SELECT 'labels', count(*) FROM label_1""")
SQL["j02_left_equi"] = final(item(), f"""
SELECT c.* EXCLUDE (checkoutdate), w.product_week_reorder_rate FROM context_1 c
LEFT JOIN ({share(1, 'iid', 'day_of_week', 'product_week_reorder_rate')}) w USING (iid, day_of_week)""",
    "product_week_reorder_rate")

# --- k-sigma -------------------------------------------------------------------------------

SQL["x08_ksigma_features_user"] = final(
    cat() + users(CATEGORY, 1, 2), "SELECT * FROM uf_1", "user_cat_reorder_rate",
    "user_reordered_cats_ratio", "user_reordered_classes_ratio", "user_avg_cart_size",
    "days_between_orders")
SQL["x08_ksigma_features_cat"] = final(PRICE, f"""
SELECT * FROM ({price_day(1, 'catid', 'ave_price_day_ratio', 'one', 2)})
JOIN ({cat_days(1, 2)}) USING (catid)""", "ave_price_day_ratio", "days_between_cat_orders")
SQL["x08_ksigma_features_user_cat"] = final(PRICE, f"""
SELECT * FROM ({price_day(1, 'cid, catid', 'user_ave_price_day_ratio', 'one', 2)})
JOIN ({pair_days(1, 2)}) USING (cid, catid)""",
    "user_ave_price_day_ratio", "days_between_user_cat_orders")

# --- model inputs --------------------------------------------------------------------------


def shares(k: int, keys: list[str]) -> str:
    """Left joins of every weekday and gap share."""
    out = ""
    for key, name in WEEK:
        if key in keys:
            out += f"\nLEFT JOIN ({share(k, key, 'day_of_week', name)}) USING ({key}, day_of_week)"
    for key, name in GAP:
        if key.split(", ")[-1] in [*keys, "cid"]:
            out += (f"\nLEFT JOIN ({share(k, key, 'days_since_prior_order', name)}) "
                    f"USING ({key}, days_since_prior_order)")
    return out


def filled(features, alias="") -> str:
    return ", ".join(
        f"coalesce({f}, 0) AS {f}" if f in WHOLE else rnd(f"coalesce({f}, 0)", f) for f in features
    )


def exact(features) -> list[str]:
    return [f for f in features if not f.startswith("p_reduced")]


def input_item(k: int) -> str:
    ctes = item(k) + users(ITEM, k)
    return with_(ctes, f"""
SELECT cid, bid, iid, catid, classid, reorder_label, checkoutdate, {filled(exact(ITEM_FEATURES))}
FROM context_{k} JOIN uf_{k} USING (cid){shares(k, ['iid', 'catid', 'classid'])}
JOIN ({rate(f'prior_{k}', 'iid', 'reordered', 'product_reorder_rate')}) USING (iid)
JOIN ({rate(f'prior_{k}', 'catid', 'cat_reordered', 'cat_reorder_rate')}) USING (catid)
JOIN ({order_rate(k, 'iid', 'u_p_order_rate')}) USING (cid, iid)
JOIN ({rate(f'prior_{k}', 'cid, iid', 'reordered', 'u_p_reorder_rate')}) USING (cid, iid)
JOIN ({since_last(k, 'iid', 'u_p_orders_since_last')}) USING (cid, iid)
JOIN ({since_last(k, 'catid', 'u_t_orders_since_last')}) USING (cid, catid)
JOIN ({since_last(k, 'classid', 'u_c_orders_since_last')}) USING (cid, classid)
JOIN ({streak(f'num_{k}', 'cid, iid', 'max_streak')}) USING (cid, iid)
JOIN ({order_rate(k, 'catid', 'u_t_order_rate')}) USING (cid, catid)
JOIN ({rate(f'prior_{k}', 'cid, catid', 'cat_reordered', 'u_t_reorder_rate')}) USING (cid, catid)
JOIN ({streak(f'num_{k}', 'cid, catid', 'max_streak_cat')}) USING (cid, catid)""")


def category_from(k: int, zero: str, sigma: float | None = None, intervals: bool = False) -> str:
    more = f"""
JOIN ({cat_days(k, sigma)}) USING (catid)
JOIN ({pair_days(k, sigma)}) USING (cid, catid)""" if intervals else ""
    return f"""FROM context_{k} JOIN uf_{k} USING (cid){shares(k, ['catid', 'classid'])}
JOIN ({price_day(k, 'catid', 'ave_price_day_ratio', zero, sigma)}) USING (catid)
JOIN ({rate(f'prior_{k}', 'catid', 'cat_reordered', 'cat_reorder_rate')}) USING (catid)
JOIN ({order_rate(k, 'catid', 'u_t_order_rate')}) USING (cid, catid)
JOIN ({rate(f'prior_{k}', 'cid, catid', 'cat_reordered', 'u_t_reorder_rate')}) USING (cid, catid)
JOIN ({price_day(k, 'cid, catid', 'user_ave_price_day_ratio', zero, sigma)}) USING (cid, catid)
JOIN ({since_price(k)}) USING (cid, catid)
JOIN ({since_last(k, 'catid', 'u_t_orders_since_last')}) USING (cid, catid)
JOIN ({since_last(k, 'classid', 'u_c_orders_since_last')}) USING (cid, classid)
JOIN ({streak(f'num_{k}', 'cid, catid', 'max_streak_cat')}) USING (cid, catid){more}"""


def input_category(k: int) -> str:
    return with_(cat(k) + [gapped(k)] + users(CATEGORY, k), f"""
SELECT cid, bid, catid, classid, reorder_label, checkoutdate, {filled(exact(CATEGORY_FEATURES))}
{category_from(k, 'null')}""")


def stacked(start: list[str], src: str, sigma: float | None = None, otli: int | None = None,
            constant: bool = False) -> tuple[list[str], str]:
    """(steps, columns) of the stacked input; the last step is ``done``."""
    ctes = start + holdout(CATEGORY, 3, src)
    base = exact(CATEGORY_FEATURES)
    ids = "cid, bid, catid, classid, reorder_label, checkoutdate"
    for k in (1, 2, 3):
        ctes += [baskets(f"prior_{k}", f"hb_{k}"), numbered(k), gapped(k), *users(CATEGORY, k, sigma)]
        ctes.append(f"""frame_{k} AS (
SELECT {ids}, {', '.join(base)}, days_between_cat_orders, days_between_user_cat_orders,
       '{'test' if k == 1 else 'train'}' AS split
{category_from(k, 'one', sigma, True)})""")
    overall = "(SELECT avg(ave_price_day_ratio) FROM frame_2)"
    mean = overall if constant else f"coalesce(ave_price_day_ratio, {overall})"

    def one(c):
        return f"CASE WHEN {c} = 0 THEN 1 ELSE {c} END"

    ctes.append(f"""joint AS (
  SELECT * REPLACE ({mean} AS ave_price_day_ratio,
    {one('days_between_orders')} AS days_between_orders,
    {one('days_between_cat_orders')} AS days_between_cat_orders,
    {one('days_between_user_cat_orders')} AS days_between_user_cat_orders)
  FROM (SELECT * FROM frame_1 UNION ALL SELECT * FROM frame_2 UNION ALL SELECT * FROM frame_3))""")
    rest = [c for c in base if c not in ("ave_price_day_ratio", "user_ave_price_day_ratio")]
    ctes.append(f"""full_ AS (
  SELECT {ids}, split, {', '.join(f'coalesce({c}, 0) AS {c}' for c in rest)},
         coalesce(ave_price_day_ratio, 0) AS ave_price_day_ratio,
         coalesce(user_ave_price_day_ratio, ave_price_day_ratio, 0) AS user_ave_price_day_ratio,
         coalesce(days_between_cat_orders, 0) AS days_between_cat_orders,
         coalesce(days_between_user_cat_orders, days_between_cat_orders, 0) AS days_between_user_cat_orders
  FROM joint)""")
    gap, dpr = "days_since_prior_order", "user_days_price_ratio_since_prior"
    cut = f"WHERE {gap} <= {otli}" if otli is not None else ""
    ctes.append(f"""done AS (
  SELECT *, {div(gap, 'days_between_orders')} AS since_prior_days_ratio,
         {div(gap, 'days_between_cat_orders')} AS since_prior_days_cat_ratio,
         {div(gap, 'days_between_user_cat_orders')} AS since_prior_days_user_cat_ratio,
         {div('user_unique_cats', 'user_total_cats')} AS user_unique_cat_ratio,
         {div(dpr, 'user_ave_price_day_ratio')} AS user_DPR_user_ratio,
         {div(dpr, 'ave_price_day_ratio')} AS user_DPR_tot_ratio FROM full_ {cut})""")
    every = [*base, "days_between_cat_orders", "days_between_user_cat_orders", *RATIO_FEATURES]
    columns = ", ".join(c if c in WHOLE else rnd(c) for c in every)
    return ctes, f"SELECT {ids}, split, {columns} FROM done"


SQL["h08_model_input_item"] = input_item(1)
SQL["h08_model_input_item_train"] = input_item(2)
SQL["h09_model_input_category"] = input_category(1)
SQL["h09_model_input_category_train"] = input_category(2)
_CTES, _ALL = stacked(clean(CATEGORY), "e")
SQL["h10_model_input_stacked"] = with_(_CTES, _ALL)
SQL["f37_ratio_features"] = with_(_CTES, "SELECT cid, catid, " + ", ".join(
    rnd(c) for c in RATIO_FEATURES) + " FROM done WHERE split = 'test'")
SQL["f38_fill_hierarchical"] = with_(_CTES, "SELECT cid, bid, catid, " + ", ".join(
    rnd(c) for c in ("days_between_user_cat_orders", "user_ave_price_day_ratio",
                     "ave_price_day_ratio")) + " FROM done WHERE split = 'train'")
_CONST, _ = stacked(clean(CATEGORY), "e", constant=True)
SQL["f38_fill_constant"] = with_(_CONST, "SELECT cid, bid, catid, split, " + ", ".join(
    rnd(c) for c in ("ave_price_day_ratio", "user_DPR_tot_ratio")) + " FROM done")
_WITHOUT, _ALL4 = stacked(
    clean(CATEGORY, 4) + GAPS[len(clean(CATEGORY)):] + [f"kept AS (SELECT * FROM e {KEPT})"],
    "kept", 2, OTLI)
SQL["x09_stacked_without_outliers"] = with_(_WITHOUT, _ALL4)
SQL["x09_parameter_grid"] = with_(_WITHOUT, f"""
SELECT '1' AS run, CAST(2 AS DOUBLE) AS ksigma, {OTLI} AS otli, 4 AS least_orders,
       count(*) FILTER (WHERE split = 'train') AS train_rows,
       count(*) FILTER (WHERE split = 'test') AS test_rows FROM done""")

# --- preparation ---------------------------------------------------------------------------

_SCALE = cat(2) + [f"""s AS (
  SELECT cid, catid, days_since_prior_order, u_t_lines, u_t_reorder_rate, u_t_orders_since_last
  FROM context_2 JOIN (SELECT cid, catid, count(*) AS u_t_lines, avg(cat_reordered) AS u_t_reorder_rate
    FROM prior_2 GROUP BY cid, catid) USING (cid, catid)
  JOIN ({since_last(2, 'catid', 'u_t_orders_since_last')}) USING (cid, catid))"""]
_COLS = ("days_since_prior_order", "u_t_lines", "u_t_reorder_rate", "u_t_orders_since_last")
SQL["p02_standard_scale"] = with_(_SCALE, "SELECT cid, catid, " + ", ".join(
    rnd(f"({c} - (SELECT avg({c}) FROM s)) / (SELECT stddev_pop({c}) FROM s)", c) for c in _COLS)
    + " FROM s")
SQL["p03_max_scale"] = with_(_SCALE, "SELECT cid, catid, " + ", ".join(
    rnd(f"{c} / (SELECT max({c}) FROM s)", c) for c in _COLS) + " FROM s")

_BAYES = cat(2) + [f"""s AS (
  SELECT cid, catid, reorder_label AS y, days_since_prior_order, u_t_lines, u_t_reorder_rate, u_t_orders_since_last
  FROM context_2 JOIN (SELECT cid, catid, count(*) AS u_t_lines, avg(cat_reordered) AS u_t_reorder_rate
    FROM prior_2 GROUP BY cid, catid) USING (cid, catid)
  JOIN ({since_last(2, 'catid', 'u_t_orders_since_last')}) USING (cid, catid))""",
    "bayes_eps AS (SELECT 0.01 * greatest(" + ", ".join(f"var_pop({c})" for c in _COLS) + ") AS eps FROM s)",
    "moments AS (SELECT y, count(*) AS n, " + ", ".join(
        f"avg({c}) AS m_{c}, var_pop({c}) + (SELECT eps FROM bayes_eps) AS v_{c}" for c in _COLS) + " FROM s GROUP BY y)",
    "likelihoods AS (SELECT s.cid, s.catid, s.y, m.y AS k, ln(n / (SELECT count(*) FROM s)) - 0.5 * (" + " + ".join(
        f"ln(2 * pi() * v_{c}) + (s.{c} - m_{c}) * (s.{c} - m_{c}) / v_{c}" for c in _COLS) + ") AS f FROM s CROSS JOIN moments AS m)",
    """posteriors AS (SELECT cid, catid, y, 1 / (1 + exp(max(f) FILTER (WHERE k = 0) - max(f) FILTER (WHERE k = 1))) AS q
  FROM likelihoods GROUP BY cid, catid, y)""",
]
SQL["m02_gaussian_nb_smoothed"] = with_(_BAYES, f"""
SELECT cid, catid, y AS y_test, {rnd('q', 'y_test_prob')}, CASE WHEN q > 0.5 THEN 1 ELSE 0 END AS y_test_prediction FROM posteriors""")

_TRAIN = " + ".join(
    f"(SELECT count(*) FROM ({input_category(k)}) WHERE reorder_label = 0{cond})"
    for k, cond in ((2, ""), (1, " AND (cid * 7919 + 104729) % 1000 < 700")))
SQL["s09_write_balanced"] = f"""
SELECT CAST(k AS INTEGER) AS reorder_label, {_TRAIN} AS rows FROM (VALUES (0), (1)) v(k)"""

SQL["p05_reduced_features_fixed"] = with_(_CTES, """
SELECT cid, catid, CAST(reorder_label AS DOUBLE) AS reorder_label, """ + ", ".join(
    rnd(f"coalesce({c}, 0)", c) for c in REDUCED_FEATURES) + " FROM done WHERE split = 'test'")

# --- evaluation on the fixed score ---------------------------------------------------------

_SCORED = cat() + [f"""p AS (
  SELECT cid, catid, reorder_label AS y, u_t_reorder_rate AS s,
         CASE WHEN u_t_reorder_rate > 0.5 THEN 1 ELSE 0 END AS d
  FROM label_1 JOIN ({rate('prior_1', 'cid, catid', 'cat_reordered', 'u_t_reorder_rate')})
    USING (cid, catid))"""]


def f1(hit: str) -> str:
    return f"""coalesce(2.0 * count(*) FILTER (WHERE {hit} AND y = 1)
  / nullif(2.0 * count(*) FILTER (WHERE {hit} AND y = 1) + count(*) FILTER (WHERE {hit} AND y = 0)
    + count(*) FILTER (WHERE NOT ({hit}) AND y = 1), 0), 0)"""


SQL["v02_apply_threshold"] = with_(_SCORED, f"""
SELECT cid, catid, y AS y_test, {rnd('s', 'y_test_prob')}, d AS y_test_prediction,
       CASE WHEN s > 0.25 THEN 1 ELSE 0 END AS predicted FROM p""")
_VALUES = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in THRESHOLDS)
_CURVE = f"""SELECT t AS threshold, {f1('s > t')} AS f1
FROM (SELECT * FROM p, (VALUES {_VALUES}) v(t)) GROUP BY t"""
SQL["v03_threshold_scores"] = with_(
    _SCORED, f"SELECT {rnd('threshold')}, {rnd('f1')} FROM ({_CURVE})")
SQL["v03_best_threshold"] = with_(_SCORED, f"""
, best AS (SELECT threshold, f1 FROM ({_CURVE}) ORDER BY f1 DESC, threshold LIMIT 1),
dflt AS (SELECT {f1('d = 1')} AS f1_default FROM p)
SELECT CASE WHEN f1_default > f1 THEN 'pred' ELSE 'prob' END AS kind, {rnd('threshold')},
       {rnd('f1', 'f1_threshold')}, {rnd('f1_default')} FROM best, dflt""".lstrip()).replace("\n, best", ",\nbest")
SQL["v04_confusion_matrix"] = with_(
    _SCORED, "SELECT y AS actual, d AS predicted, count(*) AS rows FROM p GROUP BY y, d")
_PER = """per AS (SELECT k, coalesce(tp / nullif(said, 0), 0) AS p_, coalesce(tp / nullif(sup, 0), 0) AS r_,
    coalesce(2 * tp / nullif(said + sup, 0), 0) AS f_, sup, tp FROM (
  SELECT k, CAST(count(*) FILTER (WHERE y = k AND d = k) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE d = k) AS DOUBLE) AS said,
         count(*) FILTER (WHERE y = k) AS sup
  FROM p, (VALUES (0), (1)) v(k) GROUP BY k))"""
SQL["v05_classification_report"] = with_(_SCORED + [_PER], f"""
SELECT CAST(k AS VARCHAR) AS label, {rnd('p_', 'precision')}, {rnd('r_', 'recall')}, {rnd('f_', 'f1')},
       sup AS support FROM per
UNION ALL SELECT 'accuracy', {rnd('sum(tp) / sum(sup)', 'x')}, {rnd('sum(tp) / sum(sup)', 'x')},
       {rnd('sum(tp) / sum(sup)', 'x')}, CAST(sum(sup) AS BIGINT) FROM per
UNION ALL SELECT 'macro avg', {rnd('avg(p_)', 'x')}, {rnd('avg(r_)', 'x')}, {rnd('avg(f_)', 'x')},
       CAST(sum(sup) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', {rnd('sum(p_ * sup) / sum(sup)', 'x')}, {rnd('sum(r_ * sup) / sum(sup)', 'x')},
       {rnd('sum(f_ * sup) / sum(sup)', 'x')}, CAST(sum(sup) AS BIGINT) FROM per""")
_TARGETS = ", ".join(f"(CAST({r!r} AS DOUBLE))" for r in RECALLS)
SQL["v08_precision_at_recall"] = with_(_SCORED + [
    "steps AS (SELECT CASE WHEN i = 0 THEN -1e-7 WHEN i = 199 THEN 1 + 1e-7 ELSE i / 199 END AS t "
    "FROM range(200) r(i))",
    """curve AS (SELECT t, count(*) FILTER (WHERE y = 1) AS tp, count(*) AS said
  FROM p JOIN steps ON s > t GROUP BY t)"""], f"""
SELECT CAST(target AS DOUBLE) AS recall_target, {rnd('''coalesce(max(CASE WHEN tp / (SELECT count(*) FROM p WHERE y = 1) >= target
  THEN tp / said END), 0)''', 'precision')}
FROM curve, (VALUES {_TARGETS}) v(target) GROUP BY target""")
