"""SQL that checks the queries, written from the definitions of the operators.

Each text is a chain of common table expressions over the source tables. Holdouts are built step by
step (take the last basket away, repeat), shares are joined on (key, gap), windows are plain; none of
it follows the shape of the Spark jobs.
"""

from __future__ import annotations

from repeatbuy.functions.fixed import CATEGORY, ITEM
from repeatbuy.sources.fixture import FIXTURE_LOYAL

OTLI, RARE, MIN_PRICE = 365, 10000, 5000
CORE = "cid, bid, iid, catid, classid, quantity, price"
SQL: dict[str, str] = {}


def rnd(expr: str, name: str | None = None) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {name or expr}"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- shared steps --------------------------------------------------------------------------

LINES = """lines AS (
  SELECT o_custkey AS cid, o_orderkey AS bid, l_partkey AS iid,
         p_type || '/' || p_brand AS catid, p_type AS classid,
         l_quantity AS quantity, l_extendedprice AS price,
         c_mktsegment AS segmentationlabel, c_nationkey AS marketid,
         o_orderdate AS checkoutdate,
         CAST(date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS INTEGER) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN part ON l_partkey = p_partkey
                JOIN customer ON o_custkey = c_custkey)"""

HOLES = """holes AS (
  SELECT * REPLACE (nullif(quantity, 1) AS quantity, nullif(marketid, 7) AS marketid,
                    nullif(segmentationlabel, 'FURNITURE') AS segmentationlabel) FROM lines)"""

CLASSES = """classes AS (
  SELECT DISTINCT p_type || '/' || p_brand AS classid, p_type AS primaryparentid FROM part
  UNION SELECT DISTINCT p_type, 'ROOT' FROM part
  UNION SELECT 'ROOT', NULL)"""
NAMED = "named AS (SELECT classid, lower(classid) AS class_name, primaryparentid FROM classes)"
PARENTS = """parents AS (
  SELECT a.classid, a.class_name, a.primaryparentid, b.class_name AS parent_name
  FROM named a LEFT JOIN named b ON a.primaryparentid = b.classid)"""
ITEMS = """items AS (
  SELECT p_partkey AS iid, p_name AS item_name, p_type AS classid, p_type || '/' || p_brand AS catid,
         p_brand AS brand_name FROM part)"""
PATCHED = """patched AS (
  SELECT classid, class_name, CASE classid WHEN 'PROMO' THEN 'ECONOMY' WHEN 'SMALL' THEN 'MEDIUM'
         ELSE primaryparentid END AS primaryparentid FROM named)"""


def rollup(src: str, name: str = "rolled") -> str:
    return f"""{name} AS (
  SELECT bid, cid, checkoutdate, classid, catid, segmentationlabel, days, marketid,
         round(sum(price), 2) AS price, sum(quantity) AS quantity
  FROM {src} GROUP BY ALL)"""


def clean(grain, min_orders: int = 2, rare: int = 25) -> list[str]:
    """Raw lines to enriched lines ``e`` of the grain."""
    out = [LINES, """valid AS (
  SELECT * REPLACE (coalesce(segmentationlabel, 'unlabeled') AS segmentationlabel) FROM lines
  WHERE classid IS NOT NULL AND catid IS NOT NULL AND iid IS NOT NULL AND quantity IS NOT NULL
    AND price IS NOT NULL AND marketid IS NOT NULL AND price > 300 AND quantity > 0)"""]
    src = "valid"
    if grain == CATEGORY:
        out.append(rollup("valid"))
        src = "rolled"
    first = "min(checkoutdate) OVER (PARTITION BY cid, iid)," if grain == ITEM else ""
    flag = "CASE WHEN checkoutdate = f_iid THEN 0 ELSE 1 END AS reordered," if grain == ITEM else ""
    out += [
        f"""enough AS (
  SELECT * FROM {src} WHERE cid IN (
    SELECT cid FROM {src} GROUP BY cid HAVING count(DISTINCT bid) > {min_orders}))""",
        f"""popular AS (
  SELECT * FROM enough WHERE classid NOT IN (
    SELECT classid FROM enough GROUP BY classid HAVING count(*) < {rare}))""",
        f"""firsts AS (
  SELECT *, {first.rstrip(',') + ' AS f_iid,' if first else ''}
         min(checkoutdate) OVER (PARTITION BY cid, catid) AS f_cat,
         min(checkoutdate) OVER (PARTITION BY cid, classid) AS f_class FROM popular)""",
        f"""e AS (
  SELECT *, {flag}
         CASE WHEN checkoutdate = f_cat THEN 0 ELSE 1 END AS cat_reordered,
         CASE WHEN checkoutdate = f_class THEN 0 ELSE 1 END AS class_reordered,
         CAST(isodow(checkoutdate) - 1 AS INTEGER) AS day_of_week FROM firsts)""",
    ]
    return out


def baskets(src: str, name: str) -> str:
    """Timeline of the baskets of ``src``."""
    return f"""{name} AS (
  SELECT *, CAST(lag(days) OVER w - days AS INTEGER) AS days_since_prior_order,
         CAST(days - lead(days) OVER w AS INTEGER) AS days_until_next,
         row_number() OVER w AS order_number, count(*) OVER (PARTITION BY cid) AS total_orders
  FROM (SELECT cid, bid, max(checkoutdate) AS checkoutdate, max(days) AS days
        FROM {src} GROUP BY cid, bid)
  WINDOW w AS (PARTITION BY cid ORDER BY checkoutdate, bid))"""


def holdout(grain, level: int, src: str = "e") -> list[str]:
    """prior_k, label_k, context_k, dsp_k for k = 1 … level, one basket at a time."""
    out = []
    ids = ", ".join(c for c in ("catid", "classid") if c != grain.key)
    for k in range(1, level + 1):
        before = src if k == 1 else f"prior_{k - 1}"
        out += [
            f"""last_{k} AS (
  SELECT DISTINCT cid, bid, checkoutdate AS last_date FROM {before}
  QUALIFY row_number() OVER (PARTITION BY cid ORDER BY checkoutdate DESC, bid DESC) = 1)""",
            f"""prior_{k} AS (
  SELECT * FROM (SELECT * REPLACE (days - min(days) OVER (PARTITION BY cid) AS days) FROM {before})
  WHERE bid NOT IN (SELECT bid FROM last_{k}))""",
            f"""label_{k} AS (
  SELECT b.cid, l.bid, b.{grain.key}, {', '.join('b.' + c for c in ids.split(', '))},
         CASE WHEN b.checkoutdate = l.last_date THEN 1 ELSE 0 END AS reorder_label
  FROM {before} b JOIN last_{k} l USING (cid)
  WHERE b.checkoutdate <> l.last_date OR b.{grain.flag} = 1
  QUALIFY row_number() OVER (PARTITION BY b.cid, b.{grain.key}
                             ORDER BY b.checkoutdate DESC, b.bid DESC) = 1)""",
            baskets(before, f"basket_{k}"),
            f"""context_{k} AS (
  SELECT l.*, g.days_since_prior_order, CAST(isodow(g.checkoutdate) - 1 AS INTEGER) AS day_of_week,
         g.checkoutdate
  FROM label_{k} l JOIN basket_{k} g USING (cid, bid)
  WHERE g.days_since_prior_order IS NOT NULL)""",
            f"""dsp_{k} AS (
  SELECT b.*, g.days_since_prior_order FROM {before} b JOIN basket_{k} g USING (cid, bid)
  WHERE g.days_since_prior_order IS NOT NULL AND bid NOT IN (SELECT bid FROM label_{k}))""",
        ]
    return out


def numbered(k: int) -> str:
    """History lines with the order number of their basket, from 0."""
    return f"""num_{k} AS (
  SELECT p.*, n.order_number - 1 AS ord, n.total_orders FROM prior_{k} p
  JOIN hb_{k} n USING (cid, bid))"""


def history(grain, level: int = 1, src: str = "e") -> list[str]:
    return [*holdout(grain, level, src), baskets(f"prior_{level}", f"hb_{level}"), numbered(level)]


def item(level: int = 1) -> list[str]:
    return clean(ITEM) + history(ITEM, level)


def cat(level: int = 1) -> list[str]:
    return clean(CATEGORY) + history(CATEGORY, level)


def of(grain, level: int = 1) -> list[str]:
    return item(level) if grain == ITEM else cat(level)


# --- sources -------------------------------------------------------------------------------

SQL["s01_read_orders"] = with_([LINES], "SELECT * FROM lines")
SQL["s02_read_class"] = with_([CLASSES, NAMED], "SELECT * FROM named")
SQL["s03_read_category"] = with_([ITEMS], """
SELECT DISTINCT catid, CASE WHEN brand_name <> 'Brand#1' THEN lower(catid) END AS cat_name FROM items""")
SQL["s04_read_items"] = with_([ITEMS], "SELECT * FROM items")
SQL["s05_rename_columns"] = (
    "SELECT o_orderkey AS bid, o_custkey AS cid, o_orderdate AS checkoutdate FROM orders"
)
SQL["s06_write_features"] = with_(clean(CATEGORY) + holdout(CATEGORY, 2), """
SELECT 1 AS run, 'test' AS split, count(*) AS rows, CAST(sum(reorder_label) AS BIGINT) AS positives
FROM label_1
UNION ALL SELECT 1, 'train', count(*), CAST(sum(reorder_label) AS BIGINT) FROM label_2""")
SQL["s07_read_features"] = with_(clean(CATEGORY) + holdout(CATEGORY, 1), "SELECT * FROM label_1")
SQL["s08_versioned_write"] = with_(clean(CATEGORY) + [baskets("e", "b")], f"""
SELECT cid, bid, 1 AS run FROM b WHERE days <= {OTLI}
UNION ALL SELECT cid, bid, 2 FROM b WHERE days <= {2 * OTLI}""")
LOYAL = ", ".join(f"'{v}'" for v in FIXTURE_LOYAL)
COHORT = f"cohort AS (SELECT DISTINCT cid FROM lines WHERE segmentationlabel IN ({LOYAL}))"
SQL["s10_write_cohort"] = with_([LINES, COHORT], "SELECT * FROM cohort")
SQL["s12_drop_columns"] = with_([LINES], f"SELECT {CORE} FROM lines")

# --- cleaning ------------------------------------------------------------------------------

SQL["c01_distinct_rows"] = with_([LINES], "SELECT DISTINCT cid, catid, classid FROM lines")
SQL["c02_null_counts"] = with_([LINES, HOLES], "SELECT " + ", ".join(
    f"count(*) - count({c}) AS {c}" for c in
    ("cid", "bid", "iid", "catid", "classid", "quantity", "price", "segmentationlabel",
     "marketid", "checkoutdate", "days")) + " FROM holes")
SQL["c03_null_rows"] = with_([ITEMS], """
SELECT DISTINCT catid, CAST(NULL AS VARCHAR) AS cat_name FROM items WHERE brand_name = 'Brand#1'""")
SQL["c04_equality_lookup"] = with_(
    [CLASSES, NAMED], "SELECT * FROM named WHERE primaryparentid = 'ROOT'")
SQL["c05_drop_missing"] = with_([LINES, HOLES], f"""
SELECT {CORE}, marketid FROM holes WHERE quantity IS NOT NULL AND marketid IS NOT NULL""")
SQL["c06_range_filter"] = with_(
    [LINES], f"SELECT {CORE} FROM lines WHERE price > {MIN_PRICE} AND quantity > 0")
SQL["c07_distinct_values"] = with_([LINES], "SELECT DISTINCT segmentationlabel FROM lines")
SQL["c08_fill_label"] = with_([LINES, HOLES], """
SELECT cid, bid, iid, coalesce(segmentationlabel, 'unlabeled') AS segmentationlabel FROM holes""")
SQL["c09_patch_hierarchy"] = with_([CLASSES, NAMED, PATCHED], "SELECT * FROM patched")
SQL["c10_parent_name"] = with_([CLASSES, NAMED, PARENTS], "SELECT * FROM parents")
SQL["c11_basket_count"] = with_(
    [LINES], "SELECT cid, count(DISTINCT bid) AS baskets FROM lines GROUP BY cid")
OFTEN = """often AS (
  SELECT * FROM lines WHERE cid IN (SELECT cid FROM lines GROUP BY cid HAVING count(DISTINCT bid) > 8))"""
SQL["c12_min_orders"] = with_([LINES, OFTEN], f"SELECT {CORE} FROM often")
SQL["c13_volume_stats"] = with_([LINES, OFTEN], "\nUNION ALL ".join(
    f"SELECT '{s}' AS stage, (SELECT count(*) FROM (SELECT DISTINCT cid, bid FROM {t})) AS baskets, "
    f"count(DISTINCT cid) AS customers, count(*) AS lines FROM {t}"
    for s, t in (("before", "lines"), ("after", "often"))))
COUNTS = "counts AS (SELECT classid, count(*) AS rep FROM lines GROUP BY classid)"
SQL["c14_class_counts"] = with_([LINES, COUNTS], "SELECT * FROM counts")
SQL["c15_rare_class_report"] = with_([LINES, COUNTS, CLASSES, NAMED, PATCHED], f"""
SELECT c.classid, c.rep, p.class_name, p.primaryparentid, q.rep AS parent_rep
FROM counts c JOIN patched p ON c.classid = p.classid
LEFT JOIN counts q ON p.primaryparentid = q.classid WHERE c.rep < {RARE}""")
SQL["c16_drop_rare_classes"] = with_([LINES, COUNTS], f"""
SELECT {CORE} FROM lines WHERE classid IN (SELECT classid FROM counts WHERE rep >= {RARE})""")
SQL["c17_parse_timestamp"] = with_([LINES], """
SELECT cid, bid, max(checkoutdate) AS checkoutdate, max(days) AS days FROM lines GROUP BY cid, bid""")
SQL["c18_category_rollup"] = with_([LINES, rollup("lines")], "SELECT * FROM rolled")
SQL["c19_loyal_cohort"] = with_([LINES, COHORT], "SELECT * FROM cohort")
SQL["c20_keep_cohort"] = with_(clean(CATEGORY) + holdout(CATEGORY, 1) + [COHORT], """
SELECT * FROM label_1 WHERE cid IN (SELECT cid FROM cohort)""")
SQL["c21_gap_cutoff"] = with_(clean(CATEGORY) + holdout(CATEGORY, 1), f"""
SELECT * FROM context_1 WHERE days_since_prior_order <= {OTLI}""")


# --- joins ---------------------------------------------------------------------------------


def rate(src: str, keys: str, flag: str, name: str) -> str:
    return f"SELECT {keys}, {div(f'sum({flag})', 'count(*)')} AS {name} FROM {src} GROUP BY {keys}"


SQL["j01_inner_equi"] = with_(item(), f"""
SELECT l.*, {rnd('p.product_reorder_rate', 'product_reorder_rate')} FROM label_1 l
JOIN ({rate('prior_1', 'iid', 'reordered', 'product_reorder_rate')}) p USING (iid)""")
SQL["j03_semi"] = with_(
    [LINES, COHORT], f"SELECT {CORE} FROM lines WHERE cid IN (SELECT cid FROM cohort)")
LAST = """last AS (SELECT DISTINCT cid, bid, checkoutdate FROM lines
  QUALIFY row_number() OVER (PARTITION BY cid ORDER BY checkoutdate DESC, bid DESC) = 1)"""
SQL["j04_anti"] = with_(
    [LINES, LAST], f"SELECT {CORE} FROM lines WHERE bid NOT IN (SELECT bid FROM last)")
SQL["j05_full_outer"] = with_(clean(ITEM) + [
    baskets("e", "b"), "n AS (SELECT e.cid, e.iid, b.order_number FROM e JOIN b USING (cid, bid))"], """
SELECT coalesce(x.cid, y.cid) AS cid, iid, last_order, orders
FROM (SELECT cid, iid, max(order_number) AS last_order FROM n GROUP BY cid, iid) x
FULL JOIN (SELECT cid, max(order_number) AS orders FROM n GROUP BY cid) y ON x.cid = y.cid""")
SQL["j06_self_join"] = with_([CLASSES], """
SELECT a.classid, a.primaryparentid, b.primaryparentid AS grandparent
FROM classes a LEFT JOIN classes b ON a.primaryparentid = b.classid""")
SQL["j07_level_aligned_divide"] = with_(clean(ITEM), f"""
SELECT cid, catid, {rnd(div('n', 'm'), 'u_t_order_rate')}
FROM (SELECT cid, catid, count(*) AS n FROM e GROUP BY cid, catid)
JOIN (SELECT cid, count(*) AS m FROM e GROUP BY cid) USING (cid)""")
SQL["j08_composite_isin"] = with_([LINES], f"""
SELECT {CORE} FROM lines WHERE (cid, catid) IN (
  SELECT (cid, catid) FROM lines GROUP BY cid, catid HAVING count(*) > 2)""")

# --- windows -------------------------------------------------------------------------------

for _key, _suffix, _name in (
    ("iid", "item", "first_checkout"), ("catid", "cat", "cat_first_checkout"),
    ("classid", "class", "class_first_checkout"),
):
    SQL[f"w01_first_purchase_{_suffix}"] = with_([LINES], f"""
SELECT cid, bid, iid, catid, classid, checkoutdate,
       min(checkoutdate) OVER (PARTITION BY cid, {_key}) AS {_name} FROM lines""")
SQL["w02_reorder_flags"] = with_([LINES], "SELECT cid, bid, iid, " + ", ".join(
    f"CASE WHEN checkoutdate > min(checkoutdate) OVER (PARTITION BY cid, {k}) THEN 1 ELSE 0 END AS {f}"
    for k, f in (("iid", "reordered"), ("catid", "cat_reordered"), ("classid", "class_reordered"))
) + " FROM lines")
SQL["w03_weekday"] = with_([LINES], """
SELECT DISTINCT cid, bid, CAST((dayofweek(checkoutdate) + 6) % 7 AS INTEGER) AS day_of_week FROM lines""")
BASKETS = [LINES, baskets("lines", "b")]
SQL["w04_basket_gap"] = with_(
    BASKETS, "SELECT cid, bid, checkoutdate, days, days_since_prior_order FROM b")
SQL["w05_days_since_prior"] = with_(BASKETS, """
SELECT l.cid, l.bid, l.iid, l.price, b.days_since_prior_order FROM lines l JOIN b USING (cid, bid)
WHERE b.days_since_prior_order IS NOT NULL""")
SQL["w06_gap_to_next"] = with_(BASKETS, "SELECT cid, bid, days_until_next FROM b")
SQL["w07_order_number"] = with_(BASKETS, "SELECT cid, bid, order_number FROM b")
SQL["w08_total_orders"] = with_(BASKETS, "SELECT cid, bid, total_orders FROM b")
SQL["w09_last_per_group_item"] = with_([LINES, LAST], "SELECT cid, bid, checkoutdate FROM last")
SQL["w09_last_per_group_pair"] = with_([LINES], """
SELECT cid, iid, bid, price FROM lines
QUALIFY row_number() OVER (PARTITION BY cid, iid ORDER BY checkoutdate DESC, bid DESC, price DESC) = 1""")
SQL["w09_last_per_group_cat"] = with_([LINES, rollup("lines")], """
SELECT cid, catid, bid, price FROM rolled
QUALIFY row_number() OVER (PARTITION BY cid, catid ORDER BY checkoutdate DESC, bid DESC) = 1""")
SQL["w10_lead_purchase"] = with_([LINES, rollup("lines")], """
SELECT cid, catid, bid, lag(days) OVER w - days AS days_since_prior_purchase,
       days - lead(days) OVER w AS days_to_next_purchase FROM rolled
WINDOW w AS (PARTITION BY cid, catid ORDER BY checkoutdate, bid)""")
SQL["w11_group_transform"] = with_(clean(CATEGORY) + [baskets("e", "b")], f"""
SELECT cid, bid, days_since_prior_order, {rnd('m', 'group_mean')}, {rnd('s', 'group_std')},
       n AS group_rows, CAST(days_since_prior_order <= m + s AS INTEGER) AS inside
FROM (SELECT cid, bid, days_since_prior_order, count(*) OVER (PARTITION BY cid) AS n,
             avg(days_since_prior_order) OVER (PARTITION BY cid) AS m,
             stddev_samp(days_since_prior_order) OVER (PARTITION BY cid) AS s FROM b)""")
SQL["w12_sort"] = with_([LINES], """
SELECT cid, bid, max(checkoutdate) AS checkoutdate, max(days) AS days FROM lines
GROUP BY cid, bid ORDER BY cid, checkoutdate DESC, bid""")
SQL["u01_union_all"] = with_(clean(CATEGORY) + holdout(CATEGORY, 3), """
SELECT * FROM label_2 UNION ALL SELECT * FROM label_3""")
SQL["u03_distinct_keys"] = with_([LINES], "SELECT DISTINCT iid, classid, catid FROM lines")

# --- holdout -------------------------------------------------------------------------------

SQL["h01_rebase_days"] = with_([LINES], """
SELECT cid, bid, iid, days - min(days) OVER (PARTITION BY cid) AS days FROM lines""")
SQL["h02_last_basket"] = with_([LINES, LAST], "SELECT cid, bid, checkoutdate FROM last")
for _g, _suffix in ((ITEM, "item"), (CATEGORY, "cat")):
    SQL[f"h03_prior_history_{_suffix}"] = with_(
        clean(_g) + holdout(_g, 1), f"SELECT cid, bid, {_g.key}, price, days FROM prior_1")
    SQL[f"h04_label_set_{_suffix}"] = with_(
        clean(_g) + holdout(_g, 1), "SELECT * FROM label_1")
    SQL[f"h05_rolling_holdout_{_suffix}"] = with_(
        clean(_g) + holdout(_g, 3),
        "\nUNION ALL ".join(f"SELECT *, {k} AS level FROM label_{k}" for k in (1, 2, 3)))
    SQL[f"h06_context_columns_{_suffix}"] = with_(
        clean(_g) + holdout(_g, 1), "SELECT * FROM context_1")
SQL["h07_customer_split"] = with_(clean(CATEGORY) + holdout(CATEGORY, 2), """
SELECT *, 'train' AS part FROM label_2
UNION ALL SELECT *, CASE WHEN (cid * 7919 + 104729) % 1000 < 700 THEN 'train' ELSE 'test' END
FROM label_1""")

# --- outliers ------------------------------------------------------------------------------

TIMELINE = clean(CATEGORY) + [baskets("e", "b")]
GAPS = TIMELINE + [f"""gaps AS (
  SELECT cid, bid, order_number, total_orders, count(*) OVER (PARTITION BY cid) AS n,
         max(order_number) OVER (PARTITION BY cid) AS top FROM b WHERE days_until_next > {OTLI})"""]
SQL["x01_basket_timeline"] = with_(BASKETS, "SELECT * FROM b")
SQL["x02_long_gaps"] = with_(
    TIMELINE, f"SELECT cid, bid, days_until_next FROM b WHERE days_until_next > {OTLI}")
X3 = f"SELECT DISTINCT cid FROM gaps WHERE n >= 3 AND {div('n', 'total_orders')} > 0.1"
X4C = """SELECT cid FROM gaps WHERE n = 1
  AND ((total_orders < 6 AND order_number >= 2) OR total_orders < 4)"""
X4B = "SELECT cid, bid FROM gaps WHERE n = 1 AND order_number < 2"
X5C = "SELECT DISTINCT cid FROM gaps WHERE n = 2 AND total_orders < 9"
X5S = """SELECT DISTINCT cid FROM gaps WHERE n = 2
  AND ((total_orders < 9 AND top > 2) OR total_orders < 7)"""
X5B = "SELECT cid, bid FROM gaps WHERE n = 2 AND top <= 2"


def rule(customers: str, bids: str) -> str:
    return f"SELECT cid, CAST(NULL AS BIGINT) AS bid FROM ({customers}) UNION ALL {bids}"


SQL["x03_gap_ratio_customers"] = with_(GAPS, X3)
SQL["x04_single_gap_rule"] = with_(GAPS, rule(X4C, X4B))
SQL["x05_double_gap_rule"] = with_(GAPS, rule(X5C, X5B))
SQL["x05_double_gap_rule_strict"] = with_(GAPS, rule(X5S, X5B))
KEPT = f"""WHERE cid NOT IN ({X3}) AND cid NOT IN ({X4C}) AND cid NOT IN ({X5C})
  AND bid NOT IN (SELECT bid FROM ({X4B})) AND bid NOT IN (SELECT bid FROM ({X5B}))"""
SQL["x06_remove_gap_outliers"] = with_(GAPS, f"SELECT cid, bid, catid, price FROM e {KEPT}")


def ksigma(src: str, keys: str, value: str, k: float) -> str:
    return f"""SELECT * EXCLUDE (_n, _limit) FROM (
  SELECT *, count(*) OVER (PARTITION BY {keys}) AS _n,
         avg({value}) OVER (PARTITION BY {keys}) + {k} * stddev_samp({value}) OVER (PARTITION BY {keys})
           AS _limit FROM {src}) WHERE _n = 1 OR {value} <= _limit"""


SIZES = "sizes AS (SELECT cid, bid, count(*) AS cart_size FROM e GROUP BY cid, bid)"
SQL["x07_ksigma_filter_cart_size"] = with_(
    clean(CATEGORY) + [SIZES], ksigma("sizes", "cid", "cart_size", 1))
SQL["x07_ksigma_filter_gap"] = with_(TIMELINE, ksigma(
    "(SELECT cid, bid, days_since_prior_order FROM b)", "cid", "days_since_prior_order", 2))
CATGAP = """SELECT cid, bid, catid, lag(days) OVER (PARTITION BY cid, catid ORDER BY checkoutdate, bid) - days
  AS days_since_prior_purchase FROM e"""
SQL["x07_ksigma_filter_cat_gap"] = with_(
    clean(CATEGORY), ksigma(f"({CATGAP})", "cid, catid", "days_since_prior_purchase", 2))
SQL["x10_gap_probe"] = with_(TIMELINE, f"""
SELECT cid, bid, order_number, total_orders, long_gaps, days_since_prior_order,
       {rnd('a', 'gap_avg')}, {rnd('s', 'gap_std')},
       {rnd('days_since_prior_order - a', 'gap_minus_avg')}
FROM (SELECT *, avg(days_since_prior_order) OVER (PARTITION BY cid) AS a,
             stddev_samp(days_since_prior_order) OVER (PARTITION BY cid) AS s,
             count(*) FILTER (WHERE days_since_prior_order > 60) OVER (PARTITION BY cid) AS long_gaps
      FROM b)
WHERE long_gaps >= 3 AND days_since_prior_order > 60""")

# --- exploration ---------------------------------------------------------------------------

SQL["e01_class_tree"] = with_([CLASSES, NAMED, PARENTS], "SELECT class_name, parent_name FROM parents")
for _name, _cte, _src in (("e02_items_per_class", ITEMS, "items"), ("e03_lines_per_class", LINES, "lines")):
    SQL[_name] = with_([CLASSES, NAMED, PARENTS, _cte], f"""
SELECT class_name, parent_name, coalesce(n, 0) AS counts FROM parents
LEFT JOIN (SELECT classid, count(*) AS n FROM {_src} GROUP BY classid) USING (classid)""")


def shared(inner: str, keys: str, n: str) -> str:
    return f"""SELECT {keys}, {n}, {rnd(div(n, f'(SELECT sum({n}) FROM ({inner}))'), 'share')}
FROM ({inner})"""


SQL["e04_segment_share"] = with_([LINES], shared(
    """SELECT segmentationlabel, count(*) AS customers FROM (
  SELECT cid, max(segmentationlabel) AS segmentationlabel FROM lines GROUP BY cid) GROUP BY ALL""",
    "segmentationlabel", "customers"))
SQL["e05_weekday_share"] = with_([LINES], shared(
    """SELECT CAST(isodow(checkoutdate) - 1 AS INTEGER) AS day_of_week,
  left(dayname(checkoutdate), 3) AS day_name, count(*) AS counts FROM lines GROUP BY ALL""",
    "day_of_week, day_name", "counts"))
SQL["e06_quantity_histogram"] = with_([LINES], shared(
    """SELECT CASE WHEN quantity > 10 THEN '10<' ELSE CAST(CAST(floor(quantity) AS BIGINT) AS VARCHAR) END
  AS quantity, count(*) AS counts FROM lines GROUP BY ALL""", "quantity", "counts"))
SQL["e07_lines_per_day"] = with_([LINES], """
SELECT CAST(checkoutdate AS DATE) AS date, count(*) AS orders_count FROM lines GROUP BY ALL""")
SQL["e08_cart_size_histogram"] = with_([LINES], shared(
    """SELECT CASE WHEN n > 5 THEN '5<' ELSE CAST(CAST(floor(n) AS BIGINT) AS VARCHAR) END AS cart_size,
  count(*) AS counts FROM (SELECT cid, count(*) / count(DISTINCT bid) AS n FROM lines GROUP BY cid)
  GROUP BY ALL""", "cart_size", "counts"))


def bins(src: str, n: int) -> str:
    return f"""SELECT CAST(least(floor((v - (SELECT min(v) FROM {src}))
  / ((SELECT max(v) FROM {src}) - (SELECT min(v) FROM {src})) * {n}), {n - 1}) AS INTEGER) AS bin,
  count(*) AS counts FROM {src} GROUP BY ALL"""


SQL["e09_unit_price_histogram"] = with_(
    [LINES, "u AS (SELECT price / quantity AS v FROM lines)"], bins("u", 159))
SQL["e10_basket_gap_histogram"] = with_(TIMELINE + [
    "u AS (SELECT CAST(days_since_prior_order AS DOUBLE) AS v FROM b WHERE days_since_prior_order IS NOT NULL)"
], bins("u", 121))
REPEAT = """rep AS (SELECT cid, catid, count(DISTINCT iid) AS items FROM lines
  GROUP BY cid, catid HAVING count(*) > 2)"""
SQL["e11_variety_in_repeat_categories"] = with_(
    [LINES, REPEAT], f"SELECT *, {rnd('(SELECT avg(items) FROM rep)', 'mean_items')} FROM rep")
for _name, _segments in (("loyal", LOYAL), ("other", "'FURNITURE', 'HOUSEHOLD'")):
    SQL[f"e12_customer_scatter_{_name}"] = with_(TIMELINE, f"""
SELECT cid, {rnd('g', 'days_between_orders')}, baskets, segmentationlabel
FROM (SELECT cid, avg(days_since_prior_order) AS g FROM b GROUP BY cid HAVING g IS NOT NULL)
JOIN (SELECT cid, count(DISTINCT bid) AS baskets, max(segmentationlabel) AS segmentationlabel
      FROM lines GROUP BY cid) USING (cid)
WHERE segmentationlabel IN ({_segments})""")
SQL["e13_cart_cost_by_segment"] = with_([LINES, """cost AS (
  SELECT max(segmentationlabel) AS segmentationlabel,
         round(sum(price), 2) / count(DISTINCT bid) AS cost FROM lines GROUP BY cid)""",
    """box AS (SELECT segmentationlabel, count(*) AS customers, quantile_cont(cost, 0.25) AS q1,
         quantile_cont(cost, 0.5) AS q2, quantile_cont(cost, 0.75) AS q3 FROM cost GROUP BY ALL)"""], f"""
SELECT segmentationlabel, customers, {rnd('q1')}, {rnd('q2')}, {rnd('q3')},
       {rnd('min(cost)', 'whisker_low')}, {rnd('max(cost)', 'whisker_high')}
FROM cost JOIN box USING (segmentationlabel)
WHERE cost BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
