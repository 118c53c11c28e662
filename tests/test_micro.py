"""Hand-computed expectations on tiny order histories."""

import pytest
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import CATEGORY, ITEM
from repeatbuy.operators import clean, evaluate, features, holdout, outliers, price, timeline
from repeatbuy.plans import inputs
from repeatbuy.plans.orders import build_orders, valid_lines
from shop import four_baskets, line, lines


@pytest.fixture(scope="module")
def orders(spark):
    return build_orders(four_baskets(spark), gaps=True)


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def test_flags(orders):
    got = as_dict(orders.lines, "bid", "iid")
    assert {k: v["reordered"] for k, v in got.items()} == {
        (1, "A"): 0, (1, "B"): 0, (2, "A"): 1, (3, "A"): 1, (3, "C"): 0, (4, "B"): 1, (4, "D"): 0,
    }


@pytest.mark.parametrize("level, bid, want", [
    (1, 4, {"A": 0, "B": 1, "C": 0}), (2, 3, {"A": 1, "B": 0}),
])
def test_labels(orders, level, bid, want):
    got = as_dict(holdout.label_set(orders.lines, ITEM, level, context=True), "iid")
    assert {k: v["reorder_label"] for k, v in got.items()} == want
    assert all(v["bid"] == bid and v["days_since_prior_order"] == 10 for v in got.values())


def test_history_is_rebased(orders):
    one = as_dict(holdout.prior_history(orders.lines, 1), "bid")
    two = as_dict(holdout.prior_history(orders.lines, 2), "bid")
    assert {b: r["days"] for b, r in one.items()} == {1: 30, 2: 20, 3: 10}
    assert {b: r["days"] for b, r in two.items()} == {1: 20, 2: 10}


def test_user_features(orders):
    row = features.user_features(orders.lines, orders.baskets, ITEM, 1).first().asDict()
    assert row["user_reorder_rate"] == pytest.approx(0.4)
    assert row["user_unique_products"] == 3
    assert row["user_total_products"] == 5
    assert row["user_avg_cart_size"] == pytest.approx(5 / 3)
    assert row["days_between_orders"] == 10
    assert row["user_reordered_products"] == 1
    assert row["user_reordered_products_ratio"] == pytest.approx(1 / 3)


def test_pair_features(orders):
    got = as_dict(features.user_product_features(orders.lines, orders.walks["iid"], 1), "iid")
    assert got["A"]["u_p_order_rate"] == pytest.approx(3 / 5)
    assert got["A"]["u_p_reorder_rate"] == pytest.approx(2 / 3)
    assert [got[i]["u_p_orders_since_last"] for i in "ABC"] == [0, 2, 0]
    assert got["A"]["max_streak"] == 0
    open_ = features.max_streak(orders.walks["iid"], ["cid", "iid"], 1, "m", include_open=True)
    assert as_dict(open_, "iid")["A"]["m"] == 2


def test_gap_share(orders):
    share = features.gap_share(holdout.gap_lines(orders.lines, 1), ("iid",))
    got = as_dict(share, "iid")
    assert got["A"]["p_days_since_prior_order_reorder_rate"] == 1.0
    train = features.gap_share(holdout.gap_lines(orders.lines, 2), ("iid",))
    assert set(as_dict(train, "iid")) == {"A"}


def test_prices(orders):
    gapped = timeline.at_level(orders.gapped, 1)
    mean = price.ave_price_day_ratio(gapped, ["cid", "catid"], "m")
    assert as_dict(mean, "catid")["A"]["m"] == pytest.approx(11.0)
    last = price.days_price_ratio_since_prior(gapped)
    assert as_dict(last, "catid")["A"]["user_days_price_ratio_since_prior"] == pytest.approx(90 / 10.4)


def test_model_input_rows(orders):
    got = as_dict(inputs.model_input_item(orders, 1), "iid")
    assert set(got) == {"A", "B", "C"}
    assert got["A"]["u_p_days_since_prior_reorder_rate"] == 1.0
    assert got["B"]["u_p_days_since_prior_reorder_rate"] == 0.0


@pytest.mark.parametrize("numbers, closed, any_", [
    ([0, 1, 2, 4], 2, 2), ([0, 1, 2], 0, 2), ([0, 1, 1, 2, 5], 1, 1), ([3], 0, 0),
    ([0, 2, 3, 4], 0, 2), ([0, 1, 1, 2, 4], 1, 1), ([0, 1, 1], 1, 1), ([0, 0, 1], 0, 1),
])
def test_streak(spark, numbers, closed, any_):
    rows = spark.createDataFrame(
        [(1, "A", n, 10 - n) for n in numbers], "cid int, iid string, order_number int, from_last int"
    )
    walk = features.streak_walk(rows, ["cid", "iid"])
    assert features.max_streak(walk, ["cid", "iid"], 0, "m").first()["m"] == closed
    assert features.max_streak(walk, ["cid", "iid"], 0, "m", True).first()["m"] == any_


GAP_CASES = [
    (20, [4, 9, 15], "customer"), (30, [4, 9, 15], ""), (5, [1], {1}), (3, [1], "customer"),
    (5, [3], "customer"), (6, [3], ""), (9, [1, 2], {1, 2}), (8, [1, 2], "customer"), (9, [4, 6], ""),
]


def gap_rows(spark, total, gaps):
    days, rows, left = 0, [], []
    for n in range(total, 0, -1):  # newest first; a gap at n follows order n
        days += 100 if n in gaps else 1
        left.append((n, days))
    for n, d in left:
        rows.append(line(1, n, d, "A"))
    return lines(spark, rows)


@pytest.mark.parametrize("total, gaps, want", GAP_CASES)
def test_gap_rules(spark, total, gaps, want):
    walked = timeline.basket_timeline(timeline.basket_rows(gap_rows(spark, total, gaps)))
    customers, baskets = outliers.gap_verdict(walked, 60)
    dropped = {r["bid"] for r in baskets.collect()}
    if want == "customer":
        assert customers.count() == 1
    else:
        assert customers.count() == 0
        assert dropped == (want or set())


def test_double_gap_strict(spark):
    walked = timeline.basket_timeline(timeline.basket_rows(gap_rows(spark, 8, [1, 2])))
    customers, baskets = outliers.double_gap_rule(outliers.gap_summary(walked, 60), strict=True)
    assert customers.count() == 0
    assert {r["bid"] for r in baskets.collect()} == {1, 2}


@pytest.mark.parametrize("values, kept", [
    ([None], [None]), ([None, 10.0], []), ([None, 10.0, 12.0], [10.0, 12.0]),
    ([1.0] * 5 + [100.0], [1.0] * 5),
])
def test_ksigma(spark, values, kept):
    rows = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = [r["v"] for r in outliers.ksigma_filter(rows, ["g"], "v", 2).collect()]
    assert sorted(got, key=str) == kept


def test_ksigma_can_keep_a_single_known_value(spark):
    rows = spark.createDataFrame([("g", None), ("g", 10.0)], "g string, v double")
    got = outliers.ksigma_filter(rows, ["g"], "v", 2, keep_undefined_std=True).collect()
    assert [r["v"] for r in got] == [10.0]


def test_cleaning(spark):
    whole = line(1, 1, 5, "A")
    required = (2, 3, 4, 5, 6, 8)  # iid, catid, classid, quantity, price, marketid
    holes = [tuple(None if i == c else v for i, v in enumerate(whole)) for c in required]
    rows = holes + [
        line(1, 2, 4, "A", segmentationlabel=None), line(1, 3, 3, "A", 300),
        line(1, 4, 2, "A", 300.01), line(1, 5, 1, "A", quantity=0.0),
    ]
    got = valid_lines(lines(spark, rows)).collect()
    assert sorted(r["bid"] for r in got) == [2, 4]
    assert {r["segmentationlabel"] for r in got if r["bid"] == 2} == {"unlabeled"}


def test_tied_baskets(spark):
    rows = [line(1, 8, 5, "A"), line(1, 7, 5, "A")]
    enriched = timeline.enrich(lines(spark, rows))
    assert [r["reordered"] for r in enriched.collect()] == [0, 0]
    assert holdout.last_basket(timeline.basket_rows(lines(spark, rows))).first()["bid"] == 8


def test_customer_without_label_keeps_its_last_basket_in_gap_lines(spark):
    made = build_orders(lines(spark, [line(1, 8, 5, "A"), line(1, 7, 5, "A")]), gaps=False)
    assert holdout.label_set(made.lines, ITEM, 1).count() == 0
    assert [r["bid"] for r in holdout.gap_lines(made.lines, 1).collect()] == [8]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(0, 0.1), (1, 0.4), (0, 0.5), (1, 0.8)]
    df = spark.createDataFrame(rows, "y_test int, y_test_prob double")
    return evaluate.apply_threshold(df, 0.5)


def test_report(scores):
    got = as_dict(evaluate.classification_report(scores), "label")
    assert got["1"]["precision"] == 1 and got["1"]["recall"] == 0.5
    assert got["1"]["f1"] == pytest.approx(2 / 3)
    assert got["accuracy"]["f1"] == 0.75 and got["macro avg"]["support"] == 4


def test_best_threshold(scores):
    row = evaluate.best_threshold(scores).first()
    assert (row["kind"], row["threshold"]) == ("prob", pytest.approx(0.1))
    assert row["f1_threshold"] == pytest.approx(0.8)


def test_precision_at_recall(scores):
    got = as_dict(evaluate.precision_at_recall(scores, (0.5, 1.0)), "recall_target")
    assert got[0.5]["precision"] == 1.0
    assert got[1.0]["precision"] == pytest.approx(2 / 3)


def test_hierarchy_patch_and_names(spark):
    rows = [(1, "root", None), (2, "food", 1), (3, "milk", None)]
    classes = spark.createDataFrame(rows, "classid bigint, class_name string, primaryparentid bigint")
    named = clean.parent_name(clean.patch_hierarchy(classes, {3: 2}))
    assert {r["class_name"]: r["parent_name"] for r in named.collect()} == {
        "root": None, "food": "root", "milk": "food",
    }


def test_category_grain_of_one_customer(orders):
    labels = holdout.label_set(orders.lines, CATEGORY, 1).select("catid", "reorder_label")
    assert {tuple(r) for r in labels.collect()} == {("A", 0), ("B", 1), ("C", 0)}
    assert labels.filter(F.col("reorder_label") == 1).count() == 1
