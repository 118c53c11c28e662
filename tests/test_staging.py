"""Tables that lie by customer, and intermediate tables that go."""

import glob

import pytest
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import CATEGORY
from repeatbuy.functions.skew import Sizes, ordered
from repeatbuy.operators import clean, holdout, timeline
from repeatbuy.plans import inputs
from repeatbuy.plans.orders import build_orders, staged_rollup
from repeatbuy.plans.staging import shared_folder, stage, stage_by_customer
from shop import line, lines


def shop(spark):
    data = [
        line(c, 100 * c + b, 30 * b + c % 5, f"i{(c + b * j) % 7}", 500 + j)
        for c in range(1, 40) for b in range(8) for j in range(2)
    ]
    return stage(lines(spark, data), "shop")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def collected(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def folders(spark, name):
    top = shared_folder(spark).removeprefix("file:")
    own = f"{top}/repeatbuy/{spark.sparkContext.applicationId}"  # other sessions may share the folder
    return {p for p in glob.glob(f"{own}/{name}-*") if glob.glob(f"{p}/*.parquet")}


@pytest.fixture
def small(spark, monkeypatch):
    monkeypatch.setattr("repeatbuy.functions.skew.HOT_FLOOR", 0)
    return spark


def test_tables_lie_by_customer(spark):
    rows = shop(spark)
    kept = stage_by_customer(rows, "laid", Sizes(rows, staged=True))
    assert collected(kept) == collected(rows)
    assert "Exchange" not in plan(kept.groupBy("cid", "iid").count())


def test_a_hot_customer_is_not_put_into_one_file(small):
    rows = small.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("cid"), "id")
    rows = stage(rows, "hot")
    kept = stage_by_customer(rows, "laid", Sizes(rows, staged=True))
    assert collected(kept) == collected(rows)
    assert "Bucketed: true" not in plan(kept.groupBy("cid").count())


def test_the_chain_shuffles_no_lines_and_leaves_what_is_read(spark):
    rows = shop(spark)
    raw = stage_by_customer(rows, "raw", Sizes(rows, staged=True))
    before = {n: folders(spark, n) for n in ("cleaned", "timeline", "walk", "gapped", "lines")}
    orders = build_orders(staged_rollup(raw), gaps=True)
    new = {n: folders(spark, n) - found for n, found in before.items()}
    assert [len(new[n]) for n in before] == [0, 0, 0, 0, 1]
    assert "Exchange" not in plan(timeline.enrich(orders.lines, orders.sizes))
    assert "Exchange" not in plan(holdout.label_set(orders.lines, CATEGORY, 1))
    assert orders.walks["catid"].count() and orders.walks["catid"] is orders.walks["catid"]
    assert orders.gapped.count() == orders.lines.count()
    assert len(folders(spark, "walk") - before["walk"]) == len(folders(spark, "gapped") - before["gapped"]) == 1


def test_unknown_keys_leave_either_way(spark, monkeypatch):
    rows = [(c, b, k, "x" if k else None, day) for c, b, k, day in [
        (1, 1, "a", 1), (1, 2, "a", 2), (1, 2, None, 2), (None, 3, "b", 3), (2, 4, "b", 4), (2, 5, "b", 5)]]
    df = spark.createDataFrame(rows, "cid long, bid long, catid string, classid string, day int")
    df = stage(df.withColumn("checkoutdate", F.timestamp_seconds(F.col("day") * 86400)).drop("day"), "odd")
    plain = collected(timeline.enrich(df, Sizes(df, staged=True)))
    assert plain == collected(timeline.enrich(df, Sizes(df, floor=0)))
    assert len(plain) == 4


def test_plain_windows_equal_chunks(spark):
    rows = [("a", 1, 1), ("a", None, 2), ("a", 2, 4), (None, 1, 8), (None, 2, 16), ("", 1, 32)]
    df = stage(spark.createDataFrame(rows, "k string, c int, v long"), "odd")
    named = dict(running={"upto": F.col("v")}, total={"all": F.col("v")}, prev={"p": F.col("v")}, nxt={"n": F.col("v")})
    want = collected(ordered(df, ["k"], F.col("c"), ["c"], **named))
    assert collected(ordered(df, ["k"], F.col("c"), ["c"], sizes=Sizes(df, staged=True), **named)) == want


def test_few_rare_classes_need_no_shuffle_of_the_lines(small):
    rows = shop(small)
    kept = clean.drop_rare_classes(rows, 1_000, Sizes(rows, staged=True))
    assert "BroadcastHashJoin" in plan(kept) and "_salt" not in plan(kept)
    assert collected(kept) == collected(clean.drop_rare_classes(rows, 1_000))


def test_category_input_is_the_same_wherever_rows_lie(spark):
    rows = shop(spark)
    raw = stage_by_customer(rows, "raw", Sizes(rows, staged=True))
    laid = inputs.model_input_category(build_orders(staged_rollup(raw), gaps=True), 1)
    plain = inputs.model_input_category(build_orders(clean.category_rollup(rows), gaps=True), 1)
    assert laid.count() and collected(laid) == collected(plain)
