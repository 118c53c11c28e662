"""Rounds of the neighbour join, and what balancing leaves behind."""

import numpy as np

from repeatbuy.functions.fixed import LABEL
from repeatbuy.operators import neighbours, prepare
from repeatbuy.plans.workspace import Workspace
from test_staging import collected, folders


def test_a_workspace_keeps_no_shuffle_files(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    before = {n: folders(spark, n) for n in ("scaled", "vectors", "balanced", "picked", "points", "made")}
    rows = ws.train_vectors.groupBy(LABEL).count().collect()
    assert len({r["count"] for r in rows}) == 1
    new = {n: len(folders(spark, n) - found) for n, found in before.items()}
    assert new == {"scaled": 0, "vectors": 0, "balanced": 0, "picked": 0, "points": 0, "made": 1}


def test_neighbours_in_rounds_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(500, 2)).round(1)], "a double, b double")
    monkeypatch.setattr(neighbours, "PART", 64)
    monkeypatch.setattr(neighbours, "ASKED", 32)
    points = neighbours.distinct_points(df, ["a", "b"], "point")
    asked, spent = points.withColumnRenamed("point", "ask"), []
    want = collected(neighbours.nearest_points(asked, points, ["a", "b"], 4))
    monkeypatch.setattr(neighbours, "MEETING", 50)
    assert collected(neighbours.nearest_points(asked, points, ["a", "b"], 4, spent=spent)) == want
    assert len(spent) > 6  # several rounds


def test_oversampling_leaves_no_tables_behind(spark):
    rng = np.random.default_rng(5)
    data = [(str(i), *map(float, x), int(i % 5 == 0)) for i, x in enumerate(rng.normal(size=(200, 2)))]
    rows = spark.createDataFrame(data, f"row_id string, a double, b double, {LABEL} int")
    before = folders(spark, "*")
    out = prepare.smote(rows, ["a", "b"], "row_id")
    assert {r["count"] for r in out.groupBy(LABEL).count().collect()} == {160}
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in folders(spark, "*") - before] == ["made"]
