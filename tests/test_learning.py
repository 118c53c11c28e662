"""Balancing, ensembles and evaluation on small separable data."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import LABEL
from repeatbuy.operators import evaluate, features, models, neighbours, prepare, search

COLUMNS = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 3))
    y = (x[:, 0] + x[:, 1] > 1.2).astype(int)
    data = [(str(i), *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, f"row_id string, a double, b double, noise double, {LABEL} int")
    return df.withColumn("cid", F.col("row_id").cast("int") % 40)


@pytest.fixture(scope="module")
def vectors(rows):
    return prepare.select_features(rows, COLUMNS, ["cid", "row_id"]).cache()


def f1(predictions):
    report = evaluate.classification_report(predictions)
    return {r["label"]: r["f1"] for r in report.collect()}["1"]


def test_smote_balances_exactly_and_stays_in_range(rows):
    out = prepare.smote(rows, COLUMNS, "row_id")
    counts = {r[LABEL]: r["count"] for r in out.groupBy(LABEL).count().collect()}
    assert counts[0] == counts[1]
    old = rows.filter(F.col(LABEL) == 1).agg(F.min("a"), F.max("a")).first()
    new = out.filter(F.col("row_id").isNull()).agg(F.min("a"), F.max("a")).first()
    assert old[0] <= new[0] and new[1] <= old[1]
    again = prepare.smote(rows, COLUMNS, "row_id")
    total = F.round(F.sum("a"), 6)
    assert out.agg(total).first() == again.agg(total).first()


def test_smote_with_identical_rows(spark):
    data = [(str(i), 1.0, int(i < 30)) for i in range(100)]
    df = spark.createDataFrame(data, f"row_id string, a double, {LABEL} int")
    out = prepare.smote(df, ["a"], "row_id")
    assert out.filter(F.col(LABEL) == 1).count() == 70
    assert out.filter(F.col("a") != 1.0).count() == 0


def test_knn(rows):
    test, train = rows.filter("row_id % 4 = 0"), rows.filter("row_id % 4 != 0")
    votes = prepare.knn_votes(train, test, COLUMNS, "row_id", k=10)
    assert votes.count() == test.count()
    assert f1(votes) > 0.6
    curve = prepare.knn_error_curve(prepare.knn_votes(train, test, COLUMNS, "row_id", up_to=5))
    assert curve.count() == 5


def settings(spark, partitions, batch):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))


@pytest.fixture
def dealt(spark):
    """The same work with few and many partitions, small and large batches."""
    yield [(2, 500), (8, 10_000)]
    settings(spark, 8, 10_000)


def test_knn_equals_brute_force(spark, dealt):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3000, 6)) * [1, 1, 1, 1, 1, 1000], rng.integers(0, 2, 3000)
    columns = [f"c{i}" for i in range(6)]
    data = [(str(i), *map(float, p), int(t)) for i, (p, t) in enumerate(zip(x, y))]
    names = ", ".join(f"{c} double" for c in columns)
    df = spark.createDataFrame(data, f"row_id string, {names}, {LABEL} int").repartition(12, "row_id")
    train, test = df.filter("row_id >= 600"), df.filter("row_id < 600")
    for partitions, batch in dealt:
        settings(spark, partitions, batch)
        votes = prepare.knn_votes(train, test, columns, "row_id", k=5)
        got = {r["row_id"]: r["y_test_prob"] for r in votes.collect()}
        assert len(got) == 600
        for i in range(600):
            near = np.argsort(((x[600:] - x[i]) ** 2).sum(1), kind="stable")[:5]
            assert got[str(i)] == pytest.approx(y[600:][near].mean())


def test_knn_copies_unknown_features_and_no_train_rows(spark):
    schema = f"row_id string, a double, {LABEL} int"
    train = spark.createDataFrame([("1", 0.0, 1), ("2", 0.0, 0), ("3", 0.0, 1), ("4", 9.0, 0), ("5", None, 1)], schema)
    test = spark.createDataFrame([("6", 1.0, 1), ("7", None, 0), (None, 8.0, None)], schema)
    got = {r["row_id"]: r for r in prepare.knn_votes(train, test, ["a"], "row_id", k=2).collect()}
    assert got["6"]["y_test_prob"] == pytest.approx(2 / 3) and got["6"]["y_test_prediction"] == 1
    assert got["7"]["y_test_prob"] is None and got["7"]["y_test_prediction"] is None
    assert got[None]["y_test_prob"] == pytest.approx(1 / 3) and got[None]["y_test"] is None
    few = prepare.knn_votes(train, test.limit(1), ["a"], "row_id", k=50).first()
    assert few["y_test_prob"] == pytest.approx(0.5)
    none = prepare.knn_votes(train.limit(0), test, ["a"], "row_id")
    assert [r["y_test_prob"] for r in none.collect()] == [None] * 3


def test_new_rows_lie_between_nearest_neighbours(spark, dealt):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4))
    columns = list("abcd")
    data = [(str(i), *map(float, p), int(i < 200)) for i, p in enumerate(x)]
    df = spark.createDataFrame(data, f"row_id string, a double, b double, c double, d double, {LABEL} int")
    seen = []
    for partitions, batch in dealt:
        settings(spark, partitions, batch)
        out = prepare.smote(df, columns, "row_id").filter("row_id is null")
        seen.append(sorted(tuple(r[c] for c in columns) for r in out.collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 300
    gaps = ((x[:200, None] - x[None, :200]) ** 2).sum(2)
    near = np.argsort(gaps, axis=1, kind="stable")[:, 1:6]
    start, way = np.repeat(x[:200], 5, axis=0), (x[near] - x[:200, None]).reshape(-1, 4)
    for point in np.array(seen[0]):
        step = ((point - start) * way).sum(1) / (way**2).sum(1)
        off = ((start + np.clip(step, 0, 1)[:, None] * way - point) ** 2).sum(1)
        assert off.min() < 1e-18


def test_neighbour_join_equals_brute_force(spark, dealt, monkeypatch):
    """Many cells and parts on both sides, ties, points far out, and a dense spot."""
    monkeypatch.setattr(neighbours, "PART", 128)
    monkeypatch.setattr(neighbours, "ASKED", 64)
    rng = np.random.default_rng(7)
    columns = [f"c{i}" for i in range(5)]
    x = np.round(rng.normal(size=(4000, 5)) * [1, 1, 1, 5, 1000] + rng.integers(0, 4, size=(4000, 1)) * 40, 1)
    x[:700] = np.round(rng.normal(size=(700, 5)) * 0.3, 1)
    x[700] = 1e12
    rows = spark.createDataFrame([tuple(map(float, p)) for p in x], ", ".join(f"{c} double" for c in columns))
    want = None
    for partitions, batch in dealt:
        settings(spark, partitions, batch)
        points = neighbours.distinct_points(rows.repartition(5), columns, "point")
        if want is None:
            held = points.orderBy("point").toPandas()
            p = held[columns].to_numpy()
            assert len(p) < 4000 and (p == np.array(sorted(map(tuple, p)))).all()
            want = set()
            for i, own in enumerate(p):
                gap = ((p - own) ** 2).sum(1)
                for j in np.argsort(gap, kind="stable")[:4]:
                    want.add((tuple(own), tuple(p[j]), gap[j]))
        at = {r["point"]: tuple(r[c] for c in columns) for r in points.collect()}
        found = neighbours.nearest_points(points.withColumnRenamed("point", "ask"), points, columns, 4).collect()
        assert {(at[r["ask"]], at[r["point"]], r["gap"]) for r in found} == want and len(found) == len(want)


def test_neighbours_of_another_frame_and_of_few(spark):
    columns = ["a", "b"]
    points = neighbours.distinct_points(spark.createDataFrame([(0.0, 0.0), (3.0, 4.0), (0.0, 0.0)], "a double, b double"), columns, "point")
    asked = neighbours.distinct_points(
        spark.createDataFrame([(0.0, 1.0), (None, 1.0), (float("inf"), 0.0), (float("nan"), 2.0)], "a double, b double"), columns, "ask"
    )
    assert sorted(r["weight"] for r in points.collect()) == [1, 2] and asked.count() == 1
    found = neighbours.nearest_points(asked, points, columns, 5).orderBy("rank").collect()
    assert [(r["gap"], r["rank"]) for r in found] == [(1.0, 1), (18.0, 2)]
    assert neighbours.nearest_points(asked, points.limit(0), columns, 5).collect() == []


def test_smote_repeats_rows_without_a_place(spark):
    data = [("1", 1.0, 1), ("2", None, 1), *[(str(i), 2.0, 0) for i in range(3, 11)]]
    out = prepare.smote(spark.createDataFrame(data, f"row_id string, a double, {LABEL} int"), ["a"], "row_id")
    new = [r["a"] for r in out.filter("row_id is null").collect()]
    assert sorted(new, key=str) == [1.0, 1.0, 1.0, None, None, None]


@pytest.mark.parametrize("fit", [
    lambda v: models.logistic_regression().fit(v),
    lambda v: models.fit_ada_boost(v, rounds=8),
    lambda v: models.fit_extra_trees(v, 3, trees=4),
    lambda v: models.bagging(5).fit(v),
    lambda v: models.linear_svc().fit(v),
    lambda v: models.soft_voting([
        models.decision_tree().fit(v),
        models.soft_voting([models.logistic_regression().fit(v), models.random_forest(numTrees=5).fit(v)]),
    ]),
    lambda v: models.fit_stacking(
        models.with_folds(v, 2), [models.decision_tree(), models.logistic_regression()], folds=2),
])
def test_models_learn(vectors, fit):
    model = fit(vectors)
    predictions = models.score(model, vectors, ["row_id"])
    assert predictions.count() == 1200
    probs = predictions.agg(F.min("y_test_prob"), F.max("y_test_prob")).first()
    assert 0 <= probs[0] <= probs[1] <= 1
    assert f1(predictions) > 0.55


def brute_extra_trees(x, y, trees, depth, rng):
    """Extra trees node by node, the usual way."""

    def grow(at, level):
        ones = y[at].mean()
        varies = np.flatnonzero(x[at].max(0) > x[at].min(0)) if len(at) > 1 else []
        if level == depth or ones in (0, 1) or not len(varies):
            return ones
        best = None
        for f in rng.permutation(varies)[: max(1, round(x.shape[1] ** 0.5))]:
            cut = rng.uniform(x[at, f].min(), x[at, f].max())
            left = x[at, f] < cut
            if left.all() or not left.any():
                continue
            cost = sum(y[s].mean() * (1 - y[s].mean()) * len(s) for s in (at[left], at[~left]))
            if best is None or cost < best[0]:
                best = cost, f, cut, left
        if best is None:
            return ones
        return best[1], best[2], grow(at[best[3]], level + 1), grow(at[~best[3]], level + 1)

    def ask(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node

    made = [grow(np.arange(len(x)), 0) for _ in range(trees)]
    return lambda rows: np.array([np.mean([ask(t, r) for t in made]) for r in rows])


def test_extra_trees(spark, vectors, dealt):
    """As good as trees grown node by node, a cut of its own in every node, equal for any dealing."""
    held = vectors.collect()
    x = np.array([r["features"].toArray() for r in held])
    y = np.array([r[LABEL] for r in held])
    learn = np.array([int(r["row_id"]) % 4 != 0 for r in held])
    brute = brute_extra_trees(x[learn], y[learn], 60, 8, np.random.default_rng(1))
    want = ((brute(x[~learn]) > 0.5) == y[~learn]).mean()
    seen = []
    for partitions, batch in dealt:
        settings(spark, partitions, batch)
        model = models.fit_extra_trees(vectors.filter("row_id % 4 != 0").repartition(partitions), 3, trees=60, depth=8)
        got = models.score(model, vectors.filter("row_id % 4 = 0"), ["row_id"]).collect()
        seen.append({r["row_id"]: r["y_test_prob"] for r in got})
    assert seen[0] == seen[1] and len(seen[0]) == (~learn).sum()
    right = np.mean([r["y_test"] == r["y_test_prediction"] for r in got])
    assert abs(right - want) < 0.02 and want > 0.85
    forest = model.forest
    inner = forest.feature >= 0
    assert inner.sum() > 60 * 20 and len(set(forest.cut[inner])) == inner.sum()
    assert (forest.left[inner] > np.flatnonzero(inner)).all()
    entropy = models.fit_extra_trees(vectors, 3, trees=5, depth=3, criterion="entropy")
    assert len(entropy.forest.feature) <= 5 * 15


def test_extra_trees_of_few_rows(spark, vectors):
    one = vectors.filter(F.col(LABEL) == 1)
    assert models.score(models.fit_extra_trees(one, 3, trees=3), one, ["row_id"]).filter("y_test_prob <> 1").count() == 0
    none = models.fit_extra_trees(vectors.limit(0), 3, trees=3)
    assert models.score(none, vectors, ["row_id"]).filter("y_test_prob <> 0").count() == 0


def test_gaussian_bayes_follows_its_formula(vectors):
    held = vectors.orderBy("row_id").collect()
    x = np.array([r["features"].toArray() for r in held])
    y = np.array([r[LABEL] for r in held])
    for smoothing in (1e-9, 0.5):
        logs = []
        for c in (0, 1):
            mean, var = x[y == c].mean(0), x[y == c].var(0) + smoothing * x.var(0).max()
            logs.append(np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * var) + (x - mean) ** 2 / var).sum(1))
        want = 1 / (1 + np.exp(logs[0] - logs[1]))
        scored = models.score(models.gaussian_nb(smoothing).fit(vectors), vectors, ["row_id"])
        got = [r["y_test_prob"] for r in scored.orderBy("row_id").collect()]
        assert got == pytest.approx(want.tolist(), abs=1e-9)


def test_saved_models_score_alike(vectors, tmp_path):
    made = {
        "boosted": models.fit_ada_boost(vectors, rounds=3),
        "extra": models.fit_extra_trees(vectors, 3, trees=3, depth=4),
        "bayes": models.gaussian_nb().fit(vectors),
        "stacked": models.fit_stacking(
            models.with_folds(vectors, 2), [models.decision_tree(), models.gaussian_nb()], folds=2),
    }
    made["voting"] = models.soft_voting([made["boosted"], models.soft_voting([made["extra"], made["bayes"]])])
    for name, model in made.items():
        models.save_model(model, f"{tmp_path}/{name}")
        again = type(model).load(f"{tmp_path}/{name}")
        one, two = ({r["row_id"]: r["y_test_prob"] for r in models.score(m, vectors, ["row_id"]).collect()} for m in (model, again))
        assert one == two


def test_search_over_families_resumes(spark, vectors, tmp_path):
    folds = models.with_folds(vectors, 3)
    fits = []

    def counted(rows, **params):
        fits.append(params)
        return models.logistic_regression(**params).fit(rows)

    groups = search.grid("logistic", counted, {"regParam": [0.0, 0.1]})
    groups += search.grid("gnb", lambda rows, **p: models.gaussian_nb(**p).fit(rows), {"smoothing": [1e-9]})
    groups += search.boosting_grid([1.0], [1, 3])
    path = f"{tmp_path}/ledger"
    search.search(folds, groups[:1], 1, path)
    assert len(fits) == 1
    ledger = search.search(folds, groups, 3, path)
    assert len(fits) == 6  # one of the six was there
    rows = {(r["family"], r["params"]): r for r in search.ranking(ledger).collect()}
    assert len(rows) == 5 and all(r["folds"] == 3 for r in rows.values())
    search.search(folds, groups, 3, path)
    assert len(fits) == 6
    # The metric of one point equals Spark ML's own, up to the steps of the curve.
    model = models.logistic_regression(regParam=0.1)
    judge = BinaryClassificationEvaluator(labelCol=LABEL, metricName="areaUnderPR", numBins=0)
    want = [judge.evaluate(model.fit(folds.filter(f"fold != {f}")).transform(folds.filter(f"fold = {f}"))) for f in range(3)]
    assert rows["logistic", "regParam=0.1"]["metric"] == pytest.approx(np.mean(want), abs=0.005)
    assert rows["ada", "rate=1.0, rounds=3"]["accuracy"] >= rows["ada", "rate=1.0, rounds=1"]["accuracy"] - 0.02


def test_grids_cover_every_family():
    groups = search.all_grids(3)
    assert {g.family for g in groups} == set(models.GRIDS)
    assert sum(len(g.points) for g in groups) == 4 + 4 + 18 + 18 + 12 + 2


def test_importance_finds_the_signal(rows, vectors):
    model = models.logistic_regression().fit(vectors)

    def score(m, df, keep):
        return m.transform(prepare.select_features(df, COLUMNS, ["row_id", *keep]))

    out = evaluate.permutation_importance(model, rows, COLUMNS, LABEL, "row_id", score, repeats=2)
    got = {r["feature"]: r["importance"] for r in out.collect()}
    assert got["a"] > 0.05 and got["b"] > 0.05 and abs(got["noise"]) < 0.02


def test_shuffled_is_a_permutation(rows):
    mixed = evaluate.shuffled(rows, "a", "row_id", 5)
    values = sorted(r["a"] for r in rows.collect())
    assert sorted(r["a"] for r in mixed.collect()) == values
    kept = mixed.join(rows.select("row_id", F.col("a").alias("was")), "row_id")
    assert kept.filter("a = was").count() < 20


def test_scaling(rows):
    scaled = prepare.standard_scale(rows, COLUMNS).transform(rows)
    row = scaled.agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).first()
    assert row["m"] == pytest.approx(0, abs=1e-9) and row["s"] == pytest.approx(1)
    top = prepare.max_scale(rows, COLUMNS).transform(rows).agg(F.max("b")).first()[0]
    assert top == pytest.approx(1)


def test_class_factors_rebuild_the_flags(spark):
    """Products of one pattern share a unit factor; patterns without flags have none."""
    products = spark.createDataFrame(
        [(i, ["A", "B", "C", "Z"][i % 4]) for i in range(80)], "iid int, classid string")
    groups = {"is_a": ["A"], "is_b": ["B"], "is_c": ["C"]}
    got = features.reduced_class_features(products, "iid", groups).join(products, "iid").collect()
    assert len(got) == 80
    vec = {r["classid"]: np.array([r[f"p_reduced_feat_{i}"] for i in (1, 2, 3)]) for r in got}
    for a in "ABC":
        assert np.linalg.norm(vec[a]) == pytest.approx(1, abs=1e-6)
        for b in "ABC":
            if a != b:
                assert vec[a] @ vec[b] < 0.05
    assert np.linalg.norm(vec["Z"]) < 1e-6
