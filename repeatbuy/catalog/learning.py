"""Preparation, models and evaluation. Evaluation on the fixed score has exact SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.catalog.registry import query
from repeatbuy.functions.fixed import (
    CATEGORY,
    ITEM_FEATURES,
    LABEL,
    RATIO_FEATURES,
    REDUCED_FEATURES,
    STACKED_FEATURES,
)
from repeatbuy.functions.skew import attach
from repeatbuy.operators import evaluate, features, holdout, models, prepare, search
from repeatbuy.plans import inputs
from repeatbuy.plans.staging import fresh_path, stage
from repeatbuy.plans.workspace import ROW
from repeatbuy.sources import tables
from repeatbuy.sources.fixture import FIXTURE_GROUPS


def fixed_scores(ws):
    """Prediction frame whose score is the customer's re-order rate of the category."""
    labels = holdout.label_set(ws.category.lines, CATEGORY, 1)
    history = ws.category.lines.filter(F.col("from_last") > 1)
    rate = features.pair_reorder_rate(history, CATEGORY)
    # Both are grouped by the pair: the join needs no further shuffle.
    return labels.join(rate, ["cid", "catid"]).select(
        "cid", "catid", F.col(LABEL).alias("y_test"),
        F.col("u_t_reorder_rate").alias("y_test_prob"),
        (F.col("u_t_reorder_rate") > 0.5).cast("int").alias("y_test_prediction"),
    )




def scale_inputs(ws):
    """A small exact table to scale: gap, lines and rates of the train holdout."""
    labels = holdout.label_set(ws.category.lines, CATEGORY, 2, context=True)
    pairs = features.pair_summary(ws.category.lines, "catid", "cat_reordered", 2)
    return labels.join(pairs, ["cid", "catid"]).select(
        "cid", "catid", "days_since_prior_order", "u_t_lines", "u_t_reorder_rate",
        "u_t_orders_since_last",
    )


SCALE_COLUMNS = [
    "days_since_prior_order", "u_t_lines", "u_t_reorder_rate", "u_t_orders_since_last",
]


def summed(vectors, *keys):
    """Length and sum of the feature vector: shows that every feature arrived."""
    x = vector_to_array("features")
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return vectors.select(
        *keys, LABEL, F.size(x).alias("n_features"), total.alias("feature_sum")
    )


def stacked_test(ws):
    """Test rows of the stacked input with the reduced class features."""
    rows = inputs.stack(ws.holdouts).filter(F.col("split") == "test")
    return attach(rows, ws.reduced, ["catid"], sizes=ws.sizes("category")).fillna(0, subset=RATIO_FEATURES)


@query("p01_select_features_item")
def _(ws):
    reduced = features.reduced_class_features(ws.raw, "iid", FIXTURE_GROUPS)
    rows = inputs.model_input_item(ws.item, 1, reduced)
    return summed(prepare.select_features(rows, ITEM_FEATURES, ["cid", "iid"]), "cid", "iid")


@query("p01_select_features_cat")
def _(ws):
    return summed(ws.frames.vectors("test"), ROW)


@query("p01_select_features_stacked")
def _(ws):
    vectors = prepare.select_features(stacked_test(ws), STACKED_FEATURES, ["cid", "catid"])
    return summed(vectors, "cid", "catid")


@query("p02_standard_scale")
def _(ws):
    rows = scale_inputs(ws)
    return prepare.standard_scale(rows, SCALE_COLUMNS).transform(rows)


@query("p03_max_scale")
def _(ws):
    rows = scale_inputs(ws)
    return prepare.max_scale(rows, SCALE_COLUMNS).transform(rows)


@query("p04_smote")
def _(ws):
    return ws.frames.balanced


@query("p05_reduced_features")
def _(ws):
    frames = ws.frames
    model = models.gradient_boosting(maxIter=5).fit(frames.vectors("balanced"))
    names = models.pick_reduced(models.model_importance(model, frames.columns), 15)
    kept = prepare.reduced_features(frames.vectors("test"), names)
    x = vector_to_array("features")
    return kept.select(ROW, LABEL, *[x[i].alias(n) for i, n in enumerate(names)])


@query("p05_reduced_features_fixed")
def _(ws):
    """The fixed list of fifteen, cut out of the stacked feature vector by name."""
    vectors = prepare.select_features(stacked_test(ws), STACKED_FEATURES, ["cid", "catid"])
    x = vector_to_array("features")
    kept = prepare.reduced_features(vectors, REDUCED_FEATURES)
    return kept.select(
        "cid", "catid", LABEL, *[x[i].alias(n) for i, n in enumerate(REDUCED_FEATURES)]
    )


def fitted(ws, name):
    """One fitted model per kind and workspace."""
    if name not in ws.fitted:
        train, n = ws.train_vectors, len(ws.frames.columns)
        fits = {
            "logistic": lambda: models.logistic_regression(maxIter=50).fit(train),
            "gnb": lambda: models.gaussian_nb().fit(train),
            "tree": lambda: models.decision_tree(maxDepth=8).fit(train),
            "forest": lambda: models.random_forest(
                numTrees=100, maxDepth=8, minInstancesPerNode=10
            ).fit(train),
            "extra": lambda: models.fit_extra_trees(train, n),
            "ada": lambda: models.fit_ada_boost(train, rounds=10),
            "boosted": lambda: models.gradient_boosting(maxIter=10, maxDepth=4).fit(train),
            "svc": lambda: models.linear_svc(maxIter=20).fit(train),
            "mlp": lambda: models.mlp(n, maxIter=30).fit(train),
            "bagging": lambda: models.bagging(10, maxDepth=8).fit(train),
        }
        ws.fitted[name] = fits[name]()
    return ws.fitted[name]


def predictions(ws, model, split="test"):
    return models.score(model, ws.frames.vectors(split), [ROW])


for _q, _name in (
    ("m01_logistic_regression", "logistic"),
    ("m02_gaussian_nb", "gnb"),
    ("m03_decision_tree", "tree"),
    ("m04_random_forest", "forest"),
    ("m05_extra_trees", "extra"),
    ("m06_ada_boost", "ada"),
    ("m07_gradient_boosting", "boosted"),
    ("m08_linear_svc", "svc"),
    ("m10_mlp", "mlp"),
    ("m11_bagging", "bagging"),
):

    @query(_q)
    def _(ws, name=_name):
        return predictions(ws, fitted(ws, name))


def bayes_rows(ws):
    """The small exact table with its label, as vectors."""
    labels = holdout.label_set(ws.category.lines, CATEGORY, 2, context=True)
    pairs = features.pair_summary(ws.category.lines, "catid", "cat_reordered", 2)
    rows = labels.join(pairs, ["cid", "catid"])
    return stage(prepare.select_features(rows, SCALE_COLUMNS, ["cid", "catid"]), "bayes")


@query("m02_gaussian_nb_smoothed")
def _(ws):
    """Probabilities with a hundredth of the greatest variance added, on columns SQL can follow."""
    rows = bayes_rows(ws)
    return models.score(models.gaussian_nb(1e-2).fit(rows), rows, ["cid", "catid"])


@query("m09_knn")
def _(ws):
    frames = ws.frames
    return prepare.knn_votes(frames.balanced, frames.test, frames.columns, ROW, k=10)


@query("m09_knn_error_curve")
def _(ws):
    frames = ws.frames
    votes = prepare.knn_votes(frames.balanced, frames.test, frames.columns, ROW, up_to=39)
    return prepare.knn_error_curve(votes)


@query("m12_soft_voting")
def _(ws):
    voters = [fitted(ws, n) for n in ("boosted", "forest", "extra")]
    return predictions(ws, models.soft_voting(voters))


def folded(ws, folds):
    rows = prepare.select_features(ws.frames.train, ws.frames.columns, ["cid", ROW])
    return models.with_folds(rows, folds)


@query("m13_stacking")
def _(ws):
    train = stage(folded(ws, 3), "folds")
    bases = [
        models.random_forest(numTrees=10, maxDepth=6),
        models.gradient_boosting(maxIter=5, maxDepth=3),
        models.mlp(len(ws.frames.columns), hidden=(12, 8), maxIter=20),
    ]
    return predictions(ws, models.fit_stacking(train, bases))


@query("m14_grid_search")
def _(ws):
    train = stage(folded(ws, 3), "folds")
    grid = {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 1.0]}
    found = models.grid_search(train, models.logistic_regression(maxIter=20), grid, folds=3)
    return models.grid_results(found)


@query("m14_grid_search_ada")
def _(ws):
    """Boosted stumps are fitted by a function; same search, same metric."""
    train = stage(folded(ws, 2), "folds")
    return models.search_fits(train, models.fit_ada_boost, {"rounds": [2, 4]}, folds=2)


@query("m14_search_families")
def _(ws):
    """Points of several families over ten stored folds, from one ledger; a second call finds nothing
    left to do. The grids of trees and boosting take hours here and are left to callers."""
    train = stage(folded(ws, 10), "folds")
    few = {k: models.GRIDS[k] for k in ("logistic", "gnb")}
    groups = search.all_grids(len(ws.frames.columns), few) + search.boosting_grid([0.1, 1.0], [2, 5])
    ledger = fresh_path(ws.spark, "ledger")
    search.search(train, groups, 10, ledger)
    return search.ranking(search.search(train, groups, 10, ledger))


@query("m15_batch_training")
def _(ws):
    frames = ws.frames
    runs = {
        "plain": prepare.select_features(frames.train, frames.columns, [ROW]),
        "balanced": frames.vectors("balanced"),
    }

    def measure(model, run):
        return evaluate.classification_report(predictions(ws, model))

    return models.train_runs(runs, models.decision_tree(maxDepth=6).fit, measure)


@query("m16_save_model")
def _(ws):
    path = fresh_path(ws.spark, "model")
    models.save_model(fitted(ws, "logistic"), path)
    return models.model_importance(LogisticRegressionModel.load(path), ws.frames.columns)


@query("m16_save_ensembles")
def _(ws):
    """Each ensemble written, read back, and its mean score before and after."""
    rows, out = ws.frames.vectors("test"), []
    voters = models.soft_voting([fitted(ws, "logistic"), fitted(ws, "extra")])
    for name, model in (("ada", fitted(ws, "ada")), ("extra", fitted(ws, "extra")), ("voting", voters)):
        path = fresh_path(ws.spark, "model")
        models.save_model(model, path)
        again = type(model).load(path)
        kept, found = (models.score(m, rows, [ROW]).select(ROW, F.col("y_test_prob").alias(c))
                       for m, c in ((model, "kept"), (again, "found")))
        out.append(kept.join(found, ROW).select(
            F.lit(name).alias("model"), ROW, "kept", "found", (F.col("kept") == F.col("found")).alias("equal")))
    return reduce(DataFrame.unionByName, out)


@query("v01_score")
def _(ws):
    return predictions(ws, fitted(ws, "forest"))


@query("v02_apply_threshold")
def _(ws):
    return evaluate.apply_threshold(fixed_scores(ws), 0.25, "predicted")


@query("v03_best_threshold")
def _(ws):
    return evaluate.best_threshold(fixed_scores(ws))


@query("v03_threshold_scores")
def _(ws):
    return evaluate.threshold_scores(fixed_scores(ws))


@query("v04_confusion_matrix")
def _(ws):
    return evaluate.confusion_matrix(fixed_scores(ws))


@query("v05_classification_report")
def _(ws):
    return evaluate.classification_report(fixed_scores(ws))


@query("v06_permutation_importance")
def _(ws):
    frames = ws.frames
    model = fitted(ws, "forest")

    def score(m, rows, keep):
        return m.transform(prepare.select_features(rows, frames.columns, [ROW, *keep]))

    return evaluate.permutation_importance(model, frames.test, frames.columns, LABEL, ROW, score)


@query("v07_model_importance")
def _(ws):
    return models.model_importance(fitted(ws, "forest"), ws.frames.columns)


@query("v08_precision_at_recall")
def _(ws):
    return evaluate.precision_at_recall(fixed_scores(ws))


@query("v09_train_scores")
def _(ws):
    return predictions(ws, fitted(ws, "forest"), "train")


@query("v10_cv_accuracy")
def _(ws):
    train = stage(folded(ws, 5), "folds")
    return models.cv_accuracy(train, models.logistic_regression(maxIter=20), folds=5)


@query("s11_write_report")
def _(ws):
    path = fresh_path(ws.spark, "reports")
    for name in ("logistic", "tree"):
        report = evaluate.classification_report(predictions(ws, fitted(ws, name)))
        tables.write_report(report, path, name, "standard", "1")
    return ws.spark.read.parquet(path)


