"""The registered queries. Each runs a library operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.text import delta_text, metric_text, params_text
from cohortlab.models import attribution as att
from cohortlab.models import mlp
from cohortlab.models.base import with_probability
from cohortlab.models.boosting import NODE_SCHEMA
from cohortlab.models.catalogue import CATALOGUE, make_model, models_catalogue
from cohortlab.operators import clean, compare, importance, metrics, preprocess, profile, sampling
from cohortlab.operators.allocate import allocate
from cohortlab.operators.augment import LABELS, resize
from cohortlab.operators.neighbors import nearest_neighbors
from cohortlab.operators.smote import (
    class_counts,
    generated_rows,
    info_table,
    kinds_table,
    sampling_info,
    smote,
    sum_sampling,
)
from cohortlab.plans.pipeline import Settings, fill_scores, fit_score, specialists
from cohortlab.plans.report import report_tables, strategy_document
from cohortlab.plans.studies import compare_smote, compare_strategies, explain_cohorts, run_variant, variant_result
from cohortlab.plans.tuning import tune
from cohortlab.session import shared_dir, side_by_side, stage
from cohortlab.sources import tables
from registry import fixtures as fx
from registry.fixtures import COHORTS, CUSTOMERS, ORDERS, SEED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STRATA = [(label, cohort) for label in LABELS for cohort in COHORTS]


def query(f: Query) -> Query:
    QUERIES[f.__name__.rstrip("_")] = f
    return f


def r(value, name: str | None = None, digits: int = 6):
    """Rounded double without a negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    out = F.round(column.cast("double"), digits) + F.lit(0.0)
    return out.alias(name or value) if name or isinstance(value, str) else out


# ---- sources, cleaning -------------------------------------------------------

@query
def scan_orders(spark, sf):
    return fx.source(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query
def clean_raw_headers(spark, sf):
    """A file without a key, its headers in words."""
    raw = fx.orders(spark, sf).drop("row_id")
    raw = raw.toDF(*[c.replace("_", " ").title() for c in raw.columns])
    return preprocess.clean_raw(raw, ORDERS).drop("row_id")


@query
def cohort_split(spark, sf):
    path = f"{shared_dir(spark)}/staged/cohorts-{uuid.uuid4().hex}"
    tables.write_by_cohort(fx.orders_by_cohort(spark, sf), path, "cohort")
    back = tables.read_table(spark, path)
    return back.groupBy("cohort").agg(F.count("*").alias("n"), r(F.sum("totalprice"), "total", 2))


@query
def results_json(spark, sf):
    counts = class_counts(fx.orders_by_cohort(spark, sf), "label", ["cohort"])
    nested = counts.select(
        "cohort",
        F.create_map(F.lit(0), "class_0", F.lit(1), "class_1").alias("counts"),
        F.array("class_0", "class_1").alias("pair"),
        F.lit(float("nan")).alias("roc_auc"),
    )
    return tables.results_text(nested)


@query
def dedup_rows(spark, sf):
    table = fx.orders(spark, sf).drop("row_id")
    return clean.dedup_rows(table.unionByName(table))


@query
def dedup_keyed(spark, sf):
    """Copies of every order under new keys fall back to the smallest key."""
    table = fx.orders(spark, sf)
    copies = table.withColumn("row_id", F.col("row_id") + 1_000_000_000_000)
    return clean.dedup_rows(table.unionByName(copies), "row_id")


@query
def drop_sentinel(spark, sf):
    """Priority 5 is the sentinel; priority 4 stands in for a missing value, which stays."""
    table = fx.orders(spark, sf).withColumn("prio", F.when(F.col("prio") != 4, F.col("prio")))
    return clean.drop_sentinel(table, "prio", 5).select("row_id", "prio")


@query
def cohort_raw(spark, sf):
    return fx.orders_by_cohort(spark, sf).select("row_id", "cohort")


@query
def cohort_scaled(spark, sf):
    table = fx.orders(spark, sf)
    scaler = preprocess.fit_scaler(table, ["acctbal"])
    bounds = scaler.cutoffs("acctbal", ORDERS.cutoffs)
    scaled = preprocess.apply_scaler(table, scaler)
    return clean.assign_cohort(scaled, "acctbal", bounds, COHORTS, "cohort").select("row_id", "cohort")


# ---- preprocessing -----------------------------------------------------------

@query
def scaler_fit(spark, sf):
    return preprocess.scaler_table(fx.orders(spark, sf), ORDERS.numeric).select("column", r("mean"), r("std"))


@query
def scaler_apply(spark, sf):
    table = fx.orders(spark, sf)
    scaled = preprocess.apply_scaler(table, preprocess.fit_scaler(table, ORDERS.numeric))
    return scaled.select("row_id", *[r(c) for c in ORDERS.numeric])


@query
def one_hot(spark, sf):
    return preprocess.one_hot(fx.orders(spark, sf), ORDERS.categorical).select("row_id", *ORDERS.dummies)


@query
def scaled_cutoffs(spark, sf):
    found = preprocess.prepare(fx.orders(spark, sf), ORDERS)
    low, high = found.cutoffs
    stats = preprocess.scaler_table(found.train_raw, ["acctbal"])
    return stats.select(
        r(F.lit(low), "low"), r(F.lit(high), "high"), r("mean"), r("std")
    )


def _processed(df):
    return df.select("row_id", *[r(c) for c in ORDERS.features], "label", "cohort")


@query
def preprocess_train(spark, sf):
    return _processed(preprocess.prepare(fx.orders(spark, sf), ORDERS).train)


@query
def prepare_test_side(spark, sf):
    return _processed(preprocess.prepare(fx.orders(spark, sf), ORDERS).test)


# ---- allocation, sampling, synthesis -----------------------------------------

@query
def stratified_split(spark, sf):
    train, test = sampling.stratified_split(fx.orders(spark, sf), "row_id", "label", 0.3, SEED)
    sides = [s.select("row_id", "label", F.lit(n).alias("side")) for n, s in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


@query
def stratified_split_texts(spark, sf):
    train, test = sampling.stratified_split(fx.texts(spark, sf), "row_id", "label", 0.3, SEED)
    sides = [s.select("row_id", "label", F.lit(n).alias("side")) for n, s in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


@query
def split_many_classes(spark, sf):
    """150 classes: the customers' keys by remainder."""
    table = fx.orders(spark, sf).drop("label").join(
        fx.source(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 150).cast("int").alias("label")),
        "row_id",
    ).select("row_id", "label")
    enough = table.groupBy("label").count().filter("count >= 2").select("label")
    train, test = sampling.stratified_split(table.join(enough, "label", "left_semi"), "row_id", "label", 0.3, SEED)
    sides = [s.select("row_id", "label", F.lit(n).alias("side")) for n, s in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


@query
def allocate_counts(spark, sf):
    return allocate(fx.orders_by_cohort(spark, sf), ["label", "cohort"], STRATA, 100_000)


@query
def downsample_exact(spark, sf):
    table = fx.orders_by_cohort(spark, sf)
    return sampling.downsample(table, "row_id", ["label", "cohort"], STRATA, table.count() // 3, SEED).select(
        "row_id", "label", "cohort"
    )


@query
def resize_shrink(spark, sf):
    """The dispatcher's downsampling branch, cohorts from the given bounds."""
    table = fx.customers(spark, sf)
    return resize(table, CUSTOMERS, table.count() // 2, CUSTOMERS.cutoffs, SEED).select("row_id", "label")


def _rounded(df, spec):
    return df.select("row_id", *[r(c) for c in spec.features], "label")


@query
def augment_rows(spark, sf):
    table = fx.customers(spark, sf)
    return _rounded(resize(table, CUSTOMERS, 3 * table.count(), CUSTOMERS.cutoffs, SEED), CUSTOMERS)


@query
def augment_sparse_pool(spark, sf):
    """The upper cut-off is the second largest balance of class 1, so that
    class has a single row in the top cohort and borrows its parents."""
    table = fx.customers(spark, sf)
    top = table.filter("label = 1").select("acctbal").distinct().orderBy(F.desc("acctbal")).limit(2).collect()
    return _rounded(resize(table, CUSTOMERS, 4 * table.count(), (2.0, top[1][0]), SEED), CUSTOMERS)


@query
def number_members(spark, sf):
    table = fx.orders_by_cohort(spark, sf)
    offsets = {c: 0 for c in COHORTS}
    return sampling.number_rows(table, "row_id", "cohort", offsets, SEED, "member").select("row_id", "cohort", "number")


@query
def class_counts_(spark, sf):
    return class_counts(fx.orders_by_cohort(spark, sf), "label", ["cohort"])


@query
def column_kinds(spark, sf):
    table = preprocess.one_hot(fx.orders(spark, sf), ORDERS.categorical)
    table = table.withColumn("pricey", (F.col("totalprice") > 100_000).cast("int"))
    return kinds_table(table, [*ORDERS.features, "pricey"], ORDERS.dummy_groups.values(), ["near"])


def _neighbors(found):
    return found.select("query", F.col("rank").cast("int").alias("rank"), "neighbor", r("distance"))


@query
def knn_minority(spark, sf):
    rare = fx.vectors(spark, sf).filter("digit = 0")
    return _neighbors(nearest_neighbors(rare, rare, ["embedding"], 5, "row_id", skip_self=True))


@query
def knn_vectors(spark, sf):
    table = fx.vectors(spark, sf)
    return _neighbors(nearest_neighbors(table, table, ["embedding"], 5, "row_id", skip_self=True, cell_rows=64, small=0))


def order_points(spark, sf):
    return fx.orders(spark, sf).select(
        "row_id", "label", (F.col("acctbal") / 1000).alias("x"), (F.col("totalprice") / 50_000).alias("y"),
        (F.col("order_days") / 250).alias("z"),
    )


@query
def knn_orders(spark, sf):
    """Neighbours inside the smaller class of all orders, searched cell by cell."""
    rare = order_points(spark, sf).filter("label = 1")
    found = nearest_neighbors(rare, rare, ["x", "y", "z"], 5, "row_id", skip_self=True, cell_rows=512, small=0)
    return _neighbors(found)


def _smote(df, spec):
    return smote(df, spec.features, spec.label, spec.row_id, spec.dummy_groups.values(), spec.binary, seed=SEED)


@query
def smote_rows(spark, sf):
    return _rounded(_smote(fx.customers(spark, sf), CUSTOMERS)[0], CUSTOMERS)


def _cohort_infos(spark, sf):
    table = fx.customers_by_cohort(spark, sf)
    infos = {c: sampling_info(clean.cohort_slice(table, c, "cohort"), "label") for c in COHORTS}
    return info_table(spark, infos)


@query
def smote_info(spark, sf):
    return _cohort_infos(spark, sf).select(
        "scope", "applied", "reason", "minority_label",
        *[F.col(f"{when}_counts")[k].alias(f"{when}_{k}") for when in ("before", "after") for k in (0, 1)],
        "generated_samples", "k_neighbors_used",
    )


@query
def smote_single_class(spark, sf):
    """Orders of one status only: nothing to balance."""
    table = fx.orders(spark, sf).filter("label = 1").select("row_id", "acctbal", "label")
    out, info = smote(table, ["acctbal"], "label", "row_id", seed=SEED)
    return out.groupBy("label").agg(F.count("*").alias("n")).withColumns(
        {"applied": F.lit(info.applied), "reason": F.lit(info.reason)}
    )


@query
def sampling_totals(spark, sf):
    return sum_sampling(_cohort_infos(spark, sf))


@query
def generated_rows_(spark, sf):
    return generated_rows(_cohort_infos(spark, sf))


# ---- models ------------------------------------------------------------------

def _sides(spark, sf):
    found = preprocess.prepare(fx.orders(spark, sf), ORDERS)
    return found.train, found.test


def _scores(df):
    return df.select("row_id", "label", "prediction", r("probability"))


def _fitted(spark, sf, key, params=None):
    train, test = _sides(spark, sf)
    return make_model(key, params, SEED).fit(train, ORDERS.features, "label", "row_id"), test


@query
def score_gaussian_nb(spark, sf):
    model, test = _fitted(spark, sf, "naive_bayes")
    return _scores(model.score(test))


@query
def score_knn(spark, sf):
    train, test = sampling.stratified_split(fx.vectors(spark, sf), "row_id", "label", 0.3, SEED)
    model = make_model("knn").fit(train, ["embedding"], "label", "row_id")
    return _scores(model.score(test))


def _checks(key: str, model, train) -> tuple:
    """A row of ``fit_checks``; every check looks at all rows of ``train``."""
    scored = stage(model.score(train), "fit-checks")
    prior = F.expr("-(avg(label) * ln(avg(label)) + (1 - avg(label)) * ln(1 - avg(label)))")
    p = F.least(F.greatest("probability", F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))
    below = loss < prior
    if key == "adaboost":
        share, wrong = F.avg("label"), F.avg((F.col("prediction") != F.col("label")).cast("int"))
        margin = F.log(p / (1 - p)) * sum(s.alpha for s in model.stumps) / 2
        exponential = F.avg(F.exp((1 - 2 * F.col("label")) * margin / 2))
        below = (exponential < 2 * F.sqrt(share * (1 - share))) & (wrong <= F.least(share, 1 - share))
    cut = 1 / (1 + F.exp(-F.lit(model.intercept))) if key == "svm" else F.lit(0.5)
    apart = (F.col("probability") > cut) == (F.col("prediction") == 1)
    follows = F.bool_and(apart | (F.abs(F.col("probability") - cut) < 1e-12))
    row = scored.agg(below.alias("below_prior"), follows.alias("follows")).first()
    ranks = metrics.roc_auc(scored).first()["roc_auc"] > (0.5 if key == "logistic_regression" else 0.55)
    shares = None
    if key == "decision_tree":
        leaves = scored.groupBy("probability").agg(F.avg("label").alias("share"))
        shares = leaves.agg((F.bool_and(F.abs(F.col("share") - F.col("probability")) < 1e-9) & (F.count("*") <= 32)).alias("v")).first()["v"]
    return key, row["below_prior"], ranks, row["follows"], shares


@query
def fit_checks(spark, sf):
    """What a wrong model breaks, for each model fitted by search or descent, on its own training rows.

    ``below_prior``: its mean log-loss is below that of the class shares (AdaBoost, whose
    squashed margins are no shares: the exponential loss that its rounds bring down is below the least of any constant, and its
    error not above that of the class shares). ``ranks``: its ROC-AUC is above 0.55 (logistic regression, linear in the
    features: above 0.5). ``follows``: predictions are 1 where the score is above a half (SVM: above its score at the
    plane). ``shares``: for the decision tree, every score is the share of label 1 among the rows that have it, in at most 2**5 leaves.
    """
    train, _ = _sides(spark, sf)
    train = stage(train, "fit-checks")
    check = lambda key: _checks(key, make_model(key, None, SEED).fit(train, ORDERS.features, "label", "row_id"), train)
    found = side_by_side(spark, check, ("logistic_regression", *SEARCHED))
    return spark.createDataFrame(found, "model_key string, below_prior boolean, ranks boolean, follows boolean, shares boolean")


SEARCHED = ("decision_tree", "random_forest", "xgboost", "lightgbm", "catboost", "mlp", "svm", "adaboost")


@query
def logreg_gradient(spark, sf):
    """Gradient of the penalised loss at the fit, the intercept's with it: near zero for every feature."""
    model, _ = _fitted(spark, sf, "logistic_regression")
    train, _ = _sides(spark, sf)
    names = [*ORDERS.features, "intercept"]
    weights = dict(zip(names, [*model.weights, model.intercept]))
    scored = model.score(train).withColumn("intercept", F.lit(1.0))
    error = F.col("probability") - F.col("label")
    sums = scored.agg(*[(F.sum(error * F.col(c)) + F.lit(weights[c])).alias(c) for c in names], F.count("*").alias("_n"))
    flat = F.array(*[F.struct(F.lit(c).alias("feature"), (F.abs(F.col(c)) < 1e-6 * F.col("_n")).alias("flat")) for c in names])
    return sums.select(F.inline(flat))


#: A perceptron of three inputs, two hidden units and one output: weights, then biases, layer by layer.
MLP_SIZES, MLP_WEIGHTS = (3, 2, 1), (0.5, -0.25, 0.125, 0.75, -0.5, 0.25, 0.1, -0.2, 1.5, -1.0, 0.05)


@query
def mlp_gradient(spark, sf):
    """Mean log-loss of a perceptron over all orders, and its gradient for every weight and bias."""
    rows = fx.order_codes(spark, sf).select(
        (F.col("bal") / 50 - 1).alias("x0"), (F.col("price") / 40 - 1).alias("x1"), (F.col("month") / 40).alias("x2"), F.col("label").cast("double").alias("y")
    )
    sums = mlp.gradient_sums(rows, np.array(MLP_WEIGHTS), MLP_SIZES)
    names = ["loss", *[f"w{i}" for i in range(len(MLP_WEIGHTS))]]
    found = [(n, float(v)) for n, v in zip(names, [sums[1], *sums[3:]] / sums[0])]
    return spark.createDataFrame(found, "name string, value double").select("name", r("value"))


@query
def score_logreg(spark, sf):
    model, test = _fitted(spark, sf, "logistic_regression")
    return _scores(model.score(test))


@query
def score_dt(spark, sf):
    model, test = _fitted(spark, sf, "decision_tree")
    return _scores(model.score(test))


@query
def score_rf(spark, sf):
    model, test = _fitted(spark, sf, "random_forest")
    return _scores(model.score(test))


@query
def score_gbt(spark, sf):
    model, test = _fitted(spark, sf, "xgboost")
    return _scores(model.score(test))


@query
def score_leafwise(spark, sf):
    model, test = _fitted(spark, sf, "lightgbm")
    return _scores(model.score(test))


@query
def score_symmetric(spark, sf):
    model, test = _fitted(spark, sf, "catboost")
    return _scores(model.score(test))


@query
def score_mlp(spark, sf):
    model, test = _fitted(spark, sf, "mlp")
    return _scores(model.score(test))


@query
def score_svm(spark, sf):
    model, test = _fitted(spark, sf, "svm")
    return _scores(model.score(test))


@query
def score_adaboost(spark, sf):
    model, test = _fitted(spark, sf, "adaboost")
    return _scores(model.score(test))


#: Small models whose every split and leaf SQL finds again: key, parameters.
GROWN = {
    "level": ("xgboost", {"n_estimators": 2, "max_depth": 3}),
    "leaf": ("lightgbm", {"n_estimators": 2, "num_leaves": 6}),
    "symmetric": ("catboost", {"iterations": 2, "depth": 3}),
}


@query
def boosted_nodes(spark, sf):
    """All nodes that hold rows, of two trees of each kind of growth."""
    rows = fx.order_codes(spark, sf)
    out = []
    for growth, (key, params) in GROWN.items():
        fitted = make_model(key, params, SEED).fit(rows, fx.CODES, "label", "row_id")
        out += [(growth, *row) for row in fitted.node_rows()]
    table = spark.createDataFrame(out, "growth string, " + NODE_SCHEMA)
    value = F.when(F.col("feature").isNull(), F.col("value"))
    return table.filter("rows > 0").select(
        "growth", "tree", "path", "depth", "feature", "threshold", r("gain"), r("gradient", digits=4), r("curvature", digits=4), "rows", r(value, "value")
    )


@query
def feature_importance(spark, sf):
    """The five features of the largest mean gain in the catalogue's 120 rounds."""
    train, _ = _sides(spark, sf)
    choice = importance.choose_features(train, ORDERS.features, "label", 5, SEED)
    return importance.choice_table(spark, {"overall": choice}).select("scope", "position", "feature", r("importance"))


def _chosen(spark, sf):
    key, params = GROWN["level"]
    choice = importance.choose_features(fx.order_codes(spark, sf), fx.CODES, "label", 3, SEED, params)
    return importance.choice_table(spark, {"overall": choice})


@query
def feature_importance_gains(spark, sf):
    """The same choice from two trees, whose gains SQL finds again."""
    return _chosen(spark, sf).select("scope", "applied", "reason", "position", "feature", r("importance"))


@query
def importance_panels(spark, sf):
    """The chosen features from least to most important, as a chart takes them."""
    series = importance.importance_series(_chosen(spark, sf))
    return series.select("scope", F.row_number().over(Window.partitionBy("scope").orderBy("importance")).alias("place"), "feature", r("importance"))


@query
def catalogue(spark, sf):
    """The models that can be made, and whether each was, with its defaults, over the training rows' features."""
    made = {key: len(make_model(key).params) for key in CATALOGUE}
    rows = models_catalogue(spark).select("position", "model_key", "model_name", "search_iterations", "available", F.size("defaults").cast("int").alias("n_defaults"))
    sizes = spark.createDataFrame([(k, n) for k, n in made.items()], "model_key string, n_params int")
    rare = fx.orders(spark, sf).filter("label = 1").count()
    return rows.join(sizes, "model_key").select(
        "position", "model_key", "model_name", "search_iterations", "available", (F.col("n_defaults") == F.col("n_params")).alias("all_defaults"),
        F.lit(rare).cast("long").alias("rare_rows"),
    )


@query
def params_texts(spark, sf):
    """Parameter texts of maps whose values come from the rows; leading keys first, whatever their order in the map."""
    text = lambda c: F.col(c).cast("string")
    some = F.map_filter(
        F.create_map(F.lit("zone"), text("prio"), F.lit("learning_rate"), text("near"), F.lit("max_depth"), text("label")),
        lambda k, v: (F.col("near") == 1) | (k != "learning_rate"),
    )
    none = F.map_filter(some, lambda k, v: F.lit(False))
    return fx.orders(spark, sf).select("row_id", params_text(some).alias("params"), params_text(none).alias("no_params"))


@query
def table_round_trip(spark, sf):
    """Orders written as CSV and as parquet, over a table that was there before, and read again."""
    base = f"{shared_dir(spark)}/staged/round-trip-{uuid.uuid4().hex}"
    rows = fx.source(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    tables.write_table(rows.limit(3), f"{base}/a.csv", "csv")
    tables.write_table(rows, f"{base}/a.csv", "csv")
    back = tables.read_table(spark, f"{base}/a.csv", rows.schema)
    tables.write_table(back, f"{base}/b")
    return tables.read_table(spark, f"{base}/b").select("o_orderkey", "o_custkey", "o_orderstatus", r("o_totalprice", digits=2))


@query
def column_contracts(spark, sf):
    """Per table: its columns but for the keys, its numeric ones, and what the contract of line items finds missing."""
    wanted = ("l_orderkey", "l_quantity", "l_discount", "p_name")
    found = []
    for name in ("lineitem", "part", "nation", "events"):
        table = fx.source(spark, sf, name)
        try:
            tables.require_columns(table, wanted)
            missing = ""
        except ValueError as e:
            missing = str(e).split(": ", 1)[1].strip("[]").replace("'", "")
        rest = clean.feature_columns(table, ("l_orderkey", "l_partkey", "p_partkey", "n_nationkey", "event_id"))
        found.append((name, ", ".join(rest), ", ".join(clean.numeric_columns(table, "l_quantity")), missing))
    return spark.createDataFrame(found, "name string, features string, numeric string, missing string")


@query
def smote_minority_of_one(spark, sf):
    """All customers but for the minority, of which the one with the smallest key stays: it is repeated."""
    table = fx.customers(spark, sf)
    first = table.filter("label = 1").agg(F.min("row_id")).first()[0]
    kept = table.filter((F.col("label") == 0) | (F.col("row_id") == first))
    out, info = _smote(kept, CUSTOMERS)
    return _rounded(out, CUSTOMERS).withColumn("k_used", F.lit(info.k_neighbors_used))


@query
def tune_dt(spark, sf):
    train, _ = _sides(spark, sf)
    return tune(train, ORDERS.features, "label", "row_id", "decision_tree", SEED, iterations=3).select(
        "position", params_text(F.col("params")).alias("params"), r("roc_auc")
    )


@query
def tune_nb(spark, sf):
    train, _ = _sides(spark, sf)
    points = [{"var_smoothing": v} for v in (1e-9, 0.5)]
    return tune(train, ORDERS.features, "label", "row_id", "naive_bayes", SEED, points=points).select(
        "position", F.col("params")["var_smoothing"].cast("double").alias("var_smoothing"), r("roc_auc")
    )


@query
def sigmoid_fallback(spark, sf):
    table = fx.scored(spark, sf).select("row_id", ((F.col("probability") - 0.5) * 8).alias("decision"))
    return with_probability(table).select("row_id", r("probability"))


@query
def fit_score_nb(spark, sf):
    train, test = _sides(spark, sf)
    return _scores(fit_score(train, test, "naive_bayes", Settings(ORDERS, use_smote=False)).scores)


@query
def fit_score_nb_smote(spark, sf):
    """Customers: SMOTE on the training side only, then naive Bayes."""
    table = fx.customers_by_cohort(spark, sf)
    train, test = sampling.stratified_split(table, "row_id", "label", 0.3, SEED)
    return _scores(fit_score(train, test, "naive_bayes", Settings(CUSTOMERS)).scores)


@query
def specialist_nb(spark, sf):
    train, test = _sides(spark, sf)
    settings = Settings(ORDERS, use_smote=False)
    base = fit_score(train, test, "naive_bayes", settings)
    own = specialists(train, test, "naive_bayes", settings, base.scores, "Naive Bayes")
    return own.scores.select("row_id", "cohort", "label", "prediction", r("probability"))


@query
def specialist_null_cohort(spark, sf):
    """A tenth of the rows has no cohort: the common model scores them."""
    sides = [s.withColumn("cohort", F.when(F.col("row_id") % 10 != 0, F.col("cohort"))) for s in _sides(spark, sf)]
    settings = Settings(ORDERS, use_smote=False)
    base = fit_score(*sides, "naive_bayes", settings)
    own = specialists(*sides, "naive_bayes", settings, base.scores, "Naive Bayes")
    return own.scores.select("row_id", "cohort", "label", "prediction", r("probability"))


@query
def refit_flipped(spark, sf):
    """One ``Settings``, two training tables: each fit follows its own."""
    train, test = _sides(spark, sf)
    settings = Settings(ORDERS, use_smote=False)
    flipped = train.withColumn("label", 1 - F.col("label"))
    found = [fit_score(side, test, "naive_bayes", settings).scores for side in (train, flipped)]
    parts = [s.select("row_id", F.lit(n).alias("fitted_on"), "prediction", r("probability")) for n, s in zip(("train", "flipped"), found)]
    return parts[0].unionByName(parts[1])


@query
def specialist_fallback_nb(spark, sf):
    """The low cohort has one class in training, so the common model serves it."""
    train, test = _sides(spark, sf)
    train = train.filter((F.col("cohort") != "Low") | (F.col("label") == 0))
    settings = Settings(ORDERS, use_smote=False)
    base = fit_score(train, test, "naive_bayes", settings)
    own = specialists(train, test, "naive_bayes", settings, base.scores, "Naive Bayes")
    return own.scores.select("row_id", "cohort", "label", "prediction", r("probability"))


def _gappy(spark, sf):
    """Scores with about one in twenty missing."""
    lost = fx.uniform(SEED, "lost", "row_id") < 0.05
    table = fx.scored(spark, sf)
    return table.withColumns({c: F.when(~lost, F.col(c)) for c in ("prediction", "probability")})


@query
def prevalence_fallback(spark, sf):
    table = _gappy(spark, sf)
    share = fx.orders(spark, sf).agg(F.avg("label")).first()[0]
    return fill_scores(table, share).select("row_id", "prediction", r("probability"), "filled")


@query
def linear_attribution(spark, sf):
    weights, means = _linear(spark, sf)
    return att.linear_attribution(fx.orders(spark, sf), "row_id", weights, means).select("row_id", "feature", r("attribution"))


def _linear(spark, sf):
    weights = {"acctbal": 0.002, "totalprice": -0.0001, "order_days": 0.01}
    scaler = preprocess.fit_scaler(fx.orders(spark, sf), list(weights))
    return weights, scaler.mean


@query
def attribution_importance(spark, sf):
    weights, means = _linear(spark, sf)
    long = att.linear_attribution(fx.orders(spark, sf), "row_id", weights, means)
    return att.attribution_summary(long).select("feature", r("importance", digits=4))


@query
def tree_attribution(spark, sf):
    train, test = _sides(spark, sf)
    model = make_model("xgboost", None, SEED).fit(train, ORDERS.features, "label")
    explained = att.tree_attribution(model, test, "row_id")
    return att.attribution_long(explained, "row_id", ORDERS.features).select("row_id", "feature", r("attribution"))


@query
def tree_attribution_sums(spark, sf):
    """Base plus attributions is the log-odds of every test row."""
    train, test = _sides(spark, sf)
    model = make_model("xgboost", None, SEED).fit(train, ORDERS.features, "label")
    explained = att.tree_attribution(model, model.score(test), "row_id")
    odds = model.score(test).select("row_id", F.log(F.col("probability") / (1 - F.col("probability"))).alias("odds"))
    total = F.col("base") + F.aggregate("attributions", F.lit(0.0), lambda acc, x: acc + x)
    return explained.join(odds, "row_id").select("row_id", (F.abs(total - F.col("odds")) < 1e-6).alias("adds_up"))


# ---- metrics -----------------------------------------------------------------

@query
def confusion_matrix(spark, sf):
    return metrics.confusion(fx.scored(spark, sf), ["cohort"])


@query
def basic_metrics(spark, sf):
    return metrics.basic_metrics(fx.scored(spark, sf), ["cohort"]).select(
        "cohort", *[r(c) for c in ("accuracy", "precision", "recall", "f1")]
    )


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(fx.scored(spark, sf), ["cohort"]).select("cohort", r("roc_auc"))


@query
def roc_auc_bucketed(spark, sf):
    """The same with untied scores, forced through sixteen score ranges."""
    table = fx.scored(spark, sf).withColumn("probability", fx.uniform(SEED, "fine", "row_id"))
    return metrics.roc_auc(table, ["cohort"], buckets=16).select("cohort", r("roc_auc"))


@query
def average_precision(spark, sf):
    return metrics.average_precision(fx.scored(spark, sf), ["cohort"]).select("cohort", r("pr_auc"))


@query
def metrics_by_cohort(spark, sf):
    report = metrics.metrics(fx.scored(spark, sf), [*COHORTS, "Nobody"], "cohort")
    return report.select("position", "scope", *[r(c) for c in metrics.METRICS], *metrics.COUNTS)


@query
def wilson_interval(spark, sf):
    return metrics.wilson_interval(fx.scored(spark, sf), ["cohort"]).select(
        "cohort", "correct", "total", r("ci_low"), r("ci_high")
    )


@query
def correlation_matrix(spark, sf):
    table = fx.source(spark, sf, "lineitem").select(*fx.LINE_COLUMNS, F.lit(7).alias("constant"))
    return profile.correlation_long(table, table.columns).select("row_name", "column_name", r("correlation"))


@query
def cohort_counts(spark, sf):
    table = fx.orders_by_cohort(spark, sf)
    return profile.cohort_counts(table, [*COHORTS, "Nobody"], "cohort", "label")


@query
def frame_diff(spark, sf):
    a = fx.orders(spark, sf)
    shifted = F.when(F.col("prio") == 1, F.col("totalprice") + 1).otherwise(F.col("totalprice") + 1e-12)
    b = a.withColumns({"totalprice": shifted, "near": F.when(F.col("prio") != 2, F.col("near"))})
    return profile.frame_diff(a, b, "row_id")


@query
def dataset_profile(spark, sf):
    found = preprocess.prepare(fx.orders(spark, sf), ORDERS)
    return profile.profile(found.train, found.test, COHORTS, "cohort", "label")


# ---- comparison tables -------------------------------------------------------

def _report(spark, sf):
    keys = ["model_key", "model_name", "strategy"]
    return metrics.metrics(fx.scored_variants(spark, sf), COHORTS, "cohort", extra=keys)


def _summary(spark, sf):
    return compare.cross_model_summary(_report(spark, sf).filter("scope = 'overall'"))


def _rounded_numbers(df, skip):
    return df.select(*skip, *[r(c) for c in df.columns if c not in skip])


@query
def cross_model_summary(spark, sf):
    return _rounded_numbers(_summary(spark, sf), ["model_key", "model_name"])


@query
def delta_matrix(spark, sf):
    return compare.delta_matrix(_summary(spark, sf)).select("model_key", "metric", r("delta"))


@query
def metric_winner(spark, sf):
    return compare.strategy_winners(_summary(spark, sf)).select("model_key", "metric", "winner")


@query
def rank_models(spark, sf):
    return compare.rank_models(_summary(spark, sf)).select("position", "model_key", r("best"))


@query
def compare_variants(spark, sf):
    report = _report(spark, sf).filter("model_key = 'm1'")
    a, b = (report.filter(F.col("strategy") == s) for s in fx.STRATEGIES)
    table = compare.compare_variants(a, b)
    return table.select("scope", "metric", r("value_a"), r("value_b"), r("delta"), "winner")


@query
def metric_text_(spark, sf):
    report = metrics.metrics(fx.scored(spark, sf), [*COHORTS, "Nobody"], "cohort")
    long = metrics.long_metrics(report, ["scope"])
    return long.select(
        "scope", "metric", metric_text(F.round("value", 9)).alias("text"),
        delta_text(F.round(F.col("value") - 0.5, 9)).alias("delta"),
    )


@query
def feature_list_text(spark, sf):
    """Numeric columns in order of their mean, largest first, as one text."""
    means = preprocess.scaler_table(fx.orders(spark, sf), ORDERS.numeric)
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("mean")))
    chosen = means.select(F.lit("overall").alias("scope"), F.col("column").alias("feature"), "mean")
    return importance.feature_text(chosen.withColumn("position", place))


# ---- whole studies -----------------------------------------------------------

@query
def strategy_comparison_nb(spark, sf):
    train, test = _sides(spark, sf)
    found = compare_strategies(train, test, ["naive_bayes"], Settings(ORDERS, use_smote=False))
    return found.report.select(
        "model_key", "strategy", "scope", *[r(c) for c in metrics.METRICS], *metrics.COUNTS
    )


@query
def strategy_summary(spark, sf):
    """Three models with feature choice and SMOTE on both strategies."""
    train, test = _customer_sides(spark, sf)
    settings = Settings(CUSTOMERS, top_k=4, params={"selector": {"n_estimators": 10}})
    found = compare_strategies(train, test, ["naive_bayes", "decision_tree", "logistic_regression"], settings)
    return _rounded_numbers(found.summary, ["model_key", "model_name"])


def _customer_sides(spark, sf):
    return sampling.stratified_split(fx.customers_by_cohort(spark, sf), "row_id", "label", 0.3, SEED)


@query
def variant_result_(spark, sf):
    """A generated training table three times the real one, real test rows."""
    train, test = _customer_sides(spark, sf)
    grown = resize(train, CUSTOMERS, 3 * train.count(), CUSTOMERS.cutoffs, SEED)
    settings = Settings(CUSTOMERS, top_k=4, params={"selector": {"n_estimators": 5}, "xgboost": {"n_estimators": 5}})
    run = run_variant(grown, test, settings, "WITH_SMOTE")
    return tables.results_text(variant_result(run, settings))


@query
def strategy_document_nb(spark, sf):
    train, test = _customer_sides(spark, sf)
    found = compare_strategies(train, test, ["naive_bayes"], Settings(CUSTOMERS))
    return strategy_document(found).select(
        "model_key", "strategy", "scope", "test_rows", r("metrics.accuracy", "accuracy"),
        F.col("sampling.generated_samples").alias("generated_samples"), F.col("model_info.status").alias("status"),
        F.concat_ws(", ", "feature_selection.selected_features").alias("features"),
    )


@query
def report_matrices(spark, sf):
    return _report_tables(spark, sf)["matrices"]


@query
def report_sampling(spark, sf):
    return _report_tables(spark, sf)["sampling"].select(
        "variant", "scope", "applied", "reason", "generated_samples", "k_neighbors_used"
    )


def _report_tables(spark, sf):
    train, test = _customer_sides(spark, sf)
    without, with_smote, _ = compare_smote(train, test, Settings(CUSTOMERS), "naive_bayes")
    return report_tables(without, with_smote, CUSTOMERS)


@query
def smote_study(spark, sf):
    train, test = _customer_sides(spark, sf)
    _, _, table = compare_smote(train, test, Settings(CUSTOMERS), "naive_bayes")
    return table.select("scope", "metric", r("value_a"), r("value_b"), r("delta"), "winner")


@query
def cohort_explanations(spark, sf):
    train, test = _sides(spark, sf)
    settings = Settings(ORDERS, top_k=5, use_smote=False,
                        params={"selector": {"n_estimators": 5}, "xgboost": {"n_estimators": 5}})
    found = explain_cohorts(train, test, settings)
    parts = [e.importance.select(F.lit(c).alias("cohort"), "feature", r("importance")) for c, e in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, split, scale, fit naive Bayes, and report metrics per cohort."""
    train, test = _sides(spark, sf)
    run = fit_score(train, test, "naive_bayes", Settings(ORDERS, use_smote=False))
    report = metrics.metrics(run.scores, COHORTS, "cohort")
    return report.select("position", "scope", *[r(c) for c in metrics.METRICS], *metrics.COUNTS)


@query
def nb_report(spark, sf):
    return flagship(spark, sf)
