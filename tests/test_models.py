import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlab.models import attribution, kernel_svm
from cohortlab.models.base import with_probability
from cohortlab.models.catalogue import CATALOGUE, entry, grid_points, make_model, models_catalogue
from cohortlab.operators.importance import choice_table, choose_features, feature_text, importance_series
from cohortlab.operators.metrics import roc_auc
from cohortlab.operators.preprocess import prepare
from cohortlab.plans.tuning import tune
from cohortlab.session import stage
from cohortlab.spec import CLINICAL

FEATURES = CLINICAL.features
FEW = {  # rounds that keep the suite short
    "random_forest": {"n_estimators": 20}, "xgboost": {"n_estimators": 10}, "lightgbm": {"n_estimators": 8},
    "catboost": {"iterations": 8}, "adaboost": {"n_estimators": 15}, "mlp": {"max_iter": 60},
}


@pytest.fixture(scope="module")
def sides(clinical):
    found = prepare(clinical, CLINICAL)
    return stage(found.train, "train"), stage(found.test, "test")


@pytest.mark.parametrize("key", list(CATALOGUE))
def test_every_model_learns(sides, key):
    train, test = sides
    fitted = make_model(key, FEW.get(key)).fit(train, FEATURES, "target", "row_id")
    scored = fitted.score(test).withColumn("label", F.col("target")).cache()
    assert scored.count() == 180 and dict(scored.dtypes)["prediction"] == "int"
    assert scored.filter("probability < 0 or probability > 1 or prediction not in (0, 1)").count() == 0
    assert roc_auc(scored).first()["roc_auc"] > 0.85


def test_gaussian_nb_by_hand(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, 3.0, 0), (3, 6.0, 1), (4, 8.0, 1), (5, 10.0, 1)], "row_id int, x double, y int")
    model = make_model("naive_bayes").fit(df, ["x"], "y")
    eps = 1e-9 * np.var([1, 3, 6, 8, 10])

    def joint(x, values, share):
        mean, var = np.mean(values), np.var(values) + eps
        return math.log(share) - 0.5 * math.log(2 * math.pi * var) - (x - mean) ** 2 / (2 * var)

    a, b = joint(4.0, [1, 3], 0.4), joint(4.0, [6, 8, 10], 0.6)
    row = model.score(spark.createDataFrame([(4.0,)], "x double")).first()
    assert row["probability"] == pytest.approx(math.exp(b) / (math.exp(a) + math.exp(b)), rel=1e-9)
    assert row["prediction"] == int(b > a)


@pytest.mark.parametrize("key", ["naive_bayes", "knn", "adaboost", "svm"])
def test_one_class_is_refused(sides, key):
    with pytest.raises(ValueError, match="one class"):
        make_model(key).fit(sides[0].filter("target = 1"), FEATURES, "target", "row_id")


def test_kernel_features_and_decisions_agree(spark):
    """Decision values leave a task as one number a row, equal to the mapped row times the weights."""
    rand = np.random.default_rng(3)
    mapping = kernel_svm._Map(rand.normal(size=(2, 256)), rand.uniform(0, 6, 256))
    x = rand.normal(size=(1300, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double")
    fitted = SimpleNamespace(coefficients=Vectors.dense(rand.normal(size=256)), intercept=0.25)
    rows = mapping.decided(mapping.apply(df, ["a", "b"]), ["a", "b"], fitted).orderBy("id").collect()
    mapped = math.sqrt(2 / 256) * np.cos(x @ mapping.weights + mapping.offsets)
    assert np.array([r["_features"].toArray() for r in rows]) == pytest.approx(mapped, abs=1e-14)
    assert [r["_decision"] for r in rows] == pytest.approx((mapped @ fitted.coefficients.toArray() + 0.25).tolist(), abs=1e-12)


def test_kernel_svm_steps_as_mllib_without_keeping_mapped_rows(spark, monkeypatch):
    """The fit equals MLlib's over the mapped rows, which it neither writes nor hands to MLlib."""
    rand = np.random.default_rng(5)
    x = rand.normal(size=(900, 2))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rand.uniform(size=900) < 0.2)).astype(int)
    rows = [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id int, a double, b double, y int").repartition(3)
    mapping = kernel_svm._Map(rand.normal(size=(2, 256)), rand.uniform(0, 6, 256))
    mapped = mapping.apply(df, ["a", "b"]).select(F.col("y").cast("double").alias("label"), F.col("_features").alias("features"))
    wanted = LinearSVC(regParam=1 / 900, maxIter=15, standardization=False).fit(mapped)
    for name, other in (("LinearSVC", None), ("ITERATIONS", 15)):
        monkeypatch.setattr(kernel_svm, name, other)
    monkeypatch.setattr(kernel_svm._Map, "apply", None)
    found = mapping.fit(df, ["a", "b"], "y", 1 / 900, 900)
    assert found.coefficients.toArray() == pytest.approx(wanted.coefficients.toArray(), abs=1e-9)
    assert found.intercept == pytest.approx(wanted.intercept, abs=1e-9)


def test_adaboost_takes_a_perfect_split(spark):
    df = spark.createDataFrame([(i, float(i), int(i >= 7)) for i in range(20)], "row_id int, x double, y int")
    model = make_model("adaboost").fit(df, ["x"], "y")
    assert len(model.stumps) == 1 and model.score(df).filter("prediction <> y").count() == 0


def test_adaboost_finds_a_rare_flag(spark):
    df = spark.range(300).select("id", (F.col("id") == 7).cast("double").alias("flag"), F.lit(1.0).alias("same"))
    df = df.withColumn("y", F.col("flag").cast("int"))
    model = make_model("adaboost").fit(df, ["flag", "same"], "y", "id")
    assert model.score(df).filter("prediction <> y").count() == 0


def test_adaboost_restages_its_weights(sides, monkeypatch):
    from cohortlab.models import adaboost

    plain = make_model("adaboost", {"n_estimators": 6}).fit(sides[0], FEATURES, "target").stumps
    monkeypatch.setattr(adaboost, "STAGE_EVERY", 2)
    staged = make_model("adaboost", {"n_estimators": 6}).fit(sides[0], FEATURES, "target").stumps
    assert [(s.feature, s.threshold) for s in plain] == [(s.feature, s.threshold) for s in staged]
    assert [s.alpha for s in plain] == pytest.approx([s.alpha for s in staged])


def test_catalogue(spark):
    assert len(CATALOGUE) == 11 and models_catalogue(spark).count() == 11
    with pytest.raises(KeyError, match="unknown model"):
        entry("nope")
    with pytest.raises(TypeError, match="depth"):
        make_model("xgboost", {"depth": 3})
    assert make_model("xgboost", {"max_depth": 2}).params["learning_rate"] == 0.1
    for key in CATALOGUE:
        points = grid_points(key)
        assert 0 < len(points) <= entry(key).iterations and points == grid_points(key)
        for point in points:
            make_model(key, point)


def test_probability_fallbacks(spark):
    df = spark.createDataFrame([(0.0, 1), (2.0, 1)], "decision double, prediction int")
    assert [r["probability"] for r in with_probability(df).collect()] == pytest.approx([0.5, 1 / (1 + math.exp(-2))])
    assert [r["probability"] for r in with_probability(df.drop("decision")).collect()] == [1.0, 1.0]


def test_feature_choice(spark, sides):
    train, _ = sides
    choice = choose_features(train, FEATURES, "target", 3, params={"n_estimators": 5})
    assert choice.applied and len(choice.selected) == 3 and choice.selected[0] in ("oldpeak", "exercise_angina")
    weights = [choice.importances[c] for c in choice.selected]
    assert weights == sorted(weights, reverse=True)
    assert choose_features(train, FEATURES, "target", 15).reason == "feature_count_within_limit"
    alone = choose_features(train.filter("target = 0"), FEATURES, "target", 3)
    assert alone.reason == "single_class_train_data" and list(alone.selected) == FEATURES
    table = choice_table(spark, {"overall": choice, "none": alone})
    texts = {r["scope"]: r["features"] for r in feature_text(table).collect()}
    assert texts["overall"] == ", ".join(choice.selected)
    series = [r["importance"] for r in importance_series(table).collect()]
    assert series == sorted(series) and len(series) == 3


def test_tree_attributions_add_up(spark, sides):
    train, test = sides
    fitted = make_model("xgboost", {"n_estimators": 8}).fit(train, FEATURES, "target")
    explained = attribution.tree_attribution(fitted, test, "row_id")
    total = F.aggregate("attributions", F.lit(0.0), lambda a, b: a + b) + F.col("base")
    joined = explained.join(fitted.score(test).select("row_id", "probability"), "row_id")
    gap = joined.select(F.abs(1 / (1 + F.exp(-total)) - F.col("probability")).alias("g")).agg(F.max("g")).first()[0]
    assert gap < 1e-9
    top = attribution.attribution_summary(attribution.attribution_long(explained, "row_id", FEATURES)).first()
    assert top["feature"] in ("oldpeak", "exercise_angina")


def test_shapley_equals_the_definition():
    """Random leaves, rows and background, all coalitions spelled out."""
    rand = np.random.default_rng(3)
    leaves = []
    for _ in range(40):
        some = tuple(rand.permutation(4)[: rand.integers(0, 5)].tolist())
        low = tuple(float(v) if v > -0.5 else -np.inf for v in rand.uniform(-1, 0.4, len(some)))
        leaves.append(attribution.Leaf(float(rand.normal()), some, low, tuple(a + 0.8 if np.isfinite(a) else 0.3 for a in low)))
    x, z = rand.uniform(-1, 1, (12, 4)), rand.uniform(-1, 1, (9, 4))

    def score(rows):
        return sum(leaf.value * (attribution.patterns(leaf, rows) == (1 << len(leaf.features)) - 1) for leaf in leaves)

    def value(row, members):  # mean score with the members' features of the row, the others of the background
        return score(np.where(np.isin(np.arange(4), members), row, z)).mean()

    base, tables = attribution.explainer(leaves, attribution.background_counts(leaves, z))
    phi = attribution.shapley(leaves, tables, x)
    assert base == pytest.approx(score(z).mean())
    for row, got in zip(x, phi):
        for j in range(4):
            others = [k for k in range(4) if k != j]
            want = 0.0
            for bits in range(8):
                members = [k for i, k in enumerate(others) if bits >> i & 1]
                weight = math.factorial(len(members)) * math.factorial(3 - len(members)) / math.factorial(4)
                want += weight * (value(row, [*members, j]) - value(row, members))
            assert got[j] == pytest.approx(want, abs=1e-12)


def test_linear_attributions(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0)], "row_id int, a double, b double")
    got = attribution.linear_attribution(df, "row_id", {"a": 3.0, "b": -1.0}, {"a": 1.0, "b": 1.0}).collect()
    assert {r["feature"]: r["attribution"] for r in got} == {"a": 3.0, "b": -4.0}


def test_tuning(sides):
    table = tune(sides[0], FEATURES, "target", "row_id", "naive_bayes", iterations=2).collect()
    assert len(table) == 2 and table[0]["roc_auc"] >= table[1]["roc_auc"]


def test_patterns_are_bytes_of_the_definition():
    """A byte for up to 8 features on a path, two for more; sides without a bound are not compared."""
    rand = np.random.default_rng(8)
    x = np.asfortranarray(rand.uniform(-1, 1, (300, 14)))
    for wide, size in ((0, 1), (3, 1), (8, 1), (9, 2), (14, 2)):
        some = tuple(rand.permutation(14)[:wide].tolist())
        low = tuple(-np.inf if j % 3 == 0 else -0.5 for j in range(wide))
        high = tuple(np.inf if j % 3 == 1 else 0.6 for j in range(wide))
        found = attribution.patterns(attribution.Leaf(1.0, some, low, high), x)
        want = [sum((a <= row[f] < b) << j for j, (f, a, b) in enumerate(zip(some, low, high))) for row in x]
        assert found.itemsize == size and found.tolist() == want
