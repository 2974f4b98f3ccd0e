import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from cohortlab.models import forest
from cohortlab.models.base import with_probability
from cohortlab.models.catalogue import make_model
from cohortlab.models.mllib import VECTOR, MllibModel, assembler

SEED = 11


@pytest.fixture(scope="module")
def rows(spark):
    """Features of few values, so that borders are exact, and a label that follows three of them."""
    rand = np.random.default_rng(2)
    x = rand.integers(0, [12, 9, 2, 5], (900, 4))
    y = (x[:, 0] + 2 * x[:, 1] + 6 * x[:, 2] + rand.normal(0, 5, 900) > 16).astype(int)
    table = [(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(table, "row_id int, a double, b double, c double, d double, y int").cache()


def probabilities(fitted, df):
    return {r["row_id"]: (r["prediction"], r["probability"]) for r in fitted.score(df).collect()}


def fitted(df, features=("a", "b", "c", "d"), **params):
    return make_model("random_forest", {"n_estimators": 12, **params}, SEED).fit(df, list(features), "y", "row_id")


def test_trees_are_mllibs_on_the_rows_drawn(spark, rows):
    """Of two features a node looks at both, so MLlib grows the same trees from the rows weighted by their draws."""
    key = rows.select("row_id", F.xxhash64("row_id").alias("k")).toPandas()
    draws = forest.Draws(key["k"].to_numpy(), SEED)
    votes = np.zeros(len(key))
    for tree in range(3):
        times = [(int(i), float(n)) for i, n in zip(key["row_id"], draws.of(tree)) if n]
        weighted = rows.join(spark.createDataFrame(times, "row_id int, w double"), "row_id")
        ml = DecisionTreeClassifier(featuresCol=VECTOR, labelCol="y", weightCol="w", maxDepth=4).fit(assembler(["a", "b"]).transform(weighted))
        got = with_probability(ml.transform(assembler(["a", "b"]).transform(rows))).select("row_id", "probability").toPandas()
        votes += got.set_index("row_id")["probability"].loc[key["row_id"]].to_numpy() / 3
    ours = probabilities(fitted(rows, ("a", "b"), n_estimators=3, max_depth=4), rows)
    assert [ours[i][1] for i in key["row_id"]] == pytest.approx(votes.tolist(), abs=1e-12)
    assert all(p == int(s > 0.5) for p, s in ours.values())


def test_partitions_do_not_change_the_forest(rows):
    few, many = (probabilities(fitted(rows.repartition(n, "row_id")), rows) for n in (2, 5))
    assert few == many


def test_passes_are_bounded_and_nothing_is_kept_by_row_and_tree(spark, rows, monkeypatch):
    whole, sizes, real = probabilities(fitted(rows), rows), [], forest.summed

    def summed(data, add, size):
        sizes.append(size)
        assert {len(part) for part in data.blocks.first()} == {4 * 900, 900, 8 * 900}  # bins, label, margin and key
        return real(data, add, size)

    monkeypatch.setattr(forest, "summed", summed)
    monkeypatch.setattr(forest, "MOST_COUNTS", 1000)
    monkeypatch.setattr(MllibModel, "fit", None)
    one = rows.coalesce(1)
    monkeypatch.setattr(forest, "binned", lambda train, *more: BINNED(one, *more))
    assert probabilities(fitted(rows), rows) == whole
    assert max(sizes) <= 1000 and len(sizes) > 12


BINNED = forest.binned


def test_nodes_take_their_best_split(rows):
    """Every node of a tree again, over all rows and all borders of the features that a node looks at."""
    table = rows.withColumn("k", F.xxhash64("row_id")).toPandas()
    model = fitted(rows, ("a", "b"), n_estimators=2, max_depth=3, min_samples_leaf=20)
    draws = forest.Draws(table["k"].to_numpy(), SEED)
    for t, tree in enumerate(model.trees):
        todo = [(0, draws.of(t).astype(float))]
        while todo:
            at, times = todo.pop()
            node = tree.nodes[at]
            count = np.bincount(table["y"], times, 2)
            assert node.sums.tolist() == count.tolist() and node.value == count[1] / count.sum()
            if node.feature < 0:
                continue
            best = 0.0
            for name in ("a", "b"):
                for border in sorted(set(table[name]))[1:]:
                    sides = [np.bincount(table["y"], times * s, 2) for s in (table[name] < border, table[name] >= border)]
                    if min(s.sum() for s in sides) >= 20:
                        gini = lambda s: 1 - ((s / s.sum()) ** 2).sum()
                        best = max(best, gini(count) - sum(s.sum() * gini(s) for s in sides) / count.sum())
            assert node.gain == pytest.approx(best)
            left = table[model.features[node.feature]] < node.threshold
            todo += [(node.left, times * left), (node.right, times * ~left)]


def test_rows_are_drawn_by_poisson():
    draws = forest.Draws(np.random.default_rng(1).integers(-(2**63), 2**63, 200_000), SEED)
    times = np.array([draws.of(t) for t in range(6)], float)
    assert times.mean(axis=1) == pytest.approx(np.ones(6), abs=0.012)
    assert np.cov(times) == pytest.approx(np.eye(6), abs=0.02)
    shares = np.bincount(times.astype(int).ravel(), minlength=7)[:7] / times.size
    assert shares == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131, 0.01533, 0.00307, 0.00051], abs=0.002)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_alone(rows, label):
    found = probabilities(fitted(rows.filter(F.col("y") == label), n_estimators=3), rows)
    assert set(found.values()) == {(label, float(label))}


def test_missing_features_and_no_rows_are_errors(rows):
    with pytest.raises(Exception, match="missing or infinite"):
        fitted(rows.withColumn("a", F.when(F.col("row_id") != 5, F.col("a"))), n_estimators=2)
    with pytest.raises(ValueError, match="no row"):
        fitted(rows.filter("y > 1"))
