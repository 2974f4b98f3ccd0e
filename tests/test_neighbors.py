import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.functions.keyed import pick, uniform
from cohortlab.models.knn import vote
from cohortlab.operators import neighbors
from cohortlab.operators.neighbors import nearest_neighbors


def brute(asked, points, k, skip_self, p):
    out = {}
    for q, x in asked:
        gaps = [(float(np.linalg.norm(np.subtract(x, y), ord=p)), i) for i, y in points if not (skip_self and i == q)]
        out[q] = sorted((round(d, 9), i) for d, i in gaps)[:k]
    return out


def rows(df):
    return [(r["id"], (r["x"], r["y"])) for r in df.collect()]


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((round(r["distance"], 9), r["neighbor"]))
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    """Spread points, a dense knot, and many copies of one point."""
    return spark.range(700).select(
        "id",
        F.when(F.col("id") < 150, 1.0).when(F.col("id") < 300, 5 + uniform(1, "x", "id") / 1000)
        .otherwise(uniform(1, "x", "id") * 10).alias("x"),
        F.when(F.col("id") < 150, 2.0).when(F.col("id") < 300, 5 + uniform(1, "y", "id") / 1000)
        .otherwise(uniform(1, "y", "id") * 10).alias("y"),
    ).cache()


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("small", [0, 1000])
def test_equals_brute_force(cloud, small, p):
    got = nearest_neighbors(cloud, cloud, ["x", "y"], 4, "id", True, cell_rows=40, p=p, small=small)
    assert found(got) == brute(rows(cloud), rows(cloud), 4, True, p)


def test_other_queries_and_carried_values(spark, cloud, monkeypatch):
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 16)
    monkeypatch.setattr(neighbors, "CANDIDATE_BLOCK", 16)
    asked = spark.range(120).select("id", (uniform(2, "x", "id") * 12).alias("x"), (uniform(2, "y", "id") * 12).alias("y"))
    got = nearest_neighbors(asked, cloud, ["x", "y"], 3, "id", False, cell_rows=60, carry=["x"], small=0).cache()
    assert found(got) == brute(rows(asked), rows(cloud), 3, False, 2)
    wrong = got.join(cloud.select(F.col("id").alias("neighbor"), "x"), "neighbor").filter(F.get("carried", F.lit(0)) != F.col("x"))
    assert wrong.count() == 0


def test_far_queries_with_few_candidates(spark):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "id long, x double, y double")
    asked = spark.createDataFrame([(100, 1e6, 0.0), (101, -1e6, 0.0)], "id long, x double, y double")
    got = nearest_neighbors(asked, points, ["x", "y"], 10, "id", False, cell_rows=2, small=0)
    assert found(got) == brute(rows(asked), rows(points), 10, False, 2)


@pytest.mark.parametrize("small", [0, 10])
def test_no_candidates_no_neighbors(spark, small):
    asked = spark.createDataFrame([(1, 1.0)], "id long, x double")
    assert nearest_neighbors(asked, asked, ["x"], 3, "id", True, small=small).count() == 0
    assert nearest_neighbors(asked, asked.limit(0), ["x"], 3, "id", False, small=10).count() == 0


def test_missing_features_are_an_error(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "id long, x double")
    with pytest.raises(Exception, match="missing"):
        nearest_neighbors(df, df, ["x"], 1, "id", True).collect()


def test_votes(spark):
    near = spark.createDataFrame(
        [(1, 0.0, [0.0]), (1, 1.0, [1.0]), (2, 1.0, [1.0]), (2, 3.0, [0.0]), (3, 2.0, [1.0]), (3, 2.0, [0.0])],
        "query int, distance double, carried array<double>",
    )
    got = {r["query"]: (r["prediction"], round(r["probability"], 6)) for r in vote(near).collect()}
    assert got == {1: (0, 0.0), 2: (1, 0.75), 3: (0, 0.5)}
    flat = {r["query"]: r["probability"] for r in vote(near, "uniform").collect()}
    assert flat == {1: 0.5, 2: 0.5, 3: 0.5}


def test_many_ties(spark):
    grid = spark.range(400).select("id", pick(3, "x", 2, "id").cast("double").alias("x"), pick(3, "y", 2, "id").cast("double").alias("y"))
    got = nearest_neighbors(grid, grid, ["x", "y"], 5, "id", True, cell_rows=3, small=0)
    assert found(got) == brute(rows(grid), rows(grid), 5, True, 2)


def test_wide_vectors_visit_groups_of_cells(spark, monkeypatch):
    """Pruning fails between wide vectors: a query is written once per group, not once per cell."""
    monkeypatch.setattr(neighbors, "CANDIDATE_BLOCK", 100)
    wide = spark.range(300).select("id", F.array(*[uniform(3, f"w{i}", "id") for i in range(24)]).alias("v")).cache()
    written = []
    monkeypatch.setattr(neighbors, "stage", lambda df, name: written.append((name, df)) or df.cache())
    got = nearest_neighbors(wide, wide, ["v"], 4, "id", True, cell_rows=10, small=0)
    vectors = [(r["id"], r["v"]) for r in wide.collect()]
    assert found(got) == brute(vectors, vectors, 4, True, 2)
    further = dict(written)["knn-further"]
    assert further.filter("cell < 0").count() > 0 and further.count() <= 4 * 300


@pytest.mark.parametrize("shift, spread", [(0.0, 1.0), (1e6, 1e-3), (-3.0, 1e140)])
def test_a_block_computes_few_pairs(shift, spread):
    """An estimate by matrix product rules out most pairs, and no neighbour, however far from zero the values lie."""
    draw = np.random.default_rng(5)
    c, q = (shift + spread * draw.normal(size=(n, 16)) for n in (20_000, 150))
    c[50:60] = c[40:50]
    asked = pd.DataFrame({"id": np.arange(len(q)), "x": list(q), "bound": np.inf})
    there = neighbors._Candidates(np.arange(len(c)), c, np.full(len(c), None))
    got = pd.concat(neighbors._best(asked, there, 4, False, 2))
    for i in (0, 127, 128, 149):
        d = neighbors._distances(q[i : i + 1], c, 2)[0]
        assert got[got["query"] == i]["neighbor"].tolist() == np.lexsort((there.ids, d))[:4].tolist()
    near = got.groupby("query")["distance"].max().to_numpy()
    if abs(shift) < 1e5:
        assert sum(len(row) for _, row, _ in neighbors._open_pairs(q, np.full(len(q), np.inf), c, 4, 2)) < 40 * len(q)
        assert sum(len(row) for _, row, _ in neighbors._open_pairs(q, near, c, 4, 2)) < 6 * len(q)


def test_a_bound_is_kept(spark):
    c = np.arange(10.0)[:, None]
    asked = pd.DataFrame({"id": [3, 100], "x": [c[3], np.array([9.5])], "bound": [1.0, np.inf]})
    got = pd.concat(neighbors._best(asked, neighbors._Candidates(np.arange(10), c, np.full(10, None)), 3, True, 2))
    assert got[["query", "neighbor", "distance"]].values.tolist() == [[3, 2, 1.0], [3, 4, 1.0], [100, 9, 0.5], [100, 8, 1.5], [100, 7, 2.5]]


def test_a_row_looks_at_the_branches_near_it(spark):
    """Cells are found by a walk down a tree, and a query with a narrow bound visits few of them."""
    points = spark.range(4000).select("id", F.array(*[uniform(4, c, "id") for c in "xyz"]).alias("x"), F.array().cast("array<double>").alias("c"))
    splits = neighbors._splits(points, 4000, 60, 1)
    celled = neighbors._to_cells(points, splits).cache()
    boxes = neighbors._boxes(celled, splits)
    assert splits.depth == 7 and boxes.rows[0] == 4000 and (boxes.rows[127:] > 0).all()
    asked = celled.withColumn("reach", F.when(F.col("id") % 2 == 0, 0.05))
    found = neighbors._other_cells(asked, boxes, 2, 2, 5).filter("cell >= 0").cache()
    assert 0 < found.filter("id % 2 = 0").count() < 2000 * 4
    x = {r["id"]: (r["cell"], np.array(r["x"])) for r in celled.collect()}
    seen = {(r["id"], r["cell"]) for r in found.collect()} | {(i, cell) for i, (cell, _) in x.items()}
    few = {i for i, _ in seen if i % 2 == 0}
    every = np.stack([v for _, v in x.values()])
    cells = np.array([cell for cell, _ in x.values()])
    for i in sorted(few)[:200]:
        close = set(cells[np.sqrt(((every - x[i][1]) ** 2).sum(axis=1)) < 0.05].tolist())
        assert all((i, cell) in seen for cell in close) or len(close) > neighbors.FEW_CELLS
    # without a hit the bound is that of the smallest branch with enough candidates
    assert np.isfinite(boxes.ceiling(every[:50], cells[:50], 2, 5)).all()
    assert np.isinf(boxes.ceiling(every[:50], cells[:50], 2, 5000)).all()
