"""Boosted trees against growth spelled out over all rows."""

from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from cohortlab.models import boosting, histograms
from cohortlab.models.catalogue import make_model

LEVEL = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0}


@pytest.fixture(scope="module")
def made(spark):
    rand = np.random.default_rng(5)
    x = np.column_stack([rand.integers(0, 30, 900), rand.integers(0, 12, 900), rand.integers(0, 2, 900)]).astype(float)
    y = (x[:, 0] + 3 * x[:, 1] * x[:, 2] + rand.normal(0, 12, 900) > 25).astype(int)
    table = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    return x, y, table


def gain(g, h, left, l2):
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    return 0.5 * (score(left) + score(~left) - score(np.ones(len(g), bool)))


def all_splits(x, g, h, rows, l2, min_rows, min_h):
    """(gain, feature, threshold) of every allowed split of some rows, the best first."""
    out = []
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[1:]:
            left = x[rows, f] < t
            sides = [(h[rows][m].sum(), m.sum()) for m in (left, ~left)]
            if min(n for _, n in sides) >= min_rows and min(s for s, _ in sides) >= min_h:
                out.append((gain(g[rows], h[rows], left, l2), f, t))
    return sorted(out, key=lambda s: (-s[0], s[1], s[2]))


def check(fitted, x, y, l2, min_rows, min_h, rate):
    """Every split is the best there is, every leaf its Newton step; returns the rows of each tree's leaves."""
    margin, leaves = np.full(len(y), fitted.start), []
    for tree in fitted.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h, step, found = p - y, p * (1 - p), np.zeros(len(y)), []
        todo = [(0, np.arange(len(y)))]
        while todo:
            at, rows = todo.pop()
            node = tree.nodes[at]
            assert node.sums == pytest.approx([g[rows].sum(), h[rows].sum(), len(rows)], abs=1e-9)
            if node.feature < 0:
                found.append((at, rows))
                assert node.value == pytest.approx(-rate * g[rows].sum() / (h[rows].sum() + l2), abs=1e-12)
                step[rows] = node.value
                continue
            able = all_splits(x, g, h, rows, l2, min_rows, min_h)
            assert node.gain == pytest.approx(able[0][0])
            assert (node.feature, node.threshold) in [s[1:] for s in able if s[0] == pytest.approx(node.gain)]  # ties
            left = x[rows, node.feature] < node.threshold
            todo += [(node.left, rows[left]), (node.right, rows[~left])]
        margin = margin + step
        leaves.append(found)
    return margin, leaves


def test_growth_by_level(spark, made, monkeypatch):
    monkeypatch.setattr(boosting, "STAGE_EVERY", 2)  # margins are written anew in between
    x, y, table = made
    fitted = make_model("xgboost", LEVEL).fit(table, ["a", "b", "c"], "y", "id")
    margin, _ = check(fitted, x, y, 1.0, 1, 1.0, 0.3)
    assert fitted.start == pytest.approx(np.log(y.mean() / (1 - y.mean())))
    got = {r.id: r.probability for r in fitted.score(table).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx((1 / (1 + np.exp(-margin))).tolist())
    assert sum(fitted.importances) == pytest.approx(1.0)


def test_margins_of_many_rows_are_written_often_and_kept_once(spark, made, monkeypatch):
    """Passes over many rows add few trees again, and margins that were written anew replace those before."""
    assert [boosting.staged_every(n) for n in (0, 105_000, 630_000, 38_000_000)] == [16, 16, 6, 4]
    monkeypatch.setattr(boosting, "STAGE_EVERY", 1)
    dropped, drop = [], boosting.drop_blocks

    def seen(session, blocks):
        files = Path(blocks.name())
        assert files.exists()
        drop(session, blocks)
        assert not files.exists()
        dropped.append(files)

    monkeypatch.setattr(boosting, "drop_blocks", seen)
    x, y, table = made
    fitted = make_model("xgboost", LEVEL).fit(table, ["a", "b", "c"], "y", "id")
    assert len(set(dropped)) == 2
    check(fitted, x, y, 1.0, 1, 1.0, 0.3)


@pytest.mark.parametrize("leaves", [4, 9, 31])
def test_growth_by_leaf(spark, made, leaves):
    x, y, table = made
    params = {"n_estimators": 2, "num_leaves": leaves, "min_child_samples": 20, "learning_rate": 0.1}
    fitted = make_model("lightgbm", params).fit(table, ["a", "b", "c"], "y", "id")
    _, found = check(fitted, x, y, 0.0, 20, 1e-3, 0.1)
    assert len(found[0]) == leaves and all(len(rows) >= 20 for tree in found for _, rows in tree)
    if leaves > 9:  # small nodes have splits of equal gain, either of which may be taken
        return
    p = np.full(len(y), 1 / (1 + np.exp(-fitted.start)))
    g, h = p - y, p * (1 - p)
    open_, gains = [np.arange(len(y))], []
    while len(open_) < leaves:  # always the open leaf of the largest gain
        best = [(all_splits(x, g, h, rows, 0.0, 20, 1e-3) or [(0,)])[0] for rows in open_]
        i = max(range(len(open_)), key=lambda k: best[k][0])
        if best[i][0] <= 1e-12:
            break
        rows = open_.pop(i)
        left = x[rows, best[i][1]] < best[i][2]
        open_ += [rows[left], rows[~left]]
        gains.append(best[i][0])
    assert sorted(map(sorted, open_)) == sorted(sorted(rows) for _, rows in found[0])
    order = [n.gain for n in sorted((n for n in fitted.trees[0].nodes if n.feature >= 0), key=lambda n: n.left)]
    assert order == pytest.approx(gains)


def test_symmetric_growth(spark, made):
    x, y, table = made
    fitted = make_model("catboost", {"iterations": 2, "depth": 3, "learning_rate": 0.2}).fit(table, ["a", "b", "c"], "y", "id")
    margin = np.zeros(len(y))
    for tree in fitted.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h, cell = p - y, p * (1 - p), np.zeros(len(y), int)
        for depth in range(3):
            total = {}
            for f in range(3):
                for t in np.unique(x[:, f])[1:]:
                    total[f, t] = sum(gain(g[cell == c], h[cell == c], x[cell == c, f] < t, 3.0) for c in np.unique(cell))
            level = {(n.feature, n.threshold) for n in tree.nodes if n.depth == depth}
            assert len(level) == 1
            f, t = level.pop()
            assert total[f, t] == pytest.approx(max(total.values()))
            cell = 2 * cell + (x[:, f] >= t)
        assert len(tree.nodes) == 15
        for c in np.unique(cell):
            margin[cell == c] -= 0.2 * g[cell == c].sum() / (h[cell == c].sum() + 3.0)
    got = {r.id: r.probability for r in fitted.score(table).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx((1 / (1 + np.exp(-margin))).tolist())


def test_shares_of_rows_and_columns(spark, made):
    _, _, table = made
    params = {**LEVEL, "subsample": 0.5, "colsample_bytree": 0.67}
    one = make_model("xgboost", params).fit(table.repartition(3), ["a", "b", "c"], "y", "id")
    two = make_model("xgboost", params).fit(table, ["a", "b", "c"], "y", "id")
    assert [t.arrays()[0].tolist() for t in one.trees] == [t.arrays()[0].tolist() for t in two.trees]
    assert all(380 < t.nodes[0].sums[boosting.N] < 520 for t in one.trees)
    assert all(len({n.feature for n in t.nodes if n.feature >= 0}) <= 2 for t in one.trees)


def test_many_tasks_add_up_in_the_cluster(spark, made, monkeypatch):
    x, y, table = made
    monkeypatch.setattr(histograms, "FAN_IN", 2)
    monkeypatch.setattr(histograms, "LEAST_ROWS", 100)
    assert histograms.tasks(table, 900) > 4 and histograms.tasks(table, 10**9) == 500
    fitted = make_model("xgboost", {**LEVEL, "n_estimators": 1}).fit(table, ["a", "b", "c"], "y", "id")
    check(fitted, x, y, 1.0, 1, 1.0, 0.3)


def test_odd_tables(spark):
    rows = [(i, 1.0, float(i == 7), int(i == 7)) for i in range(300)]
    table = spark.createDataFrame([*rows, (500, 1.0, 0.0, None), (501, 1.0, 0.0, 2)], "id long, same double, flag double, y int")
    for key in ("xgboost", "catboost"):  # growth by leaf wants 20 rows in a leaf
        fitted = make_model(key, {"iterations" if key == "catboost" else "n_estimators": 2}).fit(table, ["same", "flag"], "y", "id")
        assert {n.sums[boosting.N] for n in [fitted.trees[0].nodes[0]]} == {300.0}
    same = make_model("lightgbm", {"n_estimators": 2}).fit(table, ["same"], "y", "id")
    assert all(len(t.nodes) == 1 for t in same.trees)
    with pytest.raises(ValueError, match="one class"):
        make_model("xgboost").fit(table.filter("y = 0"), ["flag"], "y", "id")
    with pytest.raises(Exception, match="missing or infinite"):
        make_model("xgboost", LEVEL).fit(spark.createDataFrame([(1, None, 0), (2, 1.0, 1)], "id long, x double, y int"), ["x"], "y", "id")


def test_adaboost_tries_every_split(spark, made):
    """Rounds spelled out over all values of all features."""
    x, y, table = made
    stumps = make_model("adaboost", {"n_estimators": 4, "learning_rate": 0.5}).fit(table, ["a", "b", "c"], "y", "id").stumps
    w = np.full(len(y), 1 / len(y))
    for stump in stumps:
        best = []
        for f in range(3):
            for t in np.unique(x[:, f])[1:]:
                left = x[:, f] < t
                sums = [[w[m & (y == c)].sum() for c in (0, 1)] for m in (left, ~left)]
                best.append((sum(2 * a * b / (a + b) for a, b in sums), f, t))
        impurity = {(f, t): v for v, f, t in best}
        assert impurity[stump.feature, stump.threshold] == pytest.approx(min(impurity.values()))
        left = x[:, stump.feature] < stump.threshold
        wrong = np.where(left, stump.low, stump.high) != y
        error = w[wrong].sum() / w.sum()
        assert stump.alpha == pytest.approx(0.5 * np.log((1 - error) / error))
        w = w * np.exp(stump.alpha * wrong)
        w /= w.sum()


def test_rows_are_written_in_blocks(spark, made, monkeypatch):
    """A pass reads a few blocks of many rows; every row is in one of them, whatever the size of a block."""
    x, y, table = made
    whole = histograms.binned(table.repartition(3), ["a", "b", "c"], "y", "id", 900)
    assert whole.blocks.count() == whole.parts == 1
    monkeypatch.setattr(histograms, "BLOCK_ROWS", 64)
    small = histograms.binned(table.repartition(3), ["a", "b", "c"], "y", "id", 900)
    assert small.blocks.count() == 15
    count = lambda bins, y, margin, key: np.array([len(y), y.sum(), *bins.sum(axis=0, dtype=float), margin.sum()])
    want = [900, y.sum(), *(histograms.bins_of(x, whole.cuts).sum(axis=0, dtype=float)), 0]
    assert histograms.summed(whole, count, 6).tolist() == histograms.summed(small, count, 6).tolist() == want
    moved = histograms.advanced(small, lambda bins, y, margin, key: margin + bins[:, 0])
    assert histograms.summed(moved, count, 6).tolist() == [*want[:5], want[2]]


@pytest.mark.parametrize("leaves", [9, 400])
def test_rows_end_in_the_leaf_a_walk_ends_in(leaves):
    rand = np.random.default_rng(leaves)
    nodes, open_ = [boosting.Node(0, np.zeros(3))], [0]
    while len(open_) < leaves:
        at = open_.pop(int(rand.integers(len(open_))))
        node = nodes[at]
        node.feature, node.border, node.left, node.right = int(rand.integers(4)), int(rand.integers(256)), len(nodes), len(nodes) + 1
        open_ += [node.left, node.right]
        nodes += [boosting.Node(node.depth + 1, np.zeros(3)) for _ in range(2)]
    bins = rand.integers(0, 256, (500, 4)).astype(np.uint8)
    found = boosting.reached(boosting.Tree(nodes).arrays(), np.asfortranarray(bins))
    for row, end in zip(bins, found):
        at = 0
        while nodes[at].feature >= 0:
            at = nodes[at].right if row[nodes[at].feature] > nodes[at].border else nodes[at].left
        assert at == end


def test_tasks_of_many_rows_leave_no_core_waiting():
    """As many tasks as cores, or a whole multiple while there are few rounds."""
    train = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=12)))
    assert [histograms.tasks(train, rows) for rows in (0, 50_000, 6_300_000, 37_800_000, 10**9)] == [1, 2, 12, 24, 500]


def _same_trees(one, two):
    assert len(one.trees) == len(two.trees)
    for a, b in zip(one.trees, two.trees):
        for found, want in zip(a.arrays(), b.arrays()):
            assert found.tolist() == pytest.approx(want.tolist())
        assert [n.sums.tolist() for n in a.nodes] == [pytest.approx(n.sums.tolist()) for n in b.nodes]


@pytest.mark.parametrize("params", [
    ("xgboost", {**LEVEL, "subsample": 0.7, "colsample_bytree": 0.67}), ("lightgbm", {"n_estimators": 3, "num_leaves": 9, "min_child_samples": 5}),
    ("catboost", {"iterations": 3, "depth": 4}),
])
def test_few_rows_take_no_job_for_a_pass(spark, made, monkeypatch, params):
    """One task holds few rows and grows trees by itself; they are those of the passes over many rows."""
    _, _, table = made
    passes, summed = [], boosting.summed
    monkeypatch.setattr(boosting, "summed", lambda *args: passes.append(1) or summed(*args))
    fit = lambda: make_model(*params).fit(table, ["a", "b", "c"], "y", "id")
    few = fit()
    assert not passes
    monkeypatch.setattr(histograms, "ALONE_ROWS", 0)
    monkeypatch.setattr(histograms, "FAN_IN", 2)
    monkeypatch.setattr(histograms, "LEAST_ROWS", 100)
    _same_trees(few, fit())
    assert len(passes) >= 9


@pytest.mark.parametrize("same_all_over", [True, False])
def test_levels_with_one_split_are_read_as_digits(same_all_over):
    """A full tree with one split per level looks at each level once, and only such a tree."""
    rand = np.random.default_rng(3)
    nodes, level = [boosting.Node(0, np.zeros(3))], [0]
    for depth in range(5):
        for at in level:
            node = nodes[at]
            node.feature, node.border, node.left, node.right = depth % 3, 40 * depth + 20 + (not same_all_over and at == 4), len(nodes), len(nodes) + 1
            nodes += [boosting.Node(depth + 1, np.zeros(3)) for _ in range(2)]
        level = [c for at in level for c in (nodes[at].left, nodes[at].right)]
    arrays = boosting.Tree(nodes).arrays()
    assert (boosting._levels(*(part.tolist() for part in arrays[:4])) is not None) == same_all_over
    bins = rand.integers(0, 256, (2000, 3)).astype(np.uint8)
    found = boosting.reached(arrays, np.asfortranarray(bins))
    for row, end in zip(bins, found):
        at = 0
        while nodes[at].feature >= 0:
            at = nodes[at].right if row[nodes[at].feature] > nodes[at].border else nodes[at].left
        assert at == end


def test_features_of_few_bins_are_counted_together():
    groups = boosting.joined([256, 2, 2, 1, 200, 64, 3, 2])
    assert sorted(i for g in groups for i in g) == list(range(8))
    assert groups == [[0, 3], [1, 2, 5], [4], [6, 7]]
    x = np.asfortranarray(np.random.default_rng(1).integers(0, 2, (50, 3)).astype(np.uint8))
    assert boosting.cells_of(x, [(0, 2), (2, 3)]).tolist() == (x[:, 0] * 3 + x[:, 2]).tolist()
