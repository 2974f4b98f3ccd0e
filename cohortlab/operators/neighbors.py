"""Exact k nearest neighbours under Euclidean or city-block distance.

Candidates are cut into cells by a binary tree of splits found on a sample, so
dense regions get more cells; a row finds its cell in as many steps as the tree is
deep. A query first searches its own cell; the distance of its k-th hit then rules
out every branch whose box (the extent of its candidates) is farther, and only the
cells left are searched. Where that rules out little, as between wide vectors, a query
does not visit cells one by one but large branches, so it is written once per
``CANDIDATE_BLOCK`` candidates at most. Within a cell or branch, queries and candidates meet
in blocks of bounded size; a block keeps k rows per query, so pairs are never written out.
In a block, Euclidean distances are estimated by a matrix product with a known
error; only pairs that the estimate leaves open are computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.keyed import uniform
from cohortlab.session import stage

SMALL = 4096  # candidates that may travel with every task
CELL_ROWS = 1024
TREE_BYTES = 32 << 20  # of the sample, and of the boxes, which travel with every task
MAX_CELLS = 65536
SAMPLE = 16  # rows per cell from which the splits are found
CANDIDATE_BLOCK = 16384
MOST_GROUPS = 16  # branches that wide vectors visit, as long as these have at most FULL_BLOCK candidates
FULL_BLOCK = 65536
FEW_CELLS = 8  # cells a query visits one by one
MOST_OPEN = 64  # branches on one level after which a query is taken to visit many cells
QUERY_BLOCK = 32768
TASK_ROWS = 50_000  # candidates per task, at least
CHUNK_CELLS = 1 << 20  # numbers in one distance matrix
CHUNK_ROWS = 128
LARGEST = 1e150  # squares and their sums stay finite


def nearest_neighbors(
    queries: DataFrame,
    candidates: DataFrame,
    features: Sequence[str],
    k: int,
    row_id: str,
    skip_self: bool,
    seed: int = 42,
    cell_rows: int = CELL_ROWS,
    p: int = 2,
    carry: Sequence[str] = (),
    small: int = SMALL,
) -> DataFrame:
    """(query, rank, neighbor, distance), rank 1..k by (distance, neighbour key).

    ``features`` may be plain columns or one array column. With
    ``skip_self`` a row is not its own neighbour; copies of it still are.
    ``carry`` adds these numbers of the neighbour as an array ``carried``:
    joining them on later would meet hot keys, as a row with many copies
    around it is everybody's neighbour.
    """
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    spare = k + 1 if skip_self else k
    points = stage(_distinct_enough(_as_vectors(candidates, features, row_id, carry), spare), "knn-points")
    asked = _as_vectors(queries, features, row_id)
    total = points.count()
    if total <= small:
        return _search_small(asked, points, k, skip_self, p, carry)

    splits = _splits(points, total, cell_rows, seed)
    celled = stage(_to_cells(points, splits), "knn-cells")
    boxes = _boxes(celled, splits)
    asked = stage(_to_cells(asked, splits), "knn-queries")
    unbound = asked.withColumn("bound", F.lit(math.inf))
    own = stage(_ranked(_search(unbound, celled, k, skip_self, p, total), k, ["c"]), "knn-own")

    # How far the k-th hit in the own cell is; no bound if the cell had fewer.
    reach = own.filter(F.col("rank") == k).select(F.col("query").alias("id"), F.col("distance").alias("reach"))
    groups = _group_level(total, splits.depth)
    further = stage(_other_cells(asked.join(reach, "id", "left"), boxes, p, groups, spare), "knn-further")
    far = further.filter("cell < 0").select(F.col("id").alias("query")).distinct()
    own = own.join(far, "query", "left_anti")  # the groups hold the own cell as well
    grouped = celled.withColumn("cell", -1 - F.shiftright("cell", splits.depth - groups))
    rest = _search(further, celled.unionByName(grouped), k, skip_self, p, total)
    return _ranked(own.withColumnRenamed("carried", "c").drop("rank").unionByName(rest), k, carry)


@dataclass(frozen=True)
class _Splits:
    """A full binary tree: node i has children 2i + 1 and 2i + 2, rows with x[feature] > border go to the second."""

    depth: int
    feature: np.ndarray
    border: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[every, self.feature[node]] > self.border[node])
        return node - (2**self.depth - 1)


def _splits(points: DataFrame, total: int, cell_rows: int, seed: int) -> _Splits:
    """Medians of the widest feature, of a random sample of at most ``TREE_BYTES``.
    Any choice of splits gives the same neighbours."""
    width = max(1, len(points.first()["x"]))
    most = max(1, min(-(-total // cell_rows), MAX_CELLS, TREE_BYTES // (32 * width)))
    depth = max(0, (most - 1).bit_length())
    wanted = min(SAMPLE << depth, TREE_BYTES // (8 * width))
    likely = points.filter(uniform(seed, "pivot", "id") < wanted / total)
    sample = np.array([r["x"] for r in likely.select("x").collect()], float).reshape(-1, width)
    feature, border = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    held = {0: sample}
    for node in range(2**depth - 1):
        x = held.pop(node, sample[:0])
        if len(x) < 2:
            continue
        j = int((x.max(axis=0) / 2 - x.min(axis=0) / 2).argmax())
        at = np.sort(x[:, j])
        if at[0] == at[-1]:
            continue
        # the last value up to the middle that has larger ones behind it
        middle = at[(len(at) - 1) // 2]
        feature[node], border[node] = j, middle if middle < at[-1] else at[at < at[-1]][-1]
        beyond = x[:, j] > border[node]
        held[2 * node + 1], held[2 * node + 2] = x[~beyond], x[beyond]
    return _Splits(depth, feature, border)


def _group_level(total: int, depth: int) -> int:
    """The level of the tree whose branches are groups."""
    groups = max(min(total // CANDIDATE_BLOCK, MOST_GROUPS), total // FULL_BLOCK, 1)
    return min(groups.bit_length() - 1, depth)


def _doubles(columns: Sequence[str]):
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns]).cast("array<double>")


def _as_vectors(df: DataFrame, features: Sequence[str], row_id: str, carry: Sequence[str] = ()) -> DataFrame:
    """Keys with an array of doubles; -0.0 becomes 0.0 so equal points are equal arrays."""
    if len(features) == 1 and dict(df.dtypes)[features[0]].startswith("array"):
        x = F.transform(F.col(features[0]).cast("array<double>"), lambda v: v + F.lit(0.0))
    else:
        x = _doubles(features)
    return df.select(F.col(row_id).alias("id"), x.alias("x"), _doubles(carry).alias("c"))


def _distinct_enough(points: DataFrame, keep: int) -> DataFrame:
    """Of equal points only the ``keep`` smallest keys can ever be neighbours.

    Spark limits each group before the shuffle, so a point holding a third
    of all rows sends ``keep`` rows per task.
    """
    same = Window.partitionBy("x").orderBy("id")
    return points.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= keep).drop("_r")


def _ranked(found: DataFrame, k: int, carry: Sequence[str]) -> DataFrame:
    best = Window.partitionBy("query").orderBy("distance", "neighbor")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query", "rank", "neighbor", "distance", *([F.col("c").alias("carried")] if carry else []))


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(float)
    if not np.isfinite(x).all():
        raise ValueError("neighbour features must not be missing or infinite")
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"neighbour features beyond {LARGEST:g} have no finite distance")
    return x


def _length(gaps: Iterator[np.ndarray], shape: int | tuple[int, ...], p: int) -> np.ndarray:
    """Distances from gaps per feature, summed feature by feature: equal gaps give equal distances, smaller ones no larger distance."""
    total = np.zeros(shape)
    for gap in gaps:
        total += gap * gap if p == 2 else np.abs(gap)
    return np.sqrt(total) if p == 2 else total


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Of every row of ``a`` to every row of ``b``."""
    return _length((a[:, j, None] - b[None, :, j] for j in range(a.shape[1])), (len(a), len(b)), p)


def _to_cells(points: DataFrame, splits: _Splits) -> DataFrame:
    """The splits (at most ``MAX_CELLS``) travel with the task."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not frame.empty:
                yield frame.assign(cell=splits.cells(_matrix(frame["x"])).astype(np.int32))

    kind = dict(points.dtypes)["id"]
    return points.mapInPandas(assign, f"id {kind}, x array<double>, c array<double>, cell int")


@dataclass(frozen=True)
class _Boxes:
    """Extent and number of the candidates below every node; of none, the extent is empty and infinitely far."""

    depth: int
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def least(self, x: np.ndarray, at: np.ndarray, node: np.ndarray, p: int) -> np.ndarray:
        """No candidate below ``node`` is closer to row ``at``. Holds for rounded distances too, as each gap is no larger."""
        gaps = (np.maximum(np.maximum(self.low[node, j] - x[at, j], x[at, j] - self.high[node, j]), 0.0) for j in range(x.shape[1]))
        return _length(gaps, len(at), p)

    def ceiling(self, x: np.ndarray, cell: np.ndarray, p: int, keep: int) -> np.ndarray:
        """A distance within which a row has ``keep`` candidates: those of the smallest branch around it that has as many."""
        node = cell + 2**self.depth - 1
        for _ in range(self.depth):
            node = np.where(self.rows[node] < keep, (node - 1) // 2, node)
        gaps = (np.maximum(np.abs(x[:, j] - self.low[node, j]), np.abs(x[:, j] - self.high[node, j])) for j in range(x.shape[1]))
        return np.where(self.rows[node] < keep, np.inf, _length(gaps, len(x), p))


def _boxes(celled: DataFrame, splits: _Splits) -> _Boxes:
    """Numbers per cell that fit into ``TREE_BYTES``, carried up the tree."""
    width, leaves = len(celled.first()["x"]), 2**splits.depth
    extent = lambda f: F.array(*[f(F.get("x", F.lit(j))) for j in range(width)])
    found = celled.groupBy("cell").agg(F.count("*").alias("n"), extent(F.min).alias("low"), extent(F.max).alias("high")).collect()
    low, high, rows = np.full((2 * leaves - 1, width), np.inf), np.full((2 * leaves - 1, width), -np.inf), np.zeros(2 * leaves - 1, np.int64)
    for r in found:
        node = r["cell"] + leaves - 1
        low[node], high[node], rows[node] = r["low"], r["high"], r["n"]
    for node in range(leaves - 2, -1, -1):
        a, b = 2 * node + 1, 2 * node + 2
        low[node], high[node], rows[node] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b]), rows[a] + rows[b]
    return _Boxes(splits.depth, low, high, rows)


def _other_cells(asked: DataFrame, boxes: _Boxes, p: int, level: int, keep: int) -> DataFrame:
    """One row per query and cell that may still hold a closer neighbour, with a bound of the k-th distance.

    A query with more than ``FEW_CELLS`` of them visits the groups (branches at ``level``, numbered
    -1, -2 ...) that may, its own cell's among them."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            x, own = _matrix(frame["x"]), frame["cell"].to_numpy()
            bound = frame["reach"].fillna(np.inf).to_numpy(dtype=float).copy()
            lost = np.flatnonzero(np.isinf(bound))
            bound[lost] = boxes.ceiling(x[lost], own[lost], p, keep)
            at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            many = np.zeros(len(x), bool)
            for depth in range(boxes.depth + 1):
                if depth == level:
                    group_at, group = at, node - (2**level - 1)
                if depth == boxes.depth:
                    break
                if depth >= level:
                    many |= np.bincount(at, minlength=len(x)) > MOST_OPEN
                    at, node = at[~many[at]], node[~many[at]]
                at, node = np.repeat(at, 2), np.stack([2 * node + 1, 2 * node + 2], axis=1).ravel()
                open_ = boxes.least(x, at, node, p) <= bound[at]
                at, node = at[open_], node[open_]
            cell = node - (2**boxes.depth - 1)
            at, cell = at[cell != own[at]], cell[cell != own[at]]
            many |= np.bincount(at, minlength=len(x)) > FEW_CELLS
            few, wide = ~many[at], many[group_at]
            at, cell = np.concatenate([at[few], group_at[wide]]), np.concatenate([cell[few], -1 - group[wide]])
            if len(at):
                yield pd.DataFrame({
                    "id": frame["id"].to_numpy()[at], "x": list(x[at]), "cell": cell.astype(np.int32), "bound": bound[at],
                })

    kind = dict(asked.dtypes)["id"]
    return asked.mapInPandas(look, f"id {kind}, x array<double>, cell int, bound double")


def _search(asked: DataFrame, points: DataFrame, k: int, skip_self: bool, p: int, total: int) -> DataFrame:
    """Up to k nearest candidates per query and block.

    A cell larger than one block is cut on both sides and every query block
    meets every candidate block, each pair in its own task group. Cells
    nobody asks for are not shuffled.
    """
    # groups are about as large as their number and the power of two below it allow
    block = max(2 * CANDIDATE_BLOCK, min(4 * total // MOST_GROUPS, 2 * FULL_BLOCK))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = (
        asked.groupBy("cell").agg(F.count("*").alias("q"))
        .join(points.groupBy("cell").agg(F.count("*").alias("c")), "cell")
        .select("cell", blocks("q", QUERY_BLOCK).alias("nq"), blocks("c", block).alias("nc"))
    )
    sizes = F.broadcast(sizes)  # three numbers for at most twice MAX_CELLS cells
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "cell").select("id", "x", "bound", "cell", mine("nq").alias("qb"), every("nc").alias("cb"))
    right = points.join(sizes, "cell").select("id", "x", "c", "cell", mine("nc").alias("cb"), every("nq").alias("qb"))
    keys = ["cell", "qb", "cb"]

    def nothing() -> pd.DataFrame:
        return pd.DataFrame({"query": [], "neighbor": [], "distance": [], "c": []}, dtype=object)

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return nothing()
        found = [f.drop(columns="rank") for f in _best(q, _Candidates.of(c), k, skip_self, p)]
        return pd.concat(found, ignore_index=True) if found else nothing()

    kq, kc = dict(asked.dtypes)["id"], dict(points.dtypes)["id"]
    schema = f"query {kq}, neighbor {kc}, distance double, c array<double>"
    # A fixed number of tasks: the work is in the pairs, which shuffle sizes do not show.
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def _search_small(asked: DataFrame, points: DataFrame, k: int, skip_self: bool, p: int, carry: Sequence[str]) -> DataFrame:
    """Candidates few enough to travel (their number was counted): no shuffle at all."""
    rows = points.select("id", "x", "c").collect()
    candidates = _Candidates.of(pd.DataFrame(rows, columns=["id", "x", "c"])) if rows else None

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if candidates is not None and not frame.empty:
                yield from _best(frame, candidates, k, skip_self, p)

    kq, kc = dict(asked.dtypes)["id"], dict(points.dtypes)["id"]
    schema = f"query {kq}, neighbor {kc}, distance double, c array<double>, rank int"
    found = asked.withColumn("bound", F.lit(math.inf)).mapInPandas(meet, schema)
    return found.select("query", "rank", "neighbor", "distance", *([F.col("c").alias("carried")] if carry else []))


@dataclass(frozen=True)
class _Candidates:
    """Points in key order, so that equal distances keep the smaller key."""

    ids: np.ndarray
    x: np.ndarray
    carried: np.ndarray

    @classmethod
    def of(cls, frame: pd.DataFrame) -> _Candidates:
        frame = frame.sort_values("id", kind="stable")
        return cls(frame["id"].to_numpy(), _matrix(frame["x"]), frame["c"].to_numpy())


@dataclass(frozen=True)
class _Estimate:
    """Squared distances less the query's own square, in short numbers around the candidates' mean, by one matrix product."""

    middle: np.ndarray
    scale: float
    right: np.ndarray  # width + 1 by candidates
    longest: float

    @classmethod
    def of(cls, x: np.ndarray, asked: np.ndarray) -> _Estimate:
        middle = x.mean(axis=0)
        scale = float(max(np.abs(x - middle).max(initial=0.0), np.abs(asked - middle).max(initial=0.0))) or 1.0
        v = (x - middle) / scale
        squares = (v * v).sum(axis=1)
        return cls(middle, scale, np.vstack([-2 * v.T, squares]).astype(np.float32), math.sqrt(squares.max(initial=0.0)))

    def rows(self, asked: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left side of the product, what its rounding may add up to (twice, to compare two), and the bounds as estimates."""
        u = (asked - self.middle) / self.scale
        squares = (u * u).sum(axis=1)
        slack = 4 * (u.shape[1] + 8) * np.finfo(np.float32).eps * (np.sqrt(squares) + self.longest) ** 2
        with np.errstate(over="ignore"):  # a bound too large to square is none
            limit = (bound / self.scale) ** 2 - squares
        return np.column_stack([u, np.ones(len(u))]).astype(np.float32), slack, limit


def _kth(a: np.ndarray, k: int) -> np.ndarray:
    """Per row a number that at least k of its columns do not exceed, close to the k-th smallest."""
    if a.shape[1] < k:
        return np.full(len(a), np.inf)
    runs = max(1, min(64, a.shape[1] // (8 * k)))
    if runs > 1:  # the least of every run: k runs hold k columns
        a = a[:, : a.shape[1] // runs * runs].reshape(len(a), runs, -1).min(axis=1)
    return np.partition(a, k - 1, axis=1)[:, k - 1]


def _open_pairs(x: np.ndarray, bound: np.ndarray, c: np.ndarray, k: int, p: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A slice of the queries at a time, with all pairs (row of the slice, candidate) that may be among its k nearest."""
    estimate = _Estimate.of(c, x) if p == 2 else None
    wide = max(1, CHUNK_CELLS // CHUNK_ROWS)
    for first in range(0, len(x), CHUNK_ROWS):
        part = slice(first, first + CHUNK_ROWS)
        if estimate:
            left, slack, limit = estimate.rows(x[part], bound[part])
        else:
            left, slack, limit = x[part], 0.0, bound[part]
        limit, rows, columns = limit + slack, [], []
        for at in range(0, len(c), wide):
            a = left @ estimate.right[:, at : at + wide] if estimate else _distances(left, c[at : at + wide], p)
            if at == 0:
                limit = np.minimum(limit, _kth(a, k).astype(float) + slack)
            # compared in short numbers; the slack covers their rounding
            with np.errstate(over="ignore"):
                row, column = np.nonzero(a <= limit.astype(a.dtype)[:, None])
            rows.append(row)
            columns.append(column + at)
        yield part, np.concatenate(rows), np.concatenate(columns)


def _best(q: pd.DataFrame, c: _Candidates, k: int, skip_self: bool, p: int) -> Iterator[pd.DataFrame]:
    """The k nearest candidates of every query row, but none beyond its bound; a bounded matrix at a time."""
    if not len(c.ids):
        return
    qids, x, bound = q["id"].to_numpy(), _matrix(q["x"]), q["bound"].to_numpy(dtype=float)
    for part, row, col in _open_pairs(x, bound, c.x, k + 1 if skip_self else k, p):
        mine = x[part]
        d = _length((mine[row, j] - c.x[col, j] for j in range(mine.shape[1])), len(row), p)
        keep = d <= bound[part][row]
        if skip_self:
            keep &= c.ids[col] != qids[part][row]
        row, col, d = row[keep], col[keep], d[keep]
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        row, col, d, place = row[best], col[best], d[best], place[best]
        if len(row):
            yield pd.DataFrame({
                "query": qids[part][row], "neighbor": c.ids[col], "distance": d, "c": c.carried[col],
                "rank": (place + 1).astype(np.int32),
            })
