"""Operator 6: near-duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of two words, of which every allowed edit leaves
some unchanged, labelled with their occurrence
number. A sketch takes the two k-mers with the smallest hashes and keeps them
in the order of the text, so it agrees for texts that are close in edit
distance. Texts that share a sketch are candidates; the similarity is one minus
the edit distance of their words over the longer length, found by an alignment
in a band of the allowed edits, and 0.8 or more makes a link. Classes are the
connected components of the links.

Equal texts are one text before anything is paired. Rows of a sketch are
shuffled once; of those that meet in one batch before, only a leader goes
on, so a sketch of very many texts has few rows. The members of a bucket are paired with its leader, the
shortest text, which joins most groups of close texts; a bucket of m texts gives fewer than m pairs. Where several
classes still meet in a bucket, all pairs between them are compared inside the
tasks by their counts of words, and only those that these leave open are
written. So no pair of a bucket is left out, and no table holds all pairs of a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.llm.common import SLICE_BYTES, longs, packed, slices, table, texts
from cohortlab.llm.firsts import doc_key
from cohortlab.llm.words import mix, word_hashes
from cohortlab.session import scratch, stage

#: Words of a k-mer, sketches of a text of up to SHORT words (short texts have few k-mers in common) and of a longer one, and the similarity of a link.
K, SKETCHES, SHORT, LONG_SKETCHES, SIMILARITY = 2, 64, 16, 40, 0.8
#: Texts of a block that a task compares with another one.
BLOCK = 4096
#: Counters of a bag of words by the words of the text, and of the coarse one that is looked at first.
BAGS, COARSE = ((1024, 1024), (8192, 4096), (1 << 62, 16384)), 64
_PLACE = (1 << 24) - 1


def kmers(words: np.ndarray, off: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of texts laid end to end, and their offsets. A text of fewer than k words is one k-mer."""
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = off[row] + np.arange(to[-1]) - to[row]
    gram = np.zeros(len(at), np.uint64)
    for i in range(k):
        word = words[np.minimum(at + i, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
        gram = gram * np.uint64(0x100000001B3) + np.where(at + i < off[row + 1], word, np.uint64(i + 1))
    gram = mix(gram)
    # the occurrence number of a k-mer in its text
    own = gram ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    began = np.flatnonzero(new)
    seen = np.empty(len(order), np.uint64)
    seen[order] = np.arange(len(order)) - np.repeat(began, np.diff(np.append(began, len(order))))
    return mix(gram + seen * np.uint64(0xD6E8FEB86659FD93)), to


def sketches(labels: np.ndarray, off: np.ndarray, n: int = SKETCHES) -> np.ndarray:
    """One row of n sketches for each text with words, in order; texts without words have none."""
    full = np.flatnonzero(np.diff(off))
    first, count = off[full], np.diff(off)[full]
    place = (np.arange(len(labels)) - np.repeat(first, count)).astype(np.uint64) & np.uint64(_PLACE)
    out = np.empty((len(full), n), np.int64)
    high, low = np.uint64(~_PLACE & (2**64 - 1)), np.uint64(_PLACE)
    for j in range(n):
        seed = mix(np.array([2 * j + 1], np.uint64))[0]
        value = (labels ^ seed) * (seed | np.uint64(1))
        value ^= value >> np.uint64(29)
        value = ((value * np.uint64(0xBF58476D1CE4E5B9)) & high) | place
        one = np.minimum.reduceat(value, first)
        a = first + (one & low).astype(np.int64)
        value[a] = np.uint64(2**64 - 1)
        two = np.minimum.reduceat(value, first)
        b = np.where(count > 1, first + (two & low).astype(np.int64), a)
        early, late = np.minimum(a, b), np.maximum(a, b)
        out[:, j] = mix(labels[early] * np.uint64(0x9E3779B97F4A7C15) + mix(labels[late] + seed)).view(np.int64)
    return out


def _bags_of(words: np.ndarray, off: np.ndarray) -> pa.Array:
    """Per text, how often its words fall on each counter by their hashes; 255 stands for more. Longer texts have more counters."""
    n, out, least = np.diff(off), [b""] * (len(off) - 1), 0
    for most, width in BAGS:
        rows = np.flatnonzero((n >= least) & (n < most))
        least = most
        if len(rows):
            at = np.repeat(np.arange(len(rows)), n[rows]) * width
            mine = np.concatenate([words[off[i] : off[i + 1]] for i in rows.tolist()])
            bags = np.bincount(at + (mine % np.uint64(width)).astype(np.int64), minlength=len(rows) * width)
            for i, bag in zip(rows.tolist(), np.minimum(bags, 255).astype(np.uint8).reshape(-1, width), strict=True):
                out[i] = bag.tobytes()
    return pa.array(out, pa.binary())


def _folded(bag: np.ndarray, width: int) -> np.ndarray:
    """Bags (one a row) on fewer counters, as they would have been counted on these."""
    return np.minimum(bag.reshape(len(bag), -1, width).sum(1, dtype=np.int32), 255).astype(np.int16)


def _bags(column: pa.Array) -> list[np.ndarray]:
    flat, off = packed(column)
    return [flat[a:b] for a, b in zip(off, off[1:], strict=False)]


def _least_edits(more: np.ndarray) -> np.ndarray:
    """Edits that differences of counts (one pair a row) need: no edit changes more than one word on each side."""
    new = np.maximum(more, 0).sum(1, dtype=np.int64)
    return np.maximum(new, new - more.sum(1, dtype=np.int64))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts with words, by slices: their keys, hashes of the words, offsets, and both halves of the digests of the words."""
    for part in slices(batches, "text"):
        words, off = word_hashes(*packed(part.column("text")))
        full = np.flatnonzero(np.diff(off))
        if len(full):
            data = [xxhash.xxh3_128_digest(words[off[i] : off[i + 1]].tobytes()) for i in full.tolist()]
            halves = np.frombuffer(b"".join(data), "<i8").reshape(-1, 2)
            yield pa.array(longs(part.column("doc_id"))[full]), words, np.append(off[full], off[-1]), halves[:, 0].copy(), halves[:, 1].copy()


def digested(docs: DataFrame) -> DataFrame:
    """doc, d1, d2 (digest of the words) of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, _, _, d1, d2 in _hashed(batches):
            yield pa.RecordBatch.from_arrays([doc, pa.array(d1), pa.array(d2)], names=["doc", "d1", "d2"])

    return texts(docs).mapInArrow(run, "doc long, d1 long, d2 long")


def sketched(docs: DataFrame, n: int = SKETCHES) -> DataFrame:
    """doc, n_words, d1, d2 (digest of the words), the sketches and the bag of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, words, off, d1, d2 in _hashed(batches):
            found, size = sketches(*kmers(words, off), n), np.where(np.diff(off) <= SHORT, n, min(n, LONG_SKETCHES))
            found = found[np.arange(n) < size[:, None]]  # row by row, the first of each
            offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(np.diff(off)), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(offsets, pa.array(found)), _bags_of(words, off)],
                names=["doc", "n_words", "d1", "d2", "sketch", "bag"],
            )

    return texts(docs).mapInArrow(run, "doc long, n_words long, d1 long, d2 long, sketch array<long>, bag binary")


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sketches. Of those that share one in a batch, the shortest text leads and goes on; the others have their leader already."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rep, n = batch.column("rep").to_numpy(), batch.column("n_words").to_numpy()
        sketch = batch.column("sketch")
        off = sketch.offsets.to_numpy()
        row, key = np.repeat(np.arange(len(rep)), np.diff(off)), sketch.values.to_numpy()[off[0] : off[-1]]
        rank = np.empty(len(rep), np.int64)
        rank[np.lexsort((rep, n))] = np.arange(len(rep))
        order = np.lexsort((rank[row], key))
        row, key = row[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        lead = row[new][np.cumsum(new) - 1] if len(key) else row
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(new, key, mix(rep[row].view(np.uint64)).view(np.int64))), pa.array(key, mask=new), pa.array(rep[row]), pa.array(n[row]),
                pa.array(rep[lead], mask=new), pa.array(n[lead], mask=new),
            ],
            names=["spot", "key", "rep", "n_words", "lead", "lead_n"],
        )


def buckets(members: DataFrame) -> DataFrame:
    """Members of the buckets of two texts or more with their leader: key, rep, n_words, lead, lead_n, settled (led inside a batch).

    ``members``: rep, n_words, sketch. The shortest text leads, of equals the smallest; it has no row of its own.
    """
    rows = members.select("rep", "n_words", "sketch").mapInArrow(_led, "spot long, key long, rep long, n_words long, lead long, lead_n long")
    rows = rows.withColumn("settled", F.col("lead").isNotNull())
    first = F.first(F.struct("rep", "n_words")).over(Window.partitionBy("spot", "settled").orderBy("n_words", "rep"))
    led = rows.withColumn("first", first).select(
        F.coalesce("key", "spot").alias("key"), "rep", "n_words", F.coalesce("lead", "first.rep").alias("lead"), F.coalesce("lead_n", "first.n_words").alias("lead_n"), "settled"
    )
    return led.filter("rep <> lead")


def candidates(met: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b), a < b, of members of a bucket and their leader whose lengths allow the similarity."""
    allowed = 1 - similarity + 1e-9
    near = F.abs(F.col("n_words") - F.col("lead_n")) <= allowed * F.greatest("n_words", "lead_n")
    return met.filter(near).select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()


def likely(pairs: DataFrame, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose counts of words do not rule the similarity out. ``members``: rep, n_words, bag."""
    of = lambda c: members.select(F.col("rep").alias(c), F.col("n_words").alias(f"n_{c}"), F.col("bag").alias(f"bag_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bag_a", "bag_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.maximum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            one, two = _bags(batch.column("bag_a")), _bags(batch.column("bag_b"))
            keep = np.zeros(batch.num_rows, bool)
            width = np.array([min(len(x), len(y)) for x, y in zip(one, two, strict=True)], np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                for part in np.array_split(at, -(-len(at) * w // SLICE_BYTES)):
                    x, y = (np.concatenate([_folded(b[i][None], w) for i in part.tolist()]) for b in (one, two))
                    keep[part] = _least_edits(y - x) <= (1 - similarity) * n[part] + 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def nearest(pairs: DataFrame) -> DataFrame:
    """One pair (a, b) of each text ``b``, that with the smallest ``a``; in most groups these alone join all."""
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are not of one class (``labels``: node, class) yet."""
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("class").alias(name))
    named = pairs.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    return named.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _paired_blocks(rows: DataFrame, keys: list[str], what: Column, block: int) -> DataFrame:
    """Rows of a key, ``size`` of them, dealt into blocks by ``rep``; a row per key and two blocks (x <= y) with the list ``m`` of their rows."""
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    way = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, "side").alias("x"), F.greatest(i, "side").alias("y")))
    spread = dealt.select(*keys, "side", what.alias("row"), F.explode(way).alias("way"))
    return spread.groupBy(*keys, "way").agg(F.collect_list(F.struct("row", "side")).alias("m")).select(*keys, "way.x", "way.y", "m")


def crossings(met: DataFrame, labels: DataFrame, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of one bucket and of different classes that their lengths and words in common allow.

    ``labels``: node, class. ``members``: rep, n_words, bag. Only buckets in
    which classes still meet beside the leader are looked at, since the leader has met all
    members; where members were led inside batches, leaders count too. Their pairs are
    compared inside the tasks, by blocks, so that no table holds them. A pair that shares several
    sketches is looked at in the bucket of the first of them only; if classes do not meet there, one of
    the pair is its leader, and the pair has been aligned already.
    """
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("class").alias(name))
    named = met.join(of("rep", "own"), "rep", "left").join(of("lead", "led"), "lead", "left")
    named = named.select("key", "settled", F.coalesce("own", "rep").alias("own"), F.coalesce("led", "lead").alias("led"))
    sums = named.groupBy("key").agg(
        F.min("own").alias("low"), F.max("own").alias("high"), F.min("led").alias("low_led"), F.max("led").alias("high_led"), F.bool_or("settled").alias("deep")
    )
    mixed = sums.filter("low < high OR (deep AND least(low, low_led) < greatest(high, high_led))").select("key")
    ends = met.join(stage(mixed, "omh-mixed"), "key").select("key", F.explode(F.array("rep", "lead")).alias("rep")).distinct()
    ends = stage(ends.join(of("rep", "class"), "rep", "left").select("key", "rep", F.coalesce("class", "rep").alias("class")), "omh-ends")
    rows = ends.join(ends.groupBy("key").agg(F.count("*").alias("size")), "key").join(members.select("rep", "n_words", "bag", "sketch"), "rep")
    blocks = _paired_blocks(rows, ["key"], F.struct("rep", "n_words", "class", "bag", "sketch"), BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x, y, m in zip(*(batch.column(c).to_pylist() if c != "m" else batch.column(c) for c in ("key", "x", "y", "m")), strict=True):
                row = m.values.field("row")
                order = np.argsort(row.field("n_words").to_numpy(zero_copy_only=False), kind="stable")
                rep, n, kind = (row.field(c).to_numpy(zero_copy_only=False)[order] for c in ("rep", "n_words", "class"))
                side = m.values.field("side").to_numpy()[order]
                bags = _bags(row.field("bag"))
                bags = [bags[i] for i in order.tolist()]
                bag = np.concatenate([_folded(b[None], BAGS[0][1]) for b in bags])
                coarse = bag.reshape(len(bag), -1, COARSE).sum(1, dtype=np.int16)
                sketch, size = _rows_of(row.field("sketch"), order)
                reach = np.searchsorted(n, n / similarity + 1e-6, "right")  # longer texts beyond allow no link
                found = []
                for i in range(len(rep) - 1):
                    last = reach[i]
                    ask = kind[i + 1 : last] != kind[i]
                    if x != y:
                        ask &= side[i + 1 : last] != side[i]
                    at = i + 1 + np.flatnonzero(ask)
                    if len(at):
                        allowed = (1 - similarity) * n[at] + 1e-9
                        for counts in (coarse, bag):
                            ok = _least_edits(counts[at] - counts[i]) <= allowed
                            if counts is coarse:
                                ok[ok] = _first_common(sketch, size, i, at[ok]) == key
                            at, allowed = at[ok], allowed[ok]
                        at = np.array([k for k, most in zip(at.tolist(), allowed.tolist(), strict=True) if _may_align(bags[i], bags[k], most)], np.int64)
                        found.append(np.column_stack([np.full(len(at), rep[i]), rep[at]]))
                if found:
                    pairs = np.sort(np.concatenate(found), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _rows_of(lists: pa.Array, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of longs as a matrix in the given order, filled up with zeros, and their sizes."""
    off, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(off)[order]
    out = np.zeros((len(order), int(size.max(initial=1))), np.int64)
    for row, i in enumerate(order.tolist()):
        out[row, : size[row]] = values[off[i] : off[i + 1]]
    return out, size


def _first_common(sketch: np.ndarray, size: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """The first sketch that a text shares with each of the others, all of which share one."""
    same = (sketch[others] == sketch[one]) & (np.arange(sketch.shape[1]) < np.minimum(size[others], size[one])[:, None])
    return sketch[one][same.argmax(1)]


def aligned_within(x: list[int], y: list[int], allowed: int) -> int | None:
    """Edit distance of two lists if it is at most ``allowed``; only diagonals within that band are walked (Ukkonen 1985)."""
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    n, m = len(x), len(y)
    while n > low and m > low and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    x, y, n, m = x[low:n], y[low:m], n - low, m - low
    if abs(n - m) > allowed:
        return None
    if sum((Counter(x) & Counter(y)).values()) < max(n, m) - allowed:  # no alignment keeps more words than both share
        return None
    goal, far = m - n, {}  # far[d]: the furthest row on diagonal d (column minus row) with so many edits
    for edits in range(allowed + 1):
        now = {}
        for d in range(max(-edits, -n, goal - allowed + edits), min(edits, m, goal + allowed - edits) + 1):
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1) if edits else 0
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and x[i] == y[i + d]:
                i += 1
            now[d] = i
        if now.get(goal, -1) >= n:
            return edits
        far = now
    return None


def _may_align(one: np.ndarray, two: np.ndarray, allowed: float) -> bool:
    """Whether the counts of two bags leave the allowed edits open, on as many counters as both have."""
    width = min(len(one), len(two))
    if width == BAGS[0][1]:
        return True  # looked at already
    return _least_edits(_folded(two[None], width) - _folded(one[None], width))[0] <= allowed


def links(docs: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of the pairs (a, b) of document keys, those whose texts align: a, b, distance, similarity."""
    pairs = stage(pairs, "omh-pairs")
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "omh-wanted")  # written, so that its size is known before texts move
    said = texts(docs).select(doc_key().alias("rep"), "text").join(wanted, "rep", "left_semi")
    said = said.groupBy("rep").agg(F.max("text").alias("text"))
    side = lambda c, name: said.select(F.col("rep").alias(c), F.col("text").alias(name))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "x"):
            (wx, ox), (wy, oy) = word_hashes(*packed(part.column("x"))), word_hashes(*packed(part.column("y")))
            distance = []
            for i in range(part.num_rows):
                x, y = wx[ox[i] : ox[i + 1]].tolist(), wy[oy[i] : oy[i + 1]].tolist()
                distance.append(aligned_within(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9)))
            longest = np.maximum(np.diff(ox), np.diff(oy))
            keep = np.array([d is not None for d in distance])
            found = np.array([d or 0 for d in distance], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(found), pa.array(1 - found / np.maximum(longest, 1))],
                names=["a", "b", "distance", "similarity"],
            ).filter(pa.array(keep))

    return met.mapInArrow(run, "a long, b long, distance long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node, class: the smallest node of its component, for all nodes of the edges (a, b).

    Each node points to its smallest neighbour, pointers are followed to their
    roots, and the edges are drawn anew between the roots, of which there are at
    most half as many as nodes; so the edges are read whole only once. The tables of a
    round are written, so rounds do not pile up. Ends when no edge is left.
    """
    edges, found = stage(edges.select("a", "b"), "omh-edges"), None
    while True:
        ways = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        labels = ways.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("least"))
        labels = _roots(stage(labels.select("node", F.least("node", "least").alias("class")), "omh-labels"))
        to = labels.select(F.col("node").alias("class"), F.col("class").alias("root"))
        if found is None:
            found = labels
        else:
            found = stage(found.join(to, "class", "left").select("node", F.coalesce("root", "class").alias("class")), "omh-found")
        ends = edges.join(labels.select(F.col("node").alias("a"), F.col("class").alias("x")), "a").join(
            labels.select(F.col("node").alias("b"), F.col("class").alias("y")), "b"
        )
        edges = stage(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "omh-edges")
        if edges.isEmpty():
            return found


def _roots(labels: DataFrame) -> DataFrame:
    """Pointers (node, class) to smaller nodes, followed to their ends; each step doubles their reach."""
    total = lambda t: t.agg(F.sum(F.col("class").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    while True:
        up = labels.select(F.col("node").alias("class"), F.col("class").alias("up"))
        labels = stage(labels.join(up, "class").select("node", F.col("up").alias("class")), "omh-labels")
        now = total(labels)
        if now == before:
            return labels
        before = now


def joined_classes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes (node, class) with further edges (a, b) between them."""
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("class").alias(name))
    ends = edges.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    ends = ends.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    roots = components(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    known = labels.unionByName(roots.select("node", F.col("node").alias("class"))).distinct()  # texts without a class so far
    to = roots.select(F.col("node").alias("class"), F.col("class").alias("root"))
    return stage(known.join(to, "class", "left").select("node", F.coalesce("root", "class").alias("class")), "omh-found")


def extended(docs: DataFrame, labels: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The classes with those of the pairs (a, b) that align."""
    more = stage(links(docs, pairs, similarity).select("a", "b"), "omh-links")
    return labels if more.isEmpty() else joined_classes(labels, more)


def classes(docs: DataFrame, similarity: float = SIMILARITY, n: int = SKETCHES) -> DataFrame:
    """The class of every document whose text has words: doc (key), class (key of its first document).

    See ``near_duplicates`` for the cases of empty and repeated rows.
    """
    with scratch(docs.sparkSession):
        found = sketched(docs, n).groupBy("d1", "d2").agg(
            F.min("doc").alias("rep"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"), F.first("bag").alias("bag")
        )
        members = stage(found, "omh-texts")
        met = stage(buckets(members), "omh-met")
        pairs = stage(likely(candidates(met, similarity), members, similarity), "omh-pairs")
        labels = components(links(docs, nearest(pairs), similarity))
        labels = extended(docs, labels, apart(pairs, labels), similarity)
        labels = extended(docs, labels, crossings(met, labels, members, similarity), similarity)
        named = members.select("d1", "d2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        named = stage(named.select("d1", "d2", F.coalesce("class", "rep").alias("class")), "omh-classes", keep=True)
    return digested(docs).join(named, ["d1", "d2"]).select("doc", "class").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, n: int = SKETCHES) -> DataFrame:
    """Class of every document: doc_id, class_id (smallest doc_id of the class).

    Words are lower case; punctuation does not count. A text without
    words (null, empty) is like no other and is its own class. Rows with one
    doc_id are one document and give one row; a null doc_id ranks first; an
    empty table gives no rows; other columns are ignored.
    """
    found = classes(docs, similarity, n)
    ids = texts(docs).select(doc_key().alias("doc")).distinct()
    name = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    out = ids.join(found, "doc", "left").select("doc", F.coalesce("class", "doc").alias("class"))
    return out.select(name("doc").alias("doc_id"), name("class").alias("class_id"))


def first_rows(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, with their own columns; texts without words stay."""
    gone = classes(docs, similarity).filter("doc <> class").select("doc")
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    return docs.join(gone, key == gone["doc"], "left_anti")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
