"""Operator 9: benchmark items in texts, found by pigeonhole pieces and verified by Myers' bit-parallel distance.

An item may occur with up to k edits, a share of its length. Cut into k+1
pieces, at least one piece occurs unchanged. All pieces go into one automaton
that every task runs over its texts; around each hit the item's smallest edit
distance to the text decides. Items are read in blocks of bounded size, so what
is sent to the tasks does not grow with the benchmark; texts are not shuffled.

Texts are compared as UTF-8 bytes in which ASCII and Latin-1 letters are lower
case and every white-space byte is a blank; this keeps all offsets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import packed, slices, table, texts

#: Edits allowed, as a share of the item's bytes.
ERROR_RATE = 0.08
#: Bytes of items in one block, and so in one automaton.
BLOCK_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[9:14] = 32


def folded(flat: np.ndarray) -> np.ndarray:
    out = _LOWER[flat]
    if len(flat) > 1:
        second = np.flatnonzero(flat[:-1] == 0xC3) + 1
        upper = second[(flat[second] >= 0x80) & (flat[second] <= 0x9E) & (flat[second] != 0x97)]
        out[upper] += 32
    return out


def pieces(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    """The item in errors+1 parts of nearly equal length, with their offsets."""
    edges = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(pattern: bytes, text: bytes) -> list[int]:
    """For each end in ``text``, the smallest distance of ``pattern`` to a stretch that ends there (Myers 1999)."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        if mh & high:
            score -= 1
        ph <<= 1  # a match may begin anywhere
        mh <<= 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
        out.append(score)
    return out


def matches(item: bytes, errors: int, text: bytes) -> Iterator[tuple[int, int, int]]:
    """Disjoint stretches (start, end, distance) of ``text`` within ``errors`` edits of ``item``, left to right."""
    ends = myers(item, text)
    i = done = 0
    while i < len(ends):
        if ends[i] > errors:
            i += 1
            continue
        best = min(range(i, min(i + 2 * errors + 1, len(ends))), key=lambda e: (ends[e], -e))
        back = myers(item[::-1], text[done : best + 1][::-1][: len(item) + errors])
        length = min((n for n in range(len(back)) if back[n] == ends[best]), default=None)
        if length is None:  # it would reach into the match before
            i = best + 1
            continue
        yield best - length, best + 1, ends[best]
        done = i = best + 1


class Finder:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], error_rate: float):
        import ahocorasick

        self.items, where = [], defaultdict(list)
        for item_id, text in items:
            if text:
                errors = int(len(text) * error_rate)
                for offset, piece in pieces(text, errors):
                    where[piece].append((len(self.items), offset))
                self.items.append((item_id, text, errors))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, flat: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item_id, start byte, end byte, distance) of all matches in texts laid end to end."""
        if not self.items or not len(flat):
            return
        data = folded(flat).tobytes()
        starts = defaultdict(set)
        for end, (length, places) in self.automaton.iter(data.decode("latin-1")):
            hit = end + 1 - length
            for item, offset in places:
                starts[item].add((hit, hit - offset))
        for item, found in starts.items():
            item_id, text, errors = self.items[item]
            hits, at = np.array(sorted(found)).T
            rows = np.searchsorted(off, hits, "right") - 1  # the text that the hit itself begins in, whose start may lie before it
            for row in np.unique(rows):
                low, high = int(off[row]), int(off[row + 1])
                if high - low < len(text) - errors:
                    continue
                mine = np.unique(at[(rows == row) & (at >= low - errors) & (at + len(text) <= high + errors)])
                for a, b in _regions(mine, len(text), errors, low, high):
                    for start, stop, distance in matches(text, errors, data[a:b]):
                        yield int(row), item_id, a + start - low, a + stop - low, distance


def _regions(at: np.ndarray, length: int, errors: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Stretches to verify: each start with the slack of the error budget, overlapping ones joined."""
    a = b = None
    for x in at.tolist():
        p, q = max(low, x - errors), min(high, x + length + errors)
        if b is not None and p <= b:
            b = max(b, q)
            continue
        if b is not None:
            yield a, b
        a, b = p, q
    if b is not None:
        yield a, b


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about ``block_bytes``, one at a time on the driver. Null texts and ids are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id IS NOT NULL AND text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for part in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        rows = mine.distinct().collect()
        yield [(r["item_id"], folded(np.frombuffer(r["text"].encode(), np.uint8)).tobytes()) for r in rows]


SCHEMA = "doc_id long, item_id long, start long, end long, distance int"


def find_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every stretch of a document within the error budget of a benchmark item.

    One row per match: doc_id, item_id, start and end (code points of the
    document's text), distance (edits in folded bytes). Matches of one item in one
    document do not overlap. Null and empty texts have no matches and are no
    items; repeated rows are searched alike; empty tables give no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    source, out = texts(docs), None
    for block in blocks(benchmark, block_bytes):
        found = source.mapInArrow(_search(block, error_rate), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def _search(block: list[tuple[int, bytes]], error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(block, error_rate)
        for part in slices(batches, "text"):
            flat, off = packed(part.column("text"))
            rows = []
            for row, item, a, b, distance in finder.find(flat, off):
                mine = flat[off[row] : off[row + 1]]
                first = np.count_nonzero((mine[:a] & 0xC0) != 0x80)
                rows.append((row, item, first, first + np.count_nonzero((mine[a:b] & 0xC0) != 0x80), distance))
            if rows:
                row, *rest = map(list, zip(*rows, strict=True))
                ids = part.column("doc_id").take(pa.array(row, pa.int64()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))],
                    names=["doc_id", "item_id", "start", "end", "distance"],
                )

    return run


def clean_rows(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with their own columns. Nothing is joined or shuffled."""
    from cohortlab.llm.common import bounded_batches

    bounded_batches(docs.sparkSession)
    for block in blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(_keep(block, error_rate), docs.schema)
    return docs


def _keep(block: list[tuple[int, bytes]], error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(block, error_rate)
        for part in slices(batches, "text"):
            keep = np.ones(part.num_rows, bool)
            for row, *_ in finder.find(*packed(part.column("text"))):
                keep[row] = False
            yield part.filter(pa.array(keep))

    return run


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
