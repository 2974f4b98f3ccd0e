"""Operator 4: exact repeats of 100 bytes by column-wise construction of a collection's suffix order.

Each window of 100 bytes has an anchor: the first of its 20-byte grams with the
smallest hash. Texts are cut into pieces, runs of window starts with one anchor.
A window lies in exactly one piece; equal windows have equal anchors at equal
places, so they meet under the anchor's gram, which spreads the collection over
tasks with little more text than it has. Equal pieces are inserted once, with
the place of the first; of the others all windows are repeats. Grams that very
many different pieces have, as the edges of a passage in a large part of all
documents, are cut finer, into windows.

Pieces of grams with two or more different pieces enter the construction. They
are laid side by side with their anchors in one column, and a round puts one more
symbol before each: the order of the suffixes that begin in a column follows
from the column to its right by one stable distribution of its symbols (the
Burrows-Wheeler transform of the column), and common prefixes are carried along.
Suffixes in different columns hold no equal windows, so a round costs as much as
there are strings. There are at most 180 columns, however long the texts. Tasks
read the pieces from the sorted files of the shuffle and hold one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.llm.common import longs, packed, slices, table, texts
from cohortlab.llm.firsts import CUT, ROWS, earliest, is_repeat, occurrence_rows, row_spans, text_slices, with_spans
from cohortlab.session import stage

#: Bytes of a window; windows that also start earlier are removed.
LENGTH = 100
#: Bytes of the grams whose smallest names a window.
GRAM = 20
#: A gram is cut finer from this share of all pieces, and from this many at least: so at most 1/HOT_SHARE are.
HOT_SHARE, HOT_LEAST = 1e-4, 256
#: Bytes of texts that are cut at a time; each takes some 80 bytes of memory.
SLICE = 2 << 20
#: Bytes of pieces in one construction, unless one gram has more.
BATCH_BYTES = 2 << 20


def gram_hashes(flat: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each ``gram`` bytes, in order of place."""
    if len(flat) < gram:
        return np.zeros(0, np.uint64)
    part = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    part ^= part >> np.uint64(29)
    n, out, done, weight, width = len(flat) - gram + 1, None, 0, 0x100000001B3, 1
    while width <= gram:  # widths that are powers of two add up to the gram
        if gram & width:
            block = part[done : done + n]
            out = block if out is None else out * np.uint64(weight) + block
            done += width
        part, weight, width = part[:-width] * np.uint64(weight) + part[width:], weight * weight % 2**64, 2 * width
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def pieces(flat: np.ndarray, off: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first byte, end, key) of the pieces of texts laid end to end; bytes count from the text's begin."""
    none = np.zeros(0, np.int64)
    if len(flat) < LENGTH:
        return none, none, none, none
    grams = gram_hashes(flat)
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = sliding_min(grams >> np.uint64(32) << np.uint64(32) | place, LENGTH - GRAM + 1) & np.uint64(2**32 - 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= off[row + 1])
    if not len(at):
        return none, none, none, none
    anchor, row = anchor[at].astype(np.int64), row[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    if len(hot):
        new |= np.isin(grams[anchor], hot)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first] - off[row[first]]
    return row[first], start, start + n + LENGTH - 1, grams[anchor[first]].view(np.int64)


def _hot_counts(docs: DataFrame) -> DataFrame:
    """key, n: keys with several different pieces in a slice, and under the null key the number of all pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            flat, off = packed(part.column("text"))
            row, _, _, key = pieces(flat, off, np.zeros(0, np.uint64))
            ids, n = np.unique(key, return_counts=True)
            many = n >= 8
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids[many].tolist(), None], pa.int64()), pa.array([*n[many].tolist(), len(row)], pa.int64())],
                names=["key", "n"],
            )

    return texts(docs).mapInArrow(run, "key long, n long")


def hot_keys(docs: DataFrame) -> np.ndarray:
    """Keys with a large share of all pieces; never more than 1/HOT_SHARE."""
    counts = _hot_counts(docs).groupBy("key").agg(F.sum("n").alias("n"))
    counts = stage(counts.filter(F.col("key").isNull() | (F.col("n") >= HOT_LEAST)), "suffix-hot")
    whole = counts.filter("key IS NULL").agg(F.max("n")).first()[0] or 0
    rows = counts.filter(F.col("key").isNotNull() & (F.col("n") >= max(HOT_LEAST, int(whole * HOT_SHARE)))).collect()
    return np.array([r["key"] for r in rows], np.int64).view(np.uint64)


def piece_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Occurrence rows of the pieces of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for part in slices(batches, "text", SLICE):
            flat, off = packed(part.column("text"))
            row, start, end, key = pieces(flat, off, hot)
            if not len(row):
                continue
            data, base = flat.tobytes(), off[row]
            said = [digest(data[a:b]) for a, b in zip((base + start).tolist(), (base + end).tolist(), strict=True)]
            said = np.array(said, np.uint64).view(np.int64)
            if len(hot):  # a window that is cut out alone is spread by what it says
                key = np.where(np.isin(key.view(np.uint64), hot), said, key)
            yield occurrence_rows(longs(part.column("doc_id"))[row], start, end, key, said)

    return texts(docs).mapInArrow(run, ROWS)


_UNBORN, _GONE = 0, 0xFF  # right of a string's end, left of its begin; neither byte is in a UTF-8 text but NUL


def columns_of(strings: list[bytes], anchors: np.ndarray) -> tuple[np.ndarray, int]:
    """The strings as rows of symbols, one column per place before or behind the anchor; the anchors' column."""
    length = np.array([len(s) for s in strings], np.int64)
    left, right = int(anchors.max(initial=0)), int((length - anchors).max(initial=0))
    flat = np.frombuffer(b"".join(strings), np.uint8)
    flat = np.where(flat == _UNBORN, 0xF8, flat).astype(np.uint8)
    row = np.repeat(np.arange(len(strings)), length)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length) + left - anchors[row]
    symbols = np.full((left + right, len(strings)), _UNBORN, np.uint8)
    for c in range(left):
        symbols[c, left - anchors > c] = _GONE
    symbols[column, row] = flat
    return symbols, left


def suffix_orders(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From right to left, each column's strings in the order of their suffixes, and the common prefix with the one before (up to 255).

    Strings that begin further right are left out. The symbols of the new
    column, taken in the order of the column before, are its Burrows-Wheeler
    transform. Dealing the strings out by symbol gives the next order; the
    common prefix of two neighbours with the same symbol is one more than the
    smallest between them.
    """
    order, common = np.arange(symbols.shape[1]), np.zeros(symbols.shape[1], np.uint8)
    for column in range(len(symbols) - 1, -1, -1):
        transform = symbols[column][order]
        dealt = np.argsort(transform, kind="stable")
        dealt = dealt[: np.searchsorted(transform[dealt], _GONE)]
        said = transform[dealt]
        prefix = np.zeros(len(dealt), np.uint8)
        if len(dealt) > 1:
            twin = np.flatnonzero((said[1:] == said[:-1]) & (said[1:] != _UNBORN)) + 1
            prefix[twin] = np.minimum(range_min(common, dealt[twin - 1] + 1, dealt[twin]), 254) + 1
        order, common = order[dealt], prefix
        yield column, order, common


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low..high], both included."""
    width = high - low + 1
    level = np.frexp(width)[1] - 1
    out, table, step = np.empty(len(low), values.dtype), values, 1
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - step + 1])
        table = np.minimum(table[: len(table) - step], table[step:]) if len(table) > step else table
        step *= 2
    return out


def repeats_of(doc: np.ndarray, start: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, first byte) of the windows of these pieces that also start earlier in one of them."""
    length = np.array([len(s) for s in strings], np.int64)
    anchors = first_anchors(strings)
    symbols, middle = columns_of(strings, anchors)
    docs, places = [], []
    for column, order, common in suffix_orders(symbols):
        if column > middle:  # no window begins behind an anchor
            continue
        offset = column - middle + anchors[order]
        same = common >= LENGTH
        shared = np.flatnonzero((same | np.append(same[1:], False)) & (length[order] - offset >= LENGTH))
        if not len(shared):
            continue
        group = np.cumsum(~same)[shared]
        d, at = doc[order[shared]], start[order[shared]] + offset[shared]
        by = np.lexsort((at, d, group))
        group, d, at = group[by], d[by], at[by]
        lead = np.ones(len(group), bool)
        lead[1:] = group[1:] != group[:-1]
        of = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        later = (d != d[of]) | (at != at[of])
        docs.append(d[later])
        places.append(at[later])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *docs]), np.concatenate([none, *places])


def first_anchors(strings: list[bytes]) -> np.ndarray:
    """The place of the anchor in each piece: that of its first window, which all its windows share."""
    length = np.array([len(s) for s in strings], np.int64)
    grams = gram_hashes(np.frombuffer(b"".join(strings), np.uint8)) >> np.uint64(32) << np.uint64(32)
    base = np.cumsum(length) - length
    inside = base[:, None] + np.arange(LENGTH - GRAM + 1)
    return np.argmin(grams[inside], axis=1)


def _construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Constructions over the pieces of a task, which come in the order of their keys."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        _, doc, start, said = zip(*held, strict=True)
        d, at = repeats_of(np.array(doc, np.int64), np.array(start, np.int64), list(said))
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(at), pa.array(at + LENGTH)], names=["doc", "start", "end"])

    for batch in batches:
        for key, doc, start, said in zip(*(batch.column(c).to_pylist() for c in ("k1", "doc", "start", "piece")), strict=True):
            if size >= BATCH_BYTES and key != held[-1][0]:
                yield from flush()
                held, size = [], 0
            held.append((key, doc, start, said))
            size += len(said)
    if held:
        yield from flush()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Bytes to remove: doc (key of the document), start, end."""
    rows = piece_rows(docs, hot_keys(docs)).repartition("k1")
    by_key = Window.partitionBy("k1", F.col("state") == CUT)
    several = F.min("k2").over(by_key) != F.max("k2").over(by_key)
    marked = rows.withColumn("first", earliest()).withColumn("several", several)
    again = is_repeat()
    marked = stage(
        marked.filter(again | ((F.col("state") != CUT) & F.col("several"))).select("doc", "start", "end", "k1", again.alias("again")),
        "suffix-pieces",
    )
    known = marked.filter("again").select("doc", "start", "end")
    asked = marked.filter("NOT again").groupBy(F.col("doc").alias("doc_key")).agg(F.collect_list(F.struct("start", "end", "k1")).alias("pieces"))
    source = texts(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_key"), F.encode("text", "UTF-8").alias("bytes"))
    cut = source.join(asked, "doc_key").select("doc_key", "bytes", F.explode_outer("pieces").alias("p")).select(
        F.col("p.k1").alias("k1"), F.col("doc_key").alias("doc"), F.col("p.start").alias("start"),
        F.substring("bytes", F.col("p.start").cast("int") + 1, (F.col("p.end") - F.col("p.start")).cast("int")).alias("piece"),
    )
    found = cut.repartition("k1").sortWithinPartitions("k1").mapInArrow(_construct, "doc long, start long, end long")
    return known.unionByName(found)


def dedup_windows(docs: DataFrame) -> DataFrame:
    """What is left of every document when repeated windows are removed.

    One row per input row: doc_id, n_bytes, n_removed, n_spans, spans (array of
    start and end in bytes, maximal), kept (binary: the bytes that are left, end to end;
    a cut may part a character). A null or short text has no windows and stays; rows with
    one doc_id are one document read twice and treated alike; a null doc_id ranks first; an
    empty table gives no rows; other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in text_slices(batches):
            flat, off = packed(column)
            data, found = flat.tobytes(), list(row_spans(part))
            spans = [[{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)] for s, e in found]
            kept = []
            for i, (s, e) in enumerate(found):
                mine = data[off[i] : off[i + 1]]
                edges = [0, *np.column_stack([s, e]).ravel().tolist(), len(mine)]
                kept.append(b"".join(mine[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row").field("doc_id").cast(pa.int64()),
                    pa.array(np.diff(off)),
                    pa.array([int((e - s).sum()) for s, e in found], pa.int64()),
                    pa.array([len(s) for s, _ in found], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return with_spans(docs.select("doc_id", "text"), repeated_spans(docs)).mapInArrow(run, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_windows(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
