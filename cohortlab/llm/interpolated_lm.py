"""Operator 7: a language model by deleted interpolation.

The probability of a token mixes three estimates: uniform, relative frequency,
and relative frequency behind the word before. The weights depend on how often
that word was seen, in buckets of doubling width. They are learned by
expectation-maximisation on a part of the training documents that is held back
from the counts (the deleted part); then the model counts all training documents.

The corpus becomes a table of blocks of documents: a vocabulary of hashes and
the tokens as places in it. Each block sends its distinct words and pairs, as
sorted lists cut by ranges of the hash, to where a range is summed over all
blocks, and gets the sums back in its own order. So every count is exact and
covers the corpus, a frequent word costs one entry per block, and a document's
text is never shuffled. Hashes have 64 bits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import packed, slices, table, texts
from cohortlab.llm.words import hashes, mix, spans
from cohortlab.session import stage

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Steps of the learned weights at most, and the gain per token in natural logarithms that ends them.
STEPS, GAIN = 100, 1e-7
#: Contexts are bucketed by the binary logarithm of their count.
BUCKETS = 40
#: Probabilities of the deleted part are counted in steps of 1/8 octave; that bounds what reaches the driver.
OCTAVE = 8

#: Bytes of text hashed at a time.
HASHED = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
START, END = np.uint64(1), np.uint64(2)


def tokens(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, one END behind each text, and the texts' offsets."""
    low = _LOWER[flat]
    start, end, first = spans(~_SPACE[low], off)
    to = first + np.arange(len(first))
    out = np.full(int(to[-1]), END, np.uint64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    out[np.arange(len(start)) + row] = hashes(low, start, end)
    return out, to


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes as their steps, byte by byte, so that the empty high bytes compress away."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pack(steps.view(np.uint8).reshape(-1, 8).T.copy())


def unpack_sorted(data: bytes) -> np.ndarray:
    columns = unpack(data, np.uint8).reshape(8, -1)
    return np.cumsum(columns.T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _stream(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a batch; its texts are hashed a little at a time."""
    said = [tokens(*packed(x.column("text"))) for x in slices(iter([part]), "text", HASHED)]
    sizes = np.concatenate([np.diff(first) for _, first in said])
    return np.concatenate([stream for stream, _ in said]), np.concatenate([[0], np.cumsum(sizes)])


BLOCK = "deleted boolean, docs binary, missing binary, counted binary, first binary, vocabulary binary, tokens binary, trained long"


def blocks(docs: DataFrame) -> DataFrame:
    """The corpus as blocks. Documents of the deleted part stand in blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            fold = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids])
            rows = []
            for deleted in (False, True):
                mine = np.flatnonzero((fold == DELETED) == deleted)
                if not len(mine):
                    continue
                stream, first = _stream(part.take(pa.array(mine)))
                vocabulary, at = np.unique(np.append(stream, START), return_inverse=True)
                known = np.array([ids[i] or 0 for i in mine], np.int64)
                missing, counted = np.array([ids[i] is None for i in mine]), fold[mine] != HELD_OUT
                rows.append((deleted, known.tobytes(), missing.tobytes(), counted.tobytes(), first.tobytes(), pack_sorted(vocabulary), pack(at[:-1].astype("<i4")), int(np.diff(first)[counted].sum())))
            kinds = [pa.bool_(), *[pa.binary()] * 6, pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["deleted", "docs", "missing", "counted", "first", "vocabulary", "tokens", "trained"],
            )

    made = texts(docs).mapInArrow(run, BLOCK)
    return stage(made.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")


class Block:
    """A block read back: per token its word and its pair with the word before, as places in sorted lists of hashes."""

    def __init__(self, row: dict):
        self.docs, self.missing = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["missing"], bool)
        self.first = np.frombuffer(row["first"], np.int64)
        counted = np.frombuffer(row["counted"], bool)
        self.words = unpack_sorted(row["vocabulary"])
        self.word = unpack(row["tokens"], "<i4").astype(np.int64)
        self.start = int(np.searchsorted(self.words, START))
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.first[:-1]] = self.start
        pair = mix(self.words[self.context] * np.uint64(0x9E3779B97F4A7C15) + mix(self.words[self.word]))
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.counted = np.repeat(counted, np.diff(self.first))
        self.starts = int(counted.sum())

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in training documents of each word and pair; of START, the training documents."""
        ones = np.bincount(self.word[self.counted], minlength=len(self.words))
        ones[self.start] = self.starts
        return ones, np.bincount(self.pair[self.counted], minlength=len(self.pairs))


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def entries(made: DataFrame, bits: int) -> DataFrame:
    """Sorted hashes and counts of each block, cut into 2**bits ranges per order; ranges without an entry send nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            block, out = Block(row), []
            for order, (keys, n) in enumerate(zip((block.words, block.pairs), block.counts(), strict=True)):
                edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(2**bits + 1))
                for part in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = edges[part], edges[part + 1]
                    out.append((order, part, pack_sorted(keys[a:b]), pack(n[a:b].astype("<i4"))))
            order, part, keys, n = zip(*out, strict=True)
            size = len(out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"]] * size, pa.int64()), pa.array([row["deleted"]] * size), pa.array(order, pa.int32()),
                    pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(n, pa.binary()),
                ],
                names=["block", "deleted", "order", "part", "keys", "n"],
            )

    return made.mapInArrow(run, "block long, deleted boolean, order int, part int, keys binary, n binary")


SUMS = "block long, deleted boolean, order int, part int, kept binary, whole binary, distinct long, total long"


def sums(rows: DataFrame) -> DataFrame:
    """For each block and range the corpus counts of its entries: of all training documents and, for deleted blocks, without the deleted part.

    One row of a range also has its number of distinct words and their total, START left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys = [unpack_sorted(r[4]) for r in held]
            size = np.array([len(k) for k in keys])
            keys, n = np.concatenate(keys), np.concatenate([unpack(r[5], "<i4") for r in held])
            found, at = np.unique(keys, return_inverse=True)
            whole = np.bincount(at, n, len(found))
            kept = np.bincount(at, np.where(np.repeat([r[1] for r in held], size), 0, n), len(found))
            real = (whole > 0) & (found != START)
            distinct, total = [0] * len(held), [0] * len(held)
            distinct[0], total[0] = int(real.sum()), int(whole[real].sum())
            edges = np.concatenate([[0], np.cumsum(size)])
            back = [at[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.bool_()),
                    pa.array([r[2] for r in held], pa.int32()), pa.array([r[3] for r in held], pa.int32()),
                    pa.array([pack(kept[x].astype("<i8")) if r[1] else b"" for x, r in zip(back, held, strict=True)], pa.binary()),
                    pa.array([pack(whole[x].astype("<i8")) for x in back], pa.binary()),
                    pa.array(distinct, pa.int64()), pa.array(total, pa.int64()),
                ],
                names=["block", "deleted", "order", "part", "kept", "whole", "distinct", "total"],
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("block", "deleted", "order", "part", "keys", "n"))
            for row in zip(*columns, strict=True):
                if held and row[2:4] != held[-1][2:4]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    return rows.repartition("order", "part").sortWithinPartitions("order", "part").mapInArrow(run, SUMS)


def with_counts(made: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Blocks beside their counts, in the order of their entries."""
    lists = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("order", "part", F.col(column).alias("n")))).alias("counts"))
    return made.join(lists, "block")


def counts_of(row: dict) -> list[np.ndarray]:
    out: list[list[bytes]] = [[], []]
    for entry in row["counts"]:
        out[entry["order"]].append(unpack(entry["n"], "<i8"))
    return [np.concatenate(x) for x in out]


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts that were not seen, then one bucket for each doubling of the count."""
    return np.minimum(np.frexp(np.maximum(count, 0.5))[1], BUCKETS - 1) * (count > 0)


def deleted_events(made: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """Tokens of the deleted part by context bucket and by steps of both relative frequencies in the kept part (-1: zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            block = Block(row)
            ones, twos = counts_of(row)
            seen = ones[block.context]
            p1 = ones[block.word] / max(total, 1)
            p2 = twos[block.pair] / np.maximum(seen, 1)
            cells = np.stack([bucket(seen), steps(p1), steps(p2)], 1)
            cells, n = np.unique(cells, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(cells[:, i], pa.int64()) for i in range(3)), pa.array(n, pa.int64())], names=["b", "q1", "q2", "n"]
            )

    held = with_counts(made.filter("deleted"), found.filter("deleted"), "kept")
    events = held.mapInArrow(run, "b long, q1 long, q2 long, n long")
    return events.groupBy("b", "q1", "q2").agg(F.sum("n").alias("n"))


def steps(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-OCTAVE * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64)


def learn_weights(b: np.ndarray, q1: np.ndarray, q2: np.ndarray, n: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (uniform, word, pair) of each bucket by expectation-maximisation; buckets without events take the ones below."""
    p = np.stack([np.full(len(b), uniform), *(np.where(q < 0, 0.0, 2.0 ** (-q / OCTAVE)) for q in (q1, q2))], 1)
    weights = np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    weights[0] = [0.2, 0.8, 0.0]  # a context that was not seen has no pairs
    last, total = -math.inf, max(n.sum(), 1)
    for _ in range(STEPS if len(b) else 0):
        share = weights[b] * p
        whole = share.sum(1)
        gained = float((n * np.log(whole)).sum()) / total
        if gained - last < GAIN:
            break
        last = gained
        part = share / whole[:, None] * n[:, None]
        new = np.stack([np.bincount(b, part[:, i], BUCKETS) for i in range(3)], 1) + 1e-3 * weights
        weights = new / new.sum(1, keepdims=True)
    events = np.bincount(b, n, BUCKETS)
    for i in range(2, BUCKETS):
        if not events[i]:
            weights[i] = weights[i - 1]
    return weights


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out.

    One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram) and score, both in base-10 logarithms. A null
    or empty text is one END. Training documents are scored by the counts they are
    part of. Without training documents every estimate but the uniform is
    zero. Repeated rows count as often as they occur; a null doc_id is hashed
    as empty text; an empty table gives no rows; other columns are ignored.
    """
    made = blocks(docs)
    n_blocks = made.count()
    bits = max(4, math.ceil(math.log2(max(n_blocks, 1))))
    found = stage(sums(entries(made, bits)), "lm-counts")
    totals = found.filter("order = 0").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    train, distinct = totals["n"] or 0, totals["v"] or 0
    kept = made.filter("NOT deleted").agg(F.sum("trained")).first()[0] or 0
    events = deleted_events(made, found, kept).collect()
    columns = np.array([tuple(r) for r in events], np.int64).reshape(-1, 4).T
    uniform = 1 / (distinct + 1)
    weights = learn_weights(*columns, uniform)
    log10 = math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            block = Block(row)
            ones, twos = counts_of(row)
            c, seen = ones[block.word], ones[block.context]
            mine = weights[bucket(seen)]
            p = mine[:, 0] * uniform + mine[:, 1] * c / max(train, 1) + mine[:, 2] * twos[block.pair] / np.maximum(seen, 1)
            base = np.log10((c + 1) / (train + distinct + 1))
            at = block.first[:-1]
            n = len(block.docs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.docs, mask=block.missing),
                    pa.array(np.diff(block.first)), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                    pa.array(np.full(n, train, np.int64)), pa.array(np.add.reduceat(base, at)),
                    pa.array(np.add.reduceat(np.log(p) / log10, at)),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    scored = with_counts(made, found, "whole").mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return scored.select("doc_id", (fold == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
