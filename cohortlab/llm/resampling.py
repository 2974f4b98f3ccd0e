"""Operator 13: importance resampling towards a target, with hashed n-grams made by Arrow kernels.

Words come from ascii_lower, split_pattern_regex and list_flatten;
dictionary_encode gives every distinct word of a slice an index. An n-gram is a
pair of indices, of the run before it and of its last word, so shifted
index columns form all of them; each distinct pair is hashed once by extending the
CRC of its first part. Buckets and gains then come by take, and the sums of
documents by segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import packed, slices, table, texts
from cohortlab.operators.numbering import numbered

#: Bytes that are no part of a word; words of the longest feature; buckets; share drawn of documents with enough words.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDER, BUCKETS, PERCENT, MIN_WORDS = 3, 10_000, 5, 20


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts end to end, and the offsets of the texts; null has none."""
    flat, at = packed(column)  # ascii_lower misreads a slice that does not begin with its buffers
    whole = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(flat))
    parts = pc.split_pattern_regex(pc.ascii_lower(whole), NO_WORD)
    off = parts.offsets.to_numpy()
    flat = pc.list_flatten(parts)
    full = pc.not_equal(flat, "")  # a separator at either end of a text leaves an empty part
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[off - off[0]]


def features(column: pa.Array, buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature of the texts, the text it is of, and the number of words of each text."""
    flat, off = words(column)
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    coded = flat.dictionary_encode()
    said = coded.dictionary.cast(pa.large_binary()).to_pylist()
    word = coded.indices.to_numpy().astype(np.int64)
    tail = [b" " + w for w in said]
    run, sums, place = word, [crc32(w) for w in said], np.arange(len(word))
    found, of = [], []
    for k in range(1, order + 1):
        bucket = pa.array(np.array(sums, np.int64) % buckets)
        found.append(bucket.take(pa.array(run)).to_numpy())
        of.append(row[place])
        if k == order:
            break
        # runs that are not the last of their text are extended by the word that follows
        ahead = place + k
        go = ahead < off[1:][row[place]]
        run, place = run[go], place[go]
        pair = pa.array(run * max(len(said), 1) + word[place + k]).dictionary_encode()
        first, last = np.divmod(pair.dictionary.to_numpy(), max(len(said), 1))
        sums = [crc32(tail[b], sums[a]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        run = pair.indices.to_numpy().astype(np.int64)
    return np.concatenate(found), np.concatenate(of), n


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> list[int]:
    """Features of all rows in each bucket. A task sends one row per bucket at most, so the driver gets ``buckets`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            total += np.bincount(features(part.column("text"), buckets, order)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    sums = texts(docs).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log-ratio of each bucket's smoothed shares, target over raw, rounded down."""
    S, T, n = sum(raw), sum(target), len(raw)
    return [math.floor(1000 * math.log((t + 1) * (S + n) / ((s + 1) * (T + n)))) for s, t in zip(raw, target, strict=True)]


def weights(docs: DataFrame, gain: list[int], order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight (sum of the gains of its features) of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(gain, pa.int64())
        for part in slices(batches, "text"):
            bucket, of, n = features(part.column("text"), buckets, order)
            by_text = np.argsort(of, kind="stable")
            value = table.take(pa.array(bucket[by_text])).to_numpy()
            count = np.bincount(of, minlength=part.num_rows)
            some = np.flatnonzero(count)
            sums = np.zeros(part.num_rows, np.int64)
            if len(some):
                sums[some] = np.add.reduceat(value, (np.cumsum(count) - count)[some])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(count), pa.array(sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Thousandths of a standard Gumbel draw that depends on the document only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """Draw documents without replacement, likelier the more they resemble ``target``: doc_id, n_features, weight, score, rank.

    ``docs`` and ``target`` have a column ``text``, ``docs`` also doc_id. Of the
    N rows with at least ``min_words`` words, the floor(percent * N / 100) highest scores
    get a rank, ties to the smaller doc_id (null first); other rows have a null rank. A
    null or empty text has no features and weight 0; a null doc_id draws as
    an empty one; rows that repeat a doc_id are rows of their own; an empty table gives no
    rows; an empty target gives gains by the raw counts alone. Other columns are ignored.
    """
    asked = target.select(F.lit(0).alias("doc_id"), "text")
    gain = gains(bucket_counts(docs, buckets, order), bucket_counts(asked, buckets, order))
    rows = weights(docs, gain, order).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    # rows that may not be drawn come behind all others, so one numbering serves both
    few = (F.col("n_words") < min_words).cast("int")
    one = rows.select(F.lit("").alias("all_"), few.alias("few_"), (-F.col("score")).alias("low_"), "doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("row_"))
    placed = numbered(one, "all_", [F.col("few_"), F.col("low_"), F.col("doc_id"), F.col("row_")], "resample")
    able = placed.filter("few_ = 0").count()
    rank = F.when((F.col("few_") == 0) & (F.col("idx") < percent * able // 100), F.col("idx") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
