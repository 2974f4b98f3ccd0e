"""Operator 1: likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Unigrams and bigrams of words are hashed into a fixed number of buckets. Two
multinomials over the buckets are counted: one over a trusted target, one over
the whole corpus. A document's score is its log-likelihood ratio per n-gram,
and it is kept if the score reaches a fixed threshold and the base rules hold.
Everything is DataFrame expressions; the only shuffle is of bucket counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import table

#: Buckets of the multinomials: what reaches the driver and each task is this many numbers.
BUCKETS = 1 << 16
#: Labelled documents of the trusted target at most, the smallest hashes of doc_id first.
TARGET_DOCS = 20_000
#: Added to each bucket's count, in shares of the mean count.
SMOOTHING = 0.05
#: Mean log ratio per n-gram from which a document is kept.
THRESHOLD = -0.09

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"


def word_list(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def base_columns(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts of the base rules, and the words.

    A null or empty text has no words and zero counts. Each array is used more
    than once by the step after it, so Spark keeps it computed and does not
    inline it into the lambdas.
    """
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    texts = docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    counted = texts.select(
        *carry, "doc_id",
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.col("t").contains("\n"), lines).alias("lines"),
        word_list(F.col("t")).alias("w"),
    )
    triple = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    rules = [*carry, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    windows = counted.select(
        *carry, "doc_id", "n_symbols", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.slice(triple, F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))).alias("win"),
    )
    found = F.when(F.size(F.array_distinct("win")) < F.size("win"), _sorted_windows(F.col("win")))
    places = windows.select(*rules, "w", found.alias("win")).select(*rules, "w", _repeated_places(F.col("win")).alias("places"))
    return places.select(*rules, _covered(F.col("places")).alias("n_repeat_words"), "w")


def _sorted_windows(win: Column) -> Column:
    return F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))


def _repeated_places(s: Column) -> Column:
    """Places, in order, of the windows that equal a neighbour in the sorted list."""

    def place(z: Column, j: Column) -> Column:
        return F.when((z["x"] == F.get(s, j + 1)["x"]) | (z["x"] == F.get(s, j - 1)["x"]), z["i"])

    return F.sort_array(F.array_compact(F.transform(s, place)))


def _covered(places: Column) -> Column:
    """Words that windows of three words at these places cover; no list: none."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + F.least(x - acc["last"], F.lit(3))).alias("n"), x.alias("last"))

    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.coalesce(F.aggregate(places, start, step, lambda acc: acc["n"]), F.lit(0)).cast("long")


def _unigrams(words: Column, buckets: int) -> Column:
    return F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))


def _bigrams(words: Column, buckets: int) -> Column:
    """Buckets of the pairs of neighbouring words; the last place, without a neighbour, is cut."""
    pairs = F.transform(words, lambda x, i: F.pmod(F.xxhash64(x, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def trusted_ids(labels: DataFrame, limit: int = TARGET_DOCS) -> DataFrame:
    """At most ``limit`` ids of documents labelled good, smallest hash first: a bounded, repeatable sample."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio of target to corpus probability of each bucket.

    ``trusted`` holds the ids of the target's documents and must be bounded; it
    is broadcast. All documents count for the corpus. At most ``buckets`` rows
    come to the driver. An empty target or corpus gives ratios of zero.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    words = words.join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    words = words.select("good", word_list(F.col("t")).alias("w"))
    ones = _unigrams(F.col("w"), buckets)
    listed = words.select("good", "w", F.concat(ones, _bigrams(F.col("w"), buckets)).alias("grams"))
    # The outer form: the plain one adds a filter on the list that would compute it twice.
    grams = listed.select("good", F.explode_outer("grams").alias("b")).filter("b IS NOT NULL")
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("good")).collect()
    raw, good = [0] * buckets, [0] * buckets
    for row in rows:
        raw[row["b"]], good[row["b"]] = row["raw"], row["good"]
    if not sum(raw) or not sum(good):
        return [0.0] * buckets

    def logs(counts: list[int]) -> list[float]:
        add, total = smoothing * sum(counts) / buckets, sum(counts) * (1 + smoothing)
        return [math.log((c + add) / total) for c in counts]

    return [g - r for g, r in zip(logs(good), logs(raw), strict=True)]


def score(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts, score and verdict of every document.

    A text without words scores 0 and fails the base rules.
    """
    model = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to a literal
    base = base_columns(docs, carry)
    kept = [c for c in base.columns if c != "w"]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    grams = base.select(*kept, "w", _bigrams(F.col("w"), len(ratios)).alias("pairs"))
    ones = F.aggregate("w", F.lit(0.0), lambda acc, x: acc + F.get(model, F.pmod(F.xxhash64(x), F.lit(len(ratios))).cast("int")))
    total = F.aggregate("pairs", ones, lambda acc, b: acc + F.get(model, b))
    n_grams = F.size("w") + F.size("pairs")
    scored = grams.select(*kept, F.when(n_grams > 0, total / n_grams).otherwise(F.lit(0.0)).alias("score"))
    told = scored.select(*kept, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
    # A filter on the verdict cannot pass a generator; pushed below it would inline the lists into the lambdas.
    return told.select(F.inline_outer(F.array(F.struct(*told.columns))))


def kept_rows(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The verdict is computed beside the row, so nothing is joined or shuffled.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "doc_id", "text")
    return score(whole, ratios, threshold, carry=("row",)).filter("kept").select("row.*")


def quality_rules(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD,
    target_docs: int = TARGET_DOCS,
) -> DataFrame:
    """Score every row of ``docs`` against a target of documents labelled good.

    One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score. Columns other than doc_id and
    text are ignored. A null text counts as empty; repeated rows are scored
    alike; an empty table gives no rows; without labels every score is 0.
    """
    ratios = log_ratios(docs, trusted_ids(labels, target_docs), buckets, smoothing)
    return score(docs, ratios, threshold)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
