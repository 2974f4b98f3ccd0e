"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of documents.

All of them: a null text is an empty one, columns beside doc_id and text pass
unchanged whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import bpe, decontaminate, line_dedup, order_minhash, quality_rules
from cohortlab.llm.common import table


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars follows the text."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject.

    Texts of fewer than 50 words go, so null and empty ones do. Rows with equal
    texts share their fate. Without good labels every ratio is 0 and only the base rules drop.
    """
    ratios = quality_rules.log_ratios(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    return quality_rules.kept_rows(docs, ratios)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near-duplicates.

    Texts without words are like no other and stay. Rows with one doc_id are
    one document and stay or go together; a null doc_id ranks first.
    """
    return order_minhash.first_rows(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines and passages out of the texts; n_chars follows.

    The earliest document keeps a passage, a null doc_id before all. Documents of
    which only blanks are left after a cut go; null and empty texts, from which nothing is cut, stay.
    """
    return _same_columns(line_dedup.dedup_rows(docs), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a benchmark item occurs, within the error budget.

    Items without text or id count for nothing; null and empty texts hold no item and stay.
    """
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the id, language and source of every document; the text can be decoded from them.

    One row per row, repeated ones too. A null or empty text has no tokens.
    """
    return bpe.encode(docs, *bpe.public_vocabulary(), keep=("doc_id", "lang", "source")).select(
        "doc_id", "lang", "source", "n_tokens", "ids"
    )
