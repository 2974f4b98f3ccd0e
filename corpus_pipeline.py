"""The corpus pipeline: stages over the documents table, each written and read again."""

from __future__ import annotations

import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortlab.llm import stages  # noqa: E402
from cohortlab.session import shared_dir  # noqa: E402

STAGES = [
    ("quality_rules", stages.keep_good),
    ("near_dedup", stages.drop_near_copies),
    ("substring_dedup", stages.cut_repeats),
    ("decontamination", stages.drop_leaks),
    ("bpe", stages.tokenize),
]

#: Sketches, suffix order and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read by the next.

    Null texts and texts of fewer than 50 words end at the first stage; an empty
    table gives an empty result with the columns of the last. Rows that share a
    doc_id are one document to the stages that compare documents.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/staged/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
