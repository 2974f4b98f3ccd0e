"""Every operator over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

from cohortlab.llm import (
    bpe,
    chat,
    decontaminate,
    factorisation,
    interpolated_lm,
    licenses,
    line_dedup,
    order_minhash,
    quality_rules,
    suffix_dedup,
)

ROWS = 13


def items(spark):
    return spark.createDataFrame([(1, "one two one two one two"), (2, None), (3, ""), (None, "x")], "item_id long, text string")


RUNS = {
    "quality": (lambda s, d, l: quality_rules.quality_rules(d, l, buckets=256), ROWS),
    "licenses": (lambda s, d, l: licenses.scan_licenses(d), 0),
    "suffix": (lambda s, d, l: suffix_dedup.dedup_windows(d), ROWS),
    "bpe": (lambda s, d, l: bpe.digests(d, *bpe.public_vocabulary()), ROWS),
    "bpe_ids": (lambda s, d, l: bpe.encode(d, *bpe.public_vocabulary(), keep=("doc_id",)), ROWS),
    "minhash": (lambda s, d, l: order_minhash.near_duplicates(d), ROWS - 1),  # one row per document
    "minhash_rows": (lambda s, d, l: order_minhash.first_rows(d), ROWS - 2),  # 6 is a copy of 1, read twice
    "lm": (lambda s, d, l: interpolated_lm.score_documents(d), ROWS),
    "lines": (lambda s, d, l: line_dedup.dedup_lines(d), ROWS),
    "lines_rows": (lambda s, d, l: line_dedup.dedup_rows(d), None),
    "items_rows": (lambda s, d, l: decontaminate.clean_rows(d, items(s)), ROWS - 1),
    "machine": (lambda s, d, l: factorisation.classify(d, factorisation.train(d, l)), ROWS),
}


@pytest.mark.parametrize("name", RUNS)
def test_messy_rows(spark, messy, some_labels, name):
    run, n = RUNS[name]
    rows = run(spark, messy, some_labels).collect()
    assert n is None or len(rows) == n


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, nothing, some_labels, name):
    assert RUNS[name][0](spark, nothing, some_labels.filter("false")).collect() == []


def test_rows_keep_their_columns(spark, messy, some_labels):
    for name in ("minhash_rows", "lines_rows", "items_rows"):
        assert RUNS[name][0](spark, messy, some_labels).columns == messy.columns
    kept = quality_rules.kept_rows(messy, quality_rules.log_ratios(messy, quality_rules.trusted_ids(some_labels), 256))
    assert kept.columns == messy.columns


def test_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.expand(none)).collect() == []
