import re
from collections import Counter

import pytest
import xxhash

from cohortlab.llm import factorisation, quality_rules
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def grams(text, buckets):
    words = [w.encode() for w in WORD.findall(text)]
    ones = [xxhash.xxh64_intdigest(w, 42) for w in words]
    twos = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(words, words[1:], strict=False)]
    return [x % buckets if x < 2**63 else (x - 2**64) % buckets for x in ones + twos]


def test_base_counts_and_scores(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    buckets = 512
    ratios = quality_rules.log_ratios(small, quality_rules.trusted_ids(labels), buckets)
    found = {r.doc_id: r for r in quality_rules.score(small, ratios).collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = Counter(), Counter()
    for r in small.collect():
        raw.update(grams(r.text, buckets))
        if r.doc_id in good:
            target.update(grams(r.text, buckets))

    def share(counts, b):
        total = sum(counts.values())
        return (counts[b] + quality_rules.SMOOTHING * total / buckets) / (total * (1 + quality_rules.SMOOTHING))

    for b in range(buckets):
        assert ratios[b] == pytest.approx(__import__("math").log(share(target, b) / share(raw, b)))
    for r in small.collect():
        got, counts = found[r.doc_id], rules(r.text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == counts
        assert got.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        mine = grams(r.text, buckets)
        assert got.score == pytest.approx(sum(ratios[b] for b in mine) / max(len(mine), 1), abs=1e-9)
        assert got.kept == (not got.base_failed and got.score >= quality_rules.THRESHOLD)


def test_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_rules.op1_quality_rules(spark, sf).filter("NOT base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in found) / len(found) > 0.97


def test_kept_rows_are_the_kept(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ratios = quality_rules.log_ratios(small, quality_rules.trusted_ids(labels))
    kept = {r.doc_id for r in quality_rules.score(small, ratios).filter("kept").collect()}
    assert {r.doc_id for r in quality_rules.kept_rows(small, ratios).collect()} == kept


def test_machine_is_the_pairwise_sum():
    import numpy as np

    model = factorisation.blank()
    place, value, off = np.array([3, 40, 900, 5]), np.array([0.5, -1.0, 2.0, 1.5], np.float32), np.array([0, 3, 4])
    margins, _ = model.margins(place, value, off)
    pairs = sum(
        float(model.factors[place[i]] @ model.factors[place[j]]) * value[i] * value[j] for i in range(3) for j in range(i + 1, 3)
    )
    assert margins[0] == pytest.approx(pairs, abs=1e-5) and margins[1] == pytest.approx(0, abs=1e-6)


def test_machine_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = factorisation.op10_quality_classifier(spark, sf)
    found = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) / len(found) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
