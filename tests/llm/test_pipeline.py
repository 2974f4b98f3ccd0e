"""The stages against plain versions of what they decide, on the small tables."""

import corpus_pipeline
from cohortlab.llm import decontaminate, line_dedup, order_minhash, quality_rules, stages
from tests.llm.conftest import SF


def test_stages_in_order(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    good = stages.keep_good(spark, small, SF).cache()
    kept = {r.doc_id for r in quality_rules.op1_quality_rules(spark, SF).filter("kept").collect()}
    assert good.columns == small.columns and {r.doc_id for r in good.collect()} == kept
    single = stages.drop_near_copies(spark, good, SF).cache()
    classes = order_minhash.near_duplicates(good).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.class_id for r in classes})
    cut = stages.cut_repeats(spark, single, SF).cache()
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(single).collect()}
    assert cut.columns == small.columns
    assert all(left[r.doc_id] == r.text and r.n_chars == len(r.text) for r in cut.collect())
    clean = stages.drop_leaks(spark, cut, SF).cache()
    leaks = {r.doc_id for r in decontaminate.find_items(cut, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - leaks
    ids = stages.tokenize(spark, clean, SF).collect()
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in clean.collect())
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in run) == sorted((r.doc_id, bytes(r.ids)) for r in ids)
