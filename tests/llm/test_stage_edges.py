"""The pipeline's stages, and the search for benchmark items, over messy and empty tables."""

import pytest

from cohortlab.llm import bpe, decontaminate, stages
from tests.llm.conftest import SF

STAGES = (stages.keep_good, stages.drop_near_copies, stages.cut_repeats, stages.drop_leaks)


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.__name__)
def test_stage_over_messy_and_empty_tables(spark, messy, nothing, stage):
    kept = stage(spark, messy, SF)
    assert kept.columns == messy.columns
    before = [(r.doc_id, r.text) for r in messy.collect()]
    after = [(r.doc_id, r.text) for r in kept.collect()]
    if stage is stages.cut_repeats:
        ids = [i for i, _ in after]
        assert set(ids) <= {i for i, _ in before} and dict(after)[1] == dict(before)[1]
        assert not any((t or "").strip() for i, t in after if i == 6)  # 6 repeats document 1
    else:
        assert all(row in before for row in after)
    if stage is stages.drop_near_copies:
        ids = [i for i, _ in after]
        assert 1 in ids and 6 not in ids and {2, 3, 4, 5, 7, None} <= set(ids)  # texts without words are like no other
    if stage is stages.keep_good:
        assert not {2, 3, 4, 7} & {i for i, _ in after}  # fewer than 50 words
    if stage is stages.drop_leaks:
        assert len(after) == len(before)
    assert stage(spark, nothing, SF).collect() == []


def test_tokens_decode_to_the_texts(spark, messy, nothing):
    codec = bpe.codec(*bpe.public_vocabulary(), tuple(bpe.SPECIAL.items()))
    import numpy as np

    rows = stages.tokenize(spark, messy, SF).collect()
    want = sorted((str(r.doc_id), r.text or "") for r in messy.collect())
    assert sorted((str(r.doc_id), codec.decode(np.frombuffer(r.ids, "<u4"))) for r in rows) == want
    assert stages.tokenize(spark, nothing, SF).collect() == []


def test_items_in_messy_and_empty_tables(spark, messy, nothing):
    items = spark.createDataFrame([(1, "one two one two one two"), (2, None), (3, ""), (None, "x"), (1, "one two one two one two")], "item_id long, text string")
    rows = decontaminate.find_items(messy, items).collect()
    text = {r.doc_id: r.text for r in messy.collect()}
    assert {(r.doc_id, r.item_id) for r in rows} == {(11, 1)}
    spans = sorted((r.start, r.end) for r in rows)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and any(text[11][a:b] == "one two one two one two" for a, b in spans)
    assert decontaminate.find_items(nothing, items).collect() == []
    assert decontaminate.find_items(messy, items.filter("false")).collect() == []
