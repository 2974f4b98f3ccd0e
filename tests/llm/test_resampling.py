import hashlib
import math
import re
import zlib

import pyarrow as pa

from cohortlab.llm import resampling
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feats(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target):
    crc = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in feats(text)[1]:
                counts[crc(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10_000) / ((a + 1) * (T + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, (doc, text) in enumerate(docs):
        n, found = feats(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc(f)] for f in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, i])
    able = [r for r in rows if r[5] >= 20]
    best = sorted(able, key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(best[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_op13_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in resampling.op13_importance_resampling(spark, SF).collect()), key=str)
    assert got == brute(docs, target)
    assert sum(r[4] is not None for r in got) >= 5


def test_messy_and_empty_tables(spark, messy, nothing):
    target = spark.createDataFrame([("one Two three",), (None,), ("",), ("é 日本 x9",)], "text string")
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    got = sorted((tuple(r) for r in resampling.resample(messy, target).collect()), key=str)
    assert got == brute(docs, [r.text for r in target.collect()])
    assert resampling.resample(nothing, target).collect() == []
    assert len(resampling.resample(messy, target.filter("false")).collect()) == len(docs)


def test_ties_go_to_the_smaller_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i % 50, text) for i in range(100)], "doc_id long, text string")  # every id twice
    got = {(r.doc_id, r["rank"]) for r in resampling.resample(docs, docs.select("text")).collect() if r["rank"]}
    assert len(got) == 5 and sorted(r for _, r in got) == [1, 2, 3, 4, 5]
    assert all(abs(a[1] - b[1]) == 1 for a in got for b in got if a != b and a[0] == b[0])


def test_slices_of_a_batch_give_the_words_of_their_rows():
    said = ["x Y", None, "A b c", "", "é 日Z9 d\x00E"] * 3
    column = pa.array(said)
    for kind in (pa.string(), pa.large_string()):
        for first in range(len(said)):
            for n in (1, 4, len(said) - first):
                rows = said[first : first + n]
                bucket, of, words = resampling.features(column.cast(kind).slice(first, n))
                want = [feats(x) for x in rows]
                assert words.tolist() == [w for w, _ in want]
                assert [sorted(bucket[of == i].tolist()) for i in range(len(rows))] == [sorted(zlib.crc32(f.encode()) % 10_000 for f in found) for _, found in want]


def test_batches_over_a_slice_equal_brute_force(spark, monkeypatch):
    docs = [(i, f"Word{i % 7} and MORE of {i % 13} " * (i % 11)) for i in range(400)]
    cut = resampling.slices
    monkeypatch.setattr(resampling, "slices", lambda batches, column: cut(batches, column, 2000))
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = sorted((tuple(r) for r in resampling.resample(table, table.select("text")).collect()), key=str)
    assert got == brute(docs, [x for _, x in docs])
