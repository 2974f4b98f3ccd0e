import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from cohortlab.llm import line_dedup, order_minhash, suffix_dedup
from tests.llm.conftest import SF, prose


def removed(docs, length=100):
    """Bytes covered by a window that also starts earlier, by brute force."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        data = (text or "").encode()
        mask = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                mask[i : i + length] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[d] = len(data), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()
    return out


def repeats():
    """Copies, shared passages at odd places, periodic texts, a common line in many contexts."""
    rand = random.Random(4)
    passage, line = prose(70, 40), prose(71, 12)
    docs = [prose(i, rand.randint(5, 200)) for i in range(40)]
    docs += [docs[3], docs[3], docs[5][7:], "ab" * 300, "ab" * 200 + "c", "z" * 400, "é" * 250]
    docs += [prose(100 + i, 30) + passage[i : 200 + i] + prose(200 + i, 20) for i in range(20)]
    docs += [prose(300 + i, 20) + " " + line + " " + prose(400 + i, 20) for i in range(120)]
    return list(enumerate(docs))


@pytest.mark.parametrize("hot_least", [256, 16])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, hot_least):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", hot_least)
    docs = repeats()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = suffix_dedup.dedup_windows(table).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert got == removed(docs)


def test_suffix_dedup_on_documents(spark, small):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op4_suffix_dedup(spark, SF).collect()}
    assert got == removed([(r.doc_id, r.text) for r in small.collect()])


def test_suffix_orders():
    """Every column's order and common prefixes, for strings that begin and end in different columns."""
    rand = random.Random(5)
    for _ in range(30):
        strings = [bytes(rand.choice(b"ab\x00") for _ in range(rand.randint(1, 30))) for _ in range(rand.randint(1, 12))]
        anchors = np.array([rand.randrange(len(s)) for s in strings])
        symbols, middle = suffix_dedup.columns_of(strings, anchors)
        real = [s.replace(b"\x00", b"\xf8") for s in strings]
        for column, order, common in suffix_dedup.suffix_orders(symbols):
            offsets = column - middle + anchors
            want = sorted(real[i][offsets[i] :] for i in range(len(strings)) if offsets[i] >= 0)
            got = [real[i][offsets[i] :] for i in order]
            assert got == want

            def shared(x, y):
                return next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))

            assert common.tolist() == [0, *(shared(x, y) for x, y in zip(got, got[1:], strict=False))][: len(got)]


def test_line_dedup_is_brute_force(spark, small):
    first, want = {}, {}
    for r in sorted(small.collect(), key=lambda r: r.doc_id):
        mask = bytearray(len(r.text))
        for a, b, said in sorted(line_dedup.units(r.text)):
            if first.setdefault(said, (r.doc_id, a)) != (r.doc_id, a):
                mask[a:b] = b"\1" * (b - a)
        want[r.doc_id] = "".join(c for c, gone in zip(r.text, mask, strict=True) if not gone)
    got = line_dedup.dedup_lines(small.repartition(7)).collect()
    texts = {r.doc_id: r.text for r in small.collect()}
    assert {r.doc_id: r.text for r in got} == want
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans) == len(texts[r.doc_id]) - len(r.text)


def test_line_dedup_cuts_a_passage_inside_a_line(spark):
    passage = prose(9, 60)
    docs = [(i, f"{prose(50 + i, 30).lower()} {passage} {prose(80 + i, 30).lower()}") for i in range(4)]
    left = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert left[0].n_removed == 0 and all(left[i].n_removed > 0.8 * len(passage) for i in (1, 2, 3))
    assert all(prose(50 + i, 30).lower().split(".")[0] in left[i].text for i in range(4))


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_alignment():
    rand = random.Random(2)
    for _ in range(1000):
        x = [rand.randint(0, 3) for _ in range(rand.randint(0, 14))]
        y = [rand.randint(0, 3) if rand.random() < 0.2 else w for w in x if rand.random() < 0.9]
        allowed, real = rand.randint(0, 8), distance(x, y)
        assert order_minhash.aligned_within(x, y, allowed) == (real if real <= allowed else None)


def test_near_duplicates_are_brute_force(spark):
    """Classes are the components of all pairs of 0.8 or more; groups of many copies included."""
    rand = random.Random(8)
    base = [prose(i, rand.randint(30, 90)).lower().replace(".", "") for i in range(25)]
    docs = list(base)
    for i in range(10):
        for share in (0.01, 0.03, 0.06):
            docs.append(" ".join(w if rand.random() > share else "zz" for w in base[i].split()))
    docs += [base[11].upper() + "!", base[11], base[12] + " tail"]
    docs += [" ".join(w if rand.random() > 0.02 else str(k) for w in base[13].split()) for k in range(60)]
    words = [d.lower().replace("!", "").split() for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if abs(len(words[i]) - len(words[j])) < 20 and distance(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])) + 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: find(i) for i in range(len(docs))}


def test_components(spark):
    """Paths, stars, cliques and single edges in shuffled numbers."""
    rand = random.Random(3)
    names = rand.sample(range(10_000), 400)
    edges = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[i]) for i in range(101, 200)]
    edges += [(names[i], names[j]) for i in range(200, 212) for j in range(200, i)] + [(names[i], names[i + 1]) for i in range(300, 400, 2)]
    groups = [names[:100], names[100:200], names[200:212], *[names[i : i + 2] for i in range(300, 400, 2)]]
    table = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    assert {r.node: r["class"] for r in order_minhash.components(table).collect()} == {n: min(g) for g in groups for n in g}
    assert order_minhash.components(table.filter("false")).collect() == []
