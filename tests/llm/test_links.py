"""Links and classes of near duplicates against all pairs."""

import random
from collections import Counter

import pytest

from cohortlab.llm import order_minhash
from tests.llm.conftest import prose
from tests.llm.test_dedup import distance


def brute(docs):
    """Class of each text, from all pairs, and the number of its links."""
    words = [d.lower().split() for d in docs]
    root, links = list(range(len(docs))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            most = 0.2 * max(len(words[i]), len(words[j])) + 1e-9
            if words[i] != words[j] and abs(len(words[i]) - len(words[j])) <= most and distance(words[i], words[j]) <= most:
                links.update((i, j))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (find(i), links[i]) for i in range(len(docs))}


def found(spark, docs):
    rows = order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    return {r.doc_id: r.class_id for r in rows}


@pytest.mark.parametrize("block", [4096, 7])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block):
    """A group whose texts are up to 22 % apart, pairs of copies between texts that share a passage with all."""
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    rand = random.Random(12)
    plain = lambda seed, n: prose(seed, n).lower().replace(".", "")
    base, passage = plain(1, 60).split(), plain(2, 25)
    docs = [f"{plain(100 + i, 30)} {passage}" for i in range(12)]
    docs += [docs[i] + " tail" for i in range(3, 9)]
    for share in [0.04, 0.08, 0.11, 0.14, 0.17] * 6:
        docs.append(" ".join(w if rand.random() > share else f"n{rand.randrange(10**9)}" for w in base))
    docs += [f"{plain(200 + i, 30)} {passage}" for i in range(4)]
    want = brute(docs)
    assert len({n for _, n in want.values()}) > 5
    assert found(spark, docs) == {i: c for i, (c, _) in want.items()}


def test_pairs_near_the_limit_are_found(spark):
    """Pairs of similarity 0.8 to 0.85; replaced words at random places or evenly spread."""
    rand, docs = random.Random(21), []
    for n in (20, 40, 80, 200):
        for i in range(16):
            words = prose(1000 * n + i, n).lower().replace(".", "").split()
            edits = n // 5 if i % 4 < 3 else int(n * 0.15)
            at = range(2, n, 5) if i % 2 else rand.sample(range(n), edits)
            other = [f"n{rand.randrange(10**9)}" if k in list(at)[:edits] else w for k, w in enumerate(words)]
            docs += [" ".join(words), " ".join(other)]
    rows = found(spark, docs)
    assert rows == {i: i - i % 2 for i in range(len(docs))}


@pytest.mark.parametrize("size", [400, 1200])
def test_pairs_grow_with_the_group_not_its_square(spark, size):
    """Close texts, and texts that share only a passage: rows of every table of pairs stay below twice the texts."""
    rand, base, passage = random.Random(size), prose(1, 60).lower().split(), prose(2, 20).lower()
    docs = [" ".join(w if rand.random() > 0.08 else f"n{rand.randrange(10**9)}" for w in base) for _ in range(size // 2)]
    docs += [f"{prose(1000 + i, 40).lower()} {passage}" for i in range(size // 2)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    members = order_minhash.sketched(table).withColumnRenamed("doc", "rep")
    met = order_minhash.stage(order_minhash.buckets(members), "test-met")
    pairs = order_minhash.stage(order_minhash.likely(order_minhash.candidates(met), members), "test-pairs")
    assert met.count() < order_minhash.SKETCHES * size and pairs.count() < 6 * size
    labels = order_minhash.components(order_minhash.links(table, order_minhash.nearest(pairs)))
    rest = order_minhash.stage(order_minhash.apart(pairs, labels), "test-rest")
    labels = order_minhash.extended(table, labels, rest, 0.8)
    crossed = order_minhash.crossings(met, labels, members)
    assert order_minhash.nearest(pairs).count() + rest.count() + crossed.count() < 2 * size
    classes = {r.node: r["class"] for r in labels.collect()}
    assert Counter(classes.get(i) for i in range(size // 2)).most_common(1)[0][1] > 0.95 * size / 2


def test_leaders_inside_batches_lose_no_link(spark):
    """One batch or one row per batch: the same classes."""
    rand, docs = random.Random(4), []
    for i in range(40):
        words = prose(i % 8, 50).lower().replace(".", "").split()
        docs.append(" ".join(w if rand.random() > 0.06 else f"n{rand.randrange(10**9)}" for w in words))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = []
    for rows in ("10000", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        seen.append(found(spark, docs))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen[0] == seen[1] == {i: c for i, (c, _) in brute(docs).items()}
