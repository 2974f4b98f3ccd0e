import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from cohortlab.llm import manifest
from cohortlab.llm.oracle import ORACLE
from tests.llm.conftest import SF


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def tree(leaves):
    """The root, and per leaf the list of (place, run) of each level."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            ways[i].append((a % 8, level[a // 8 * 8 : a // 8 * 8 + 8]))
            at[i] = a // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], ways


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    root, above = tree([built[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above, strict=True):
        for (_, _, digest, r), way in zip(sorted(groups[g], key=lambda x: x[:3]), built[g][1], strict=True):
            seen = digest
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                seen = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            proof = ""
            for place, run in way + up:
                proof += "".join(run[:place] + run[place + 1 :])
                seen = sha("".join(run[:place] + [seen] + run[place + 1 :]))
            out.append((r["doc_id"], digest, built[g][0], root, sha(proof), seen, seen == root))
    return sorted(out, key=str)


def op12(spark, docs, folder):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in manifest.op12_merkle_manifest(spark, str(folder)).collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("block", [512, 8])
def test_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(manifest, "BLOCK", block)
    monkeypatch.setattr(manifest, "LEVELS", 3 if block == 512 else 1)
    rand = random.Random(block)
    sizes = {"en": 700, "de": 65, None: 9, "": 8, "ü": 1, "z": 64, **{f"x{i}": 1 for i in range(7)}}
    rows, n = [], 0
    for lang, count in sizes.items():
        for _ in range(count):
            n += 1
            text = rand.choice([None, "", "Ab ÄB", "same", f"Text {n} É"])
            rows.append((n, rand.choice(["s", None, ""]), lang, rand.choice([None, n]), text))
    rows += [rows[3], rows[3], (None, None, "en", None, None), (None, "a", "en", 1, "B"), (7, "q", "en", 1, "B")]
    rand.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows])
    got = op12(spark, docs.repartition(5).withColumn("tree", docs["n_chars"]).withColumn("idx", docs["lang"]), tmp_path)
    assert got == want
    assert {r[-1] for r in got} == {True, False}


def test_given_table_equals_brute_force_and_sql(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    assert sorted((tuple(r) for r in manifest.op12_merkle_manifest(spark, SF).collect()), key=str) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.sql(ORACLE["op12_merkle_manifest"]).fetchall(), key=str) == want


def test_witness_of_any_size():
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 511, 512):
        leaves = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(n)]
        part = manifest.Subtree(manifest.depth(n))
        for x in leaves:
            part.append(x)
        root = part.close()
        assert root.hex() == tree([x.hex() for x in leaves])[0]
        assert all(manifest.fold(x, bytes(w)) == root for x, w in zip(leaves, part.witness, strict=True))
        assert n == 1 or manifest.fold(leaves[0], bytes(part.witness[1])) != root


def test_one_row_and_none(spark, nothing, tmp_path):
    one = spark.createDataFrame([(5, None, None, None, None)], SCHEMA)
    row = op12(spark, one, tmp_path)[0]
    assert row[1] == row[2] == row[3] == row[5] and row[4] == sha("") and row[6]
    assert op12(spark, nothing, tmp_path) == []
