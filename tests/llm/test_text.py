import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortlab.llm import bpe, chat, decontaminate, interpolated_lm, licenses
from tests.llm.conftest import SF, prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_reads_back(spark):
    got = {r.conv_id: r for r in chat.op3_chat_formatting(spark, SF).collect()}
    said = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        said[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    said[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(said)
    for conv, turns in said.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))


def test_chat_escapes_and_expands(spark):
    turns = {
        1: [("us\ner", "a\\<|x|> \\\\ </s>"), ("assistant", "<\\|end|>\n<|end|>\n"), ("", ""), ("assistant", "b")],
        2: [("user", "only")], 3: [("assistant", "")], None: [("<|turn|>", "<\\n>\\n")],
    }
    rows = [(c, i, r or None, t or None) for c, said in turns.items() for i, (r, t) in enumerate(said)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("context", chat.F.lit(1))
    examples = chat.expand(table)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv, said in turns.items():
        assert back[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in said))
    one = examples.filter("conv_id = 1").orderBy("example").collect()
    assert [r.trainable for r in one] == [True, True] and one[1].context.startswith(one[0].context + one[0].target)


def test_bpe_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rand = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "'", "12", "!", "日本", "　", "\t", "x y", "the and ", "<|endof", "text|>"]
    texts = ["".join(rand.choice(parts) for _ in range(rand.randint(0, 2000))) for _ in range(60)]
    texts += [prose(i, 300) for i in range(20)] + [prose(1, 300)] * 3 + ["", None, "a" * 4000, " " * 3000]
    before = bpe.CUT_BITS
    try:
        for bits in (9, 5):
            bpe.CUT_BITS = bits
            encoder = bpe.Encoder(bpe.codec(*bpe.public_vocabulary(), tuple(bpe.SPECIAL.items())))
            got = [ids for ids, _ in bpe.encoded(pa.array(texts, pa.string()), encoder)]
            for ids, text in zip(got, texts, strict=True):
                want = whole.encode(text or "", add_special_tokens=False).ids
                assert ids.tolist() == want
                assert encoder.codec.decode(ids) == whole.decode(want, skip_special_tokens=False)
            assert encoder.encoded < encoder.chunks and encoder.repairs > 0
    finally:
        bpe.CUT_BITS = before


def test_bpe_query(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.op5_bpe(spark, SF).collect()}
    for r in small.collect():
        ids = whole.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == sha(r.text)


def test_base_scores_and_gain(spark, small):
    docs = [(r.doc_id, r.text or "") for r in small.collect()]

    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) + ["\0end"]

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    counts = Counter(w for d, t in docs if not held[d] for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in interpolated_lm.op7_interpolated_lm(spark, SF).collect()}
    for d, t in docs:
        said, row = tokens(t), got[d]
        want = (held[d], len(said), sum(counts[w] > 0 for w in said), total)
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == want
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in said))
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_interpolated_scores_are_brute_force(spark):
    """Counts by hand, weights by the same expectation-maximisation over unrounded counts."""
    docs = [(i, prose(i % 5, 12).lower()) for i in range(60)]
    got = {r.doc_id: r for r in interpolated_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    fold = {d: zlib.crc32(str(d).encode()) % 7 for d, _ in docs}
    ones, twos, starts = Counter(), Counter(), 0
    pairs = {d: list(zip(["\0s", *t.split()], [*t.split(), "\0e"], strict=True)) for d, t in docs}
    kept1, kept2 = Counter(), Counter()
    for d, said in pairs.items():
        if fold[d] != 2:
            starts += 1
            ones.update(w for _, w in said)
            twos.update(said)
            if fold[d] != 3:
                kept1.update([w for _, w in said] + ["\0s"])
                kept2.update(said)
    total, uniform = sum(ones.values()), 1 / (len(ones) + 1)
    ones["\0s"] = starts
    kept_total = sum(kept1.values()) - kept1["\0s"]
    events = Counter()
    for d, said in pairs.items():
        if fold[d] == 3:
            for v, w in said:
                p = (kept1[w] / kept_total, kept2[v, w] / max(kept1[v], 1))
                q = [int(x) for x in interpolated_lm.steps(np.array(p))]
                events[int(interpolated_lm.bucket(np.array([kept1[v]]))[0]), *q] += 1
    columns = np.array([(*k, n) for k, n in events.items()], np.int64).reshape(-1, 4).T
    weights = interpolated_lm.learn_weights(*columns, uniform)
    for d, said in pairs.items():
        want = 0.0
        for v, w in said:
            a, b, c = weights[int(interpolated_lm.bucket(np.array([ones[v]]))[0])]
            want += math.log10(a * uniform + b * ones[w] / total + c * twos[v, w] / max(ones[v], 1))
        assert got[d].score == pytest.approx(want)


def test_myers_and_pieces():
    rand = random.Random(1)

    def ends(pattern, text):
        row, out = list(range(len(pattern) + 1)), []
        for c in text:
            new = [0]
            for i in range(1, len(pattern) + 1):
                new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (pattern[i - 1] != c)))
            out.append(new[-1])
            row = new
        return out

    for _ in range(100):
        pattern = bytes(rand.choice(b"abc") for _ in range(rand.randint(1, 40)))
        text = bytes(rand.choice(b"abc") for _ in range(rand.randint(0, 120)))
        assert decontaminate.myers(pattern, text) == ends(pattern, text)
    assert b"".join(p for _, p in decontaminate.pieces(b"abcdefghij", 3)) == b"abcdefghij"


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_edited_items_are_found(spark, block_bytes):
    """Items with as many random edits as the budget allows, in every position; clean texts have none."""
    rand = random.Random(6)
    items = [(i, prose(500 + i, 25)) for i in range(8)]
    docs, want = [], set()
    for d in range(60):
        text = prose(d, 60)
        if d % 3 == 0:
            i, item = rand.choice(items)
            said = list(item.swapcase() if d % 2 else item)
            for _ in range(int(len(item.encode()) * decontaminate.ERROR_RATE) // 2):
                at = rand.randrange(len(said))
                said[at : at + 1] = rand.choice([[], ["q"], [said[at], "w"]])
            at = rand.choice([0, text.index(" "), len(text)])
            text = text[:at] + "".join(said) + text[at:]
            want.add((d, i))
        docs.append((d, text))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_items(table, bench, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    clean = {r.doc_id for r in decontaminate.clean_rows(table, bench, block_bytes=block_bytes).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_items_in_documents(spark, small):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    flat = lambda t: decontaminate.folded(np.frombuffer(t.encode(), np.uint8)).tobytes()
    exact = {(r.doc_id, i.item_id) for r in small.collect() for i in items if flat(i.text) in flat(r.text)}
    found = decontaminate.op9_decontamination(spark, SF).collect()
    assert exact and exact <= {(r.doc_id, r.item_id) for r in found}
    texts = {r.doc_id: r.text for r in small.collect()}
    by_id = {i.item_id: i.text for i in items}
    for r in found:
        if r.distance == 0:
            assert flat(texts[r.doc_id][r.start : r.end]) == flat(by_id[r.item_id])


def test_licenses(spark, small):
    notices = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    want = sorted((r.doc_id, name) for r in small.collect() for text, name in notices.items() for _ in range(r.text.count(text)))
    assert sorted((r.doc_id, r.license) for r in licenses.op2_license_scan(spark, SF).collect()) == want


def test_license_wording():
    scanner = licenses.Scanner(licenses.TEMPLATES)

    def names(text):
        return [(x[0], len(x[4])) for x in scanner.scan(text)]

    assert names("Some text here.\nlicensed under cc by-sa 4.0\nmore") == [("CC-BY-SA-4.0", 0)]
    assert names("This work is licensed under a GNU General Public License, version 2.") == [("GPL-2.0", 2)]
    assert names("A license to fish was given to the man. Permission was denied.") == []
    assert names("Licensed under the Apache License, Version 1.1.") == []
    long = licenses.TEMPLATES[2][1].replace("Software", "Program", 1)
    assert [n for n, _ in names(f"Intro.\n{long}\nOutro.")] == ["MIT"]
