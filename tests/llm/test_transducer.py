import hashlib
import random

import pytest
import public_tokenizers
import regex
import tiktoken

from cohortlab.llm import transducer
from tests.llm.conftest import SF, prose

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = transducer.read_ranks(PATH)
CUT = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def pieces(text):
    return map(str.encode, CUT.findall(text))


def odd_texts():
    rand = random.Random(5)
    parts = ["a", "b", " ", "  ", "é", "日本", "12", "!", "'s", "ing", "the", "zq", "\n", "\U0001f600", "xX", "　"]
    texts = ["".join(rand.choice(parts) for _ in range(rand.randint(0, 300))) for _ in range(60)]
    texts += ["".join(rand.choice(letters) for _ in range(4000)) for letters in ("ab", "abcde", "0123", " \t", "日本語")]
    return [*texts, "a" * 20_000, "ab" * 5000, " " * 3000, "=" * 5000, "", prose(1, 500)]


def test_encodes_as_the_library(library):
    machine = transducer.Transducer(RANKS)
    for text in odd_texts():
        assert machine.encode(pieces(text)) == library.encode_ordinary(text)


def test_forgetting_states_changes_nothing(library):
    machine = transducer.Transducer(RANKS, limit=20)
    for text in odd_texts()[:20]:
        assert machine.encode(pieces(text)) == library.encode_ordinary(text)
    assert len(machine.states) <= 20


def test_neighbours_that_merge(library):
    merges, rand = transducer.Merges(RANKS), random.Random(2)
    ids = list(RANKS.values())
    for _ in range(3000):
        a, b = rand.choice(ids), rand.choice(ids)
        one, two = merges.tokens[a], merges.tokens[b]
        assert merges.apart(a, b) == (merges.merged(one + two)[0] == [one, two])


def test_tokens_that_no_merges_make():
    base = {bytes([i]): i for i in range(256)}
    ranks = {**base, b"abc": 256, b"bc": 300, b"abcd": 400, b"xyz": 500}  # xyz and abcd cannot be reached from pairs in order
    library = tiktoken.Encoding("odd", pat_str=r"[a-z]+|[^a-z]+", mergeable_ranks=ranks, special_tokens={})
    machine, cut = transducer.Transducer(ranks), regex.compile(r"[a-z]+|[^a-z]+")
    rand = random.Random(4)
    for text in ["xyz", "axyz", "abc", "abcd", "abcabcd", *("".join(rand.choice("abcdxyz ") for _ in range(12)) for _ in range(500))]:
        assert machine.encode(map(str.encode, cut.findall(text))) == library.encode_ordinary(text)


def test_long_pieces_settle_early():
    machine = transducer.Transducer(RANKS)
    rand, state, states = random.Random(1), machine.start, []
    for i, byte in enumerate(bytes(rand.choice(b"abcde") for _ in range(3000))):
        state = state[byte]
        states.append(state)
        if i % 100 == 99:
            assert len(states) - machine.settled(states) < 60


def test_decodes_any_ids_as_utf8():
    decoder, rand = transducer.Utf8({i: t for t, i in RANKS.items()}), random.Random(3)
    ids = list(RANKS.values())
    for _ in range(3000):
        some = [rand.choice(ids) if rand.random() < 0.5 else rand.randrange(256) for _ in range(rand.randint(0, 9))]
        assert decoder.decode(some) == b"".join(decoder.tokens[i] for i in some).decode("utf-8", "replace")


def test_op11_equals_the_library(spark, library):
    got = {r.doc_id: r for r in transducer.op11_transducer_bpe(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        row = got[r.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_messy_and_empty_tables(spark, messy, nothing, library):
    run = lambda d: transducer.encode(d, PATH, public_tokenizers.PATTERN, keep=("doc_id", "ids_")).collect()
    rows = run(messy.withColumn("ids_", messy["text"]))
    assert len(rows) == messy.count()
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(r.ids_ or "") and r.decoded == (r.ids_ or "") and r.n_tokens == len(r.ids)
    assert run(nothing.withColumn("ids_", nothing["text"])) == []
