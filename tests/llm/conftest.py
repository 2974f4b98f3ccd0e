"""Tables that every text operator must survive."""

import random

import pytest

SF = "/root/testdata/sf0.001"


def prose(seed: int, words: int) -> str:
    rand = random.Random(seed)
    said = ["".join(rand.choice(["an", "ti", "or", "el", "mé", "su", "ka"]) for _ in range(rand.randint(1, 4))) for _ in range(words)]
    for i in range(0, words, 9):
        said[i] = said[i].capitalize()
        if i:
            said[i - 1] += "."
    return " ".join(said)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty, blank and long texts, repeated rows, and columns named as the operators' own."""
    long_text = prose(1, 30_000)
    rows = [
        (1, prose(2, 120)), (2, None), (3, ""), (4, " \n\t "), (5, long_text), (None, prose(3, 80)), (6, prose(2, 120)), (6, prose(2, 120)),
        (7, "a"), (8, "\x00nul " * 60), (9, "x" * 5000), (10, "日本語 テスト " * 40), (11, "one two " * 200),
    ]
    names = ["row", "doc", "start", "end", "k1", "state", "words", "w", "score", "kept", "n_words", "class", "rep", "p", "starts", "doc_key", "left"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    return spark.createDataFrame([(i, t, "en", None, None, *range(len(names))) for i, t in rows], schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (11, 0, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()
