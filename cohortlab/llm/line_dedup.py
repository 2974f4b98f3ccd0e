"""Operator 8: substring dedup by hashing lines and the parts of lines.

Units are whole lines and their parts: sentences, cut once more before a
capitalised word, where a passage may have been put into a sentence, and long
sentences behind words that their hash selects. Units are normalised and hashed, digests are grouped over all documents, the occurrence
with the smallest (doc_id, offset) stays and all others are removed. A unit of
few words says little alone and is hashed together with its neighbours.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import longs, slices, table, texts
from cohortlab.llm.firsts import ROWS, earliest, is_repeat, lists, occurrence_rows, row_spans, text_slices, with_spans

#: Words of a unit that is hashed alone.
MIN_WORDS = 6
#: From this many words on a sentence is cut further, behind one word in STEP.
LONG, STEP = 20, 10

_LINE = re.compile(r"[^\n]+")
_CUT = re.compile(r"(?<=[.!?])\s+|(?<=[^\s.!?])\s+(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")
_TOKEN = re.compile(r"\S+")
_EDGE = " \t\r\x0b\x0c.,;:!?\"'()"


def normalised(unit: str) -> str:
    return " ".join(unit.lower().split()).strip(_EDGE)


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, end, what is hashed) of the lines and parts of a text, in code points."""
    parts: list[tuple[int, int, str, int]] = []
    for line in _LINE.finditer(text):
        a, b = line.span()
        at = a
        for cut in _CUT.finditer(text, a, b):
            parts.append((at, cut.end(), norm := normalised(text[at : cut.start()]), norm.count(" ") + bool(norm)))
            at = cut.end()
        whole = normalised(line.group()) or line.group().strip()
        if whole and (at > a or whole.count(" ") + 1 < min_words):
            yield a, b, whole
        if at < b:
            parts.append((at, b, norm := normalised(text[at:b]), norm.count(" ") + bool(norm)))
    for i, (a, b, norm, words) in enumerate(parts):
        if words >= min_words:
            yield a, b, norm
            if words >= LONG:
                yield from stretches(text, a, b, min_words)
        elif words and 0 < i < len(parts) - 1:
            yield a, b, f"{parts[i - 1][2]}\n{norm}\n{parts[i + 1][2]}"


def stretches(text: str, a: int, b: int, min_words: int) -> Iterator[tuple[int, int, str]]:
    """Parts of a long sentence, cut behind words whose hash selects them: an edit or a fused begin spoils one part only."""
    at, words = a, 0
    for word in _TOKEN.finditer(text, a, b):
        words += 1
        if zlib.crc32(word.group().lower().strip(_EDGE).encode()) % STEP == 0:
            if words >= min_words and (at > a or word.end() < b):
                yield at, word.end(), normalised(text[at : word.end()])
            at, words = word.end(), 0
    if words >= min_words and at > a:
        yield at, b, normalised(text[at:b])


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Units of all documents as occurrence rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in slices(batches, "text"):
            doc, start, end, keys = [], [], [], []
            for d, text in zip(longs(part.column("doc_id")).tolist(), part.column("text").to_pylist(), strict=True):
                for a, b, said in units(text, min_words):
                    doc.append(d)
                    start.append(a)
                    end.append(b)
                    keys.append(digest(said))
            if doc:
                halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2).T
                yield occurrence_rows(*(np.array(x, np.int64) for x in (doc, start, end)), *halves)

    return texts(docs).mapInArrow(run, ROWS)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans to remove: doc (key of the document), start, end."""
    rows = occurrences(docs, min_words).withColumn("first", earliest())
    return rows.filter(is_repeat()).select("doc", "start", "end")


def without(text: str, start: np.ndarray, end: np.ndarray) -> str:
    edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """What is left of every document, and what was removed.

    One row per input row: doc_id, n_chars and n_removed (code points),
    n_spans, spans (array of start and end in the original text, in order and
    disjoint), text (what is left). A null or empty text has no units and stays
    empty; rows with one doc_id are one document read twice and treated alike;
    a null doc_id ranks first; an empty table gives no rows; other columns are
    ignored.
    """
    schema = "doc_id long, n_chars long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in text_slices(batches):
            said = [x or "" for x in column.to_pylist()]
            found = list(row_spans(part))
            spans = [[{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)] for s, e in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row").field("doc_id").cast(pa.int64()),
                    pa.array([len(x) for x in said], pa.int64()),
                    pa.array([int((e - s).sum()) for s, e in found], pa.int64()),
                    pa.array([len(s) for s, _ in found], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([without(x, *f) for x, f in zip(said, found, strict=True)], pa.string()),
                ],
                names=["doc_id", "n_chars", "n_removed", "n_spans", "spans", "text"],
            )

    return with_spans(docs.select("doc_id", "text"), repeated_spans(docs, min_words)).mapInArrow(run, schema)


def dedup_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with all their columns and the repeats cut out of ``text``.

    Rows of which nothing but blanks is left are dropped, unless nothing was cut from them.
    """
    kind = docs.schema["text"].dataType
    row = F.col("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in text_slices(batches):
            found = row_spans(part)
            left = [without(x, *f) if len(f[0]) else x for x, f in zip(column.to_pylist(), found, strict=True)]
            keep = [x is None or bool(x.strip()) or not len(s) for x, s in zip(left, lists(part.column("starts")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(left, pa.string())], names=["row", "left"]
            ).filter(pa.array(keep, pa.bool_()))

    joined = with_spans(docs, repeated_spans(docs, min_words))
    out = joined.mapInArrow(run, joined.select("row").schema.add("left", "string"))
    return out.select(*[F.col("left").cast(kind).alias("text") if c == "text" else row[c].alias(c) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
