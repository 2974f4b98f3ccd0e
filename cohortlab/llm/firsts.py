"""Finding the earliest occurrence of keys that may be spread over all documents, and cutting spans out of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.llm.common import bounded_batches, slices

#: What an occurrence row is: cut if its key occurs earlier elsewhere, or cut for sure.
ASK, CUT = 0, 1


def collapse(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of keys inside one slice: indices of each key's first, and a mask of those behind it.

    Occurrences with the place of the first are the same document read twice
    and count as neither.
    """
    order = np.lexsort((at, doc, k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = order[new]
    of = np.empty(len(order), np.int64)
    of[order] = first[np.cumsum(new) - 1] if len(order) else of
    return first, (doc != doc[of]) | (at != at[of])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], reach[last]


ROWS = "doc long, start long, end long, k1 long, k2 long, state int"


def occurrence_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
    """What a slice sends on: its first occurrence of each key, and the joined spans it knows to be repeats.

    So no key has more rows than there are slices, however often it occurs.
    """
    first, behind = collapse(k1, k2, doc, start)
    ids, rank = np.unique(doc[behind], return_inverse=True)
    wide = int(end.max(initial=0)) + 2  # documents side by side, so that one pass joins the spans of all
    a, b = merged(start[behind] + rank * wide, end[behind] + rank * wide)
    row = a // wide
    asked = [x[first] for x in (doc, start, end, k1, k2)]
    known = [ids[row] if len(row) else a, a - row * wide, b - row * wide, a, row]  # keys that only spread the rows
    state = np.repeat([ASK, CUT], [len(first), len(row)])
    return pa.RecordBatch.from_arrays(
        [*(pa.array(np.concatenate(x), pa.int64()) for x in zip(asked, known, strict=True)), pa.array(state, pa.int32())],
        names=["doc", "start", "end", "k1", "k2", "state"],
    )


def earliest() -> Column:
    """The smallest place of a row's key."""
    return F.min(F.struct("doc", "start")).over(Window.partitionBy("k1", "k2", "state"))


def is_repeat(first: str = "first") -> Column:
    return (F.col("state") == CUT) | (F.struct("doc", "start") != F.col(first))


def spans_per_doc(spans: DataFrame) -> DataFrame:
    """One row per document: key, starts, ends."""
    return spans.groupBy(F.col("doc").alias("doc_key")).agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")
    )


def doc_key(column: str = "doc_id") -> Column:
    """The document's id as the occurrence rows have it: null is the smallest long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All rows of ``docs`` in a struct ``row``, with the spans of their document beside them."""
    bounded_batches(docs.sparkSession)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("doc_key"))
    found = spans_per_doc(spans)
    return whole.join(found, "doc_key", "left").select("row", "starts", "ends")


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a column of lists of longs; null is empty."""
    values = column.values.to_numpy(zero_copy_only=False)
    off, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[off[i] : off[i + 1]] if valid[i] else values[:0]


def row_spans(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for start, end in zip(lists(part.column("starts")), lists(part.column("ends")), strict=True):
        yield merged(start, end)


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches of ``with_spans`` cut by the size of their texts, and the texts."""
    for batch in batches:
        flat = pa.RecordBatch.from_arrays([*batch.columns, batch.column("row").field("text")], names=[*batch.schema.names, "text"])
        for part in slices(iter([flat]), "text"):
            yield part, part.column("text")
