"""Operator 5: byte-level BPE with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks; the cuts follow the
content, so passages that documents share yield the same chunks, and a task
encodes each of them once. A cut may split a merge, so every join is repaired:
the stretch between the nearest positions around it at which a new piece must
start in any text is encoded again and replaces the tokens there. Both sides
must have a token boundary at exactly these positions, else the stretch is
widened; in the end it spans the whole text. The result equals encoding the
whole text at once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import bounded_batches, packed, slices, table, texts

#: Bytes the rolling hash sees, a power of two.
WINDOW = 16
#: One cut in 2**CUT_BITS positions.
CUT_BITS = 9
#: Bytes of chunks a task remembers; beyond, it starts afresh.
MEMORY = 48 << 20
SPECIAL = {"<|endoftext|>": 50256}


class Codec:
    """Encoder for a file of ranks, and the bytes of each token."""

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        size = max([*ranks.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for token, rank in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
            self.bytes[rank] = token
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, data: bytes) -> np.ndarray:
        return self.encoding.encode_to_numpy(data.decode("utf-8"), allowed_special=self.special).astype(np.uint32, copy=False)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> Codec:
    return Codec(path, pattern, dict(special))


def cuts(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions at which chunks begin inside texts, by the hash of the WINDOW bytes before; never inside a character."""
    if len(flat) <= WINDOW:
        return np.zeros(0, np.int64)
    rolling = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolling ^= rolling >> np.uint64(29)
    weight, width = 0x100000001B3, 1
    while width < WINDOW:  # two windows side by side make one of twice the width
        rolling = rolling[:-width] * np.uint64(weight) + rolling[width:]
        weight, width = weight * weight % 2**64, 2 * width
    rolling ^= rolling >> np.uint64(32)
    rolling *= np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero((rolling >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW
    at = at[at < len(flat)]
    at = at[(flat[at] & 0xC0) != 0x80]
    begins = off[np.searchsorted(off, at, "right") - 1]
    return at[at - begins >= WINDOW]


def safe(flat: np.ndarray) -> np.ndarray:
    """Positions of a blank between two visible ASCII characters: in any text a piece starts there and none crosses."""
    if len(flat) < 3:
        return np.zeros(0, np.int64)
    visible = (flat > 0x20) & (flat < 0x7F)
    return np.flatnonzero((flat[1:-1] == 0x20) & visible[:-2] & visible[2:]) + 1


class Encoder:
    """Encodes texts chunk by chunk and remembers the chunks."""

    def __init__(self, codec: Codec):
        self.codec, self.known, self.held = codec, {}, 0
        self.chunks = self.encoded = self.repairs = 0

    def chunk(self, data: bytes) -> np.ndarray:
        self.chunks += 1
        ids = self.known.get(data)
        if ids is None:
            self.encoded += 1
            ids = self.codec.encode(data)
            self.held += len(data) + ids.nbytes + 200
            if self.held > MEMORY:
                self.known, self.held = {}, len(data) + ids.nbytes + 200
            self.known[data] = ids
        return ids

    def text(self, data: bytes, joins: list[int], stops: np.ndarray) -> np.ndarray:
        """Ids of ``data``, cut at ``joins``; ``stops`` are the safe positions inside it."""
        if not joins:
            return self.chunk(data)
        edges = [0, *joins, len(data)]
        ids = np.concatenate([self.chunk(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
        ends = np.concatenate([[0], np.cumsum(self.codec.lengths[ids])])

        def at(position: int) -> int:
            """Number of tokens before a byte position, or -1 if a token crosses it."""
            i = int(np.searchsorted(ends, position))
            return i if ends[i] == position else -1

        out, done = [], 0  # done: bytes that are final
        for k in np.unique(np.searchsorted(stops, joins)):  # joins between the same stops are repaired together
            low, high = k - 1, k
            if k < len(stops) and stops[k] in joins:  # the cut is at a safe place, yet others may lie before it
                if not any(j < stops[k] and (k == 0 or j > stops[k - 1]) for j in joins):
                    continue
            while True:
                a = int(stops[low]) if low >= 0 else 0
                b = int(stops[high]) if high < len(stops) else len(data)
                if a <= done or at(a) >= 0:
                    if at(b) >= 0:
                        break
                    high += 1
                else:
                    low -= 1
            a = max(a, done)
            if b <= done:
                continue
            self.repairs += 1
            out += [ids[at(done) : at(a)], self.codec.encode(data[a:b])]
            done = b
        return np.concatenate([*out, ids[at(done) :]])


def encode(
    docs: DataFrame, path: str, pattern: str, special: dict[str, int] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Token ids and decoded text of every row, beside the columns ``keep``.

    Columns: ``keep``, then ids (binary, little-endian unsigned 32-bit),
    n_tokens and decoded. ``path`` names the rank file and must be readable on
    every executor; ``pattern`` cuts a text into pieces, ``special`` are strings with
    an id of their own (none: the one of the public 50k vocabulary). A null or
    empty text has no tokens; repeated rows are encoded alike; an empty table
    gives no rows. No shuffle: chunks are shared by the texts of a task.
    """
    items = tuple((SPECIAL if special is None else special).items())
    bounded_batches(docs.sparkSession)
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = source.select(*keep).schema
    for name, kind in (("ids", "binary"), ("n_tokens", "long"), ("decoded", "string")):
        schema = schema.add(name, kind)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec(path, pattern, items))
        for part in slices(batches, "text"):
            ids = [x for x, _ in encoded(part.column("text"), encoder)]
            columns = [part.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns, pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    pa.array([len(x) for x in ids], pa.int64()), pa.array([encoder.codec.decode(x) for x in ids], pa.string()),
                ],
                names=[*names, "ids", "n_tokens", "decoded"],
            )

    return source.mapInArrow(run, schema)


def encoded(column: pa.Array, encoder: Encoder) -> Iterator[tuple[np.ndarray, bytes]]:
    flat, off = packed(column)
    joins, stops, data = cuts(flat, off), safe(flat), flat.tobytes()
    j, s = np.searchsorted(joins, off), np.searchsorted(stops, off)
    for i in range(len(off) - 1):
        a, b = int(off[i]), int(off[i + 1])
        mine = stops[s[i] : s[i + 1]] - a
        if len(mine) and mine[0] == 0:  # what stands before it belongs to another text
            mine = mine[1:]
        if len(mine) and mine[-1] == b - a - 1:
            mine = mine[:-1]
        yield encoder.text(data[a:b], (joins[j[i] : j[i + 1]] - a).tolist(), mine), data[a:b]


def digests(docs: DataFrame, path: str, pattern: str, special: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, for every row."""
    items = tuple((SPECIAL if special is None else special).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec(path, pattern, items))
        for part in slices(batches, "text"):
            ids, decoded, count = [], [], []
            for x, _ in encoded(part.column("text"), encoder):
                count.append(len(x))
                ids.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(encoder.codec.decode(x).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
