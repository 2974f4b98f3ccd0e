"""Operator 12: a Merkle manifest of a table, with a witness for every row that grows as digests are appended.

Rows are leaves of one tree per language; the trees' roots are leaves of one
tree above them. Leaves get their place by a distributed sort and are appended
in order, in aligned blocks of 8**LEVELS. In a block every open subtree keeps
the partial witnesses of its leaves; when a run of siblings is complete, each
witness gets the digests of the others in the run. The roots of the blocks are
appended the same way, and their witnesses extend those of their leaves.

A witness is a string of bytes: for each level the place in the run, the number
of siblings, and their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import table
from cohortlab.operators.numbering import numbered
from cohortlab.session import stage

#: Children of a node, and levels that one task builds above an aligned block of nodes.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def node(digests: list[bytes]) -> bytes:
    """The digest above a run of digests: over their hexadecimal texts, one after the other."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Subtree:
    """An aligned block to which digests are appended in order; it holds the witnesses of its leaves."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[bytes, list[int]]]] = [[] for _ in range(levels + 1)]  # per level: (digest, its leaves)
        self.witness: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        self.witness.append(bytearray())
        self._add(0, digest, [len(self.witness) - 1])

    def _add(self, level: int, digest: bytes, leaves: list[int]) -> None:
        self.open[level].append((digest, leaves))
        if level < self.levels and len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The run of a level ends: its members learn their siblings, and the node above is appended."""
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _ in run]
        for place, (_, leaves) in enumerate(run):
            step = bytes([place, len(run) - 1]) + b"".join(digests[:place] + digests[place + 1 :])
            for leaf in leaves:
                self.witness[leaf] += step
        self._add(level + 1, node(digests), [leaf for _, leaves in run for leaf in leaves])

    def close(self) -> bytes:
        """No more digests follow: open runs end as they are. The root of the block."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Place in the run and siblings, level by level."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        yield place, [witness[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for place, siblings in steps(witness):
        digest = node([*siblings[:place], digest, *siblings[place:]])
    return digest


def depth(total: int) -> int:
    """Levels above so many leaves; a lone leaf is the root itself."""
    levels = 0
    while ARITY**levels < total:
        levels += 1
    return levels


def grown(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (tree, idx, total, digest and others) with ``witness`` inside their aligned block and ``top``, the block's root.

    A block is BLOCK rows at most, so a tree of any size is spread over tasks.
    """
    schema = nodes.schema.add("witness", "binary").add("top", "binary")
    block = F.expr(f"idx div {BLOCK}")
    dealt = nodes.repartition("tree", block).sortWithinPartitions("tree", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, subtree = None, [], None

        def finished() -> pa.RecordBatch:
            top = subtree.close()
            rows = pa.concat_batches(held)
            witness = pa.array([bytes(w) for w in subtree.witness], pa.binary())
            return pa.RecordBatch.from_arrays([*rows.columns, witness, pa.array([top] * rows.num_rows, pa.binary())], names=schema.names)

        for batch in batches:
            trees, places = batch.column("tree").to_pylist(), batch.column("idx").to_pylist()
            totals, digests = batch.column("total").to_pylist(), batch.column("digest").to_pylist()
            begin = 0
            for i in range(batch.num_rows):
                mine = (trees[i], places[i] // BLOCK)
                if mine != key:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if held:
                        yield finished()
                    key, held, begin, subtree = mine, [], i, Subtree(min(LEVELS, depth(totals[i])))
                subtree.append(digests[i])
            if batch.num_rows > begin:
                held.append(batch.slice(begin))
        if held:
            yield finished()

    return stage(dealt.mapInArrow(run, schema), name)


def trees(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """All levels above the nodes (tree, idx, total, digest and others): the nodes with their whole ``witness``, and tree, digest of each root.

    Each round appends the blocks' roots of the round before; a tree of N leaves takes log N rounds to the base BLOCK.
    """
    rounds = []
    while True:
        rounds.append(grown(nodes, f"{name}-{len(rounds)}"))
        tops = rounds[-1].filter(f"idx % {BLOCK} = 0")
        nodes = tops.select("tree", F.expr(f"idx div {BLOCK}").alias("idx"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("top").alias("digest"))
        if nodes.filter("total > 1").isEmpty():
            break
    found = rounds.pop()
    while rounds:
        above = found.select("tree", F.col("idx").alias("block_"), F.col("witness").alias("above_"))
        below = rounds.pop().withColumn("block_", F.expr(f"idx div {BLOCK}"))
        found = below.join(above, ["tree", "block_"]).withColumn("witness", F.concat("witness", "above_")).drop("block_", "above_")
    return found.drop("top"), nodes.select("tree", "digest")


def _field(column: str, text: Column | None = None) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = F.col(column).cast("string") if text is None else text
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row of documents; ``text`` in place of its own text, if given."""
    fields = [_field("doc_id"), _field("source"), _field("lang"), _field("n_chars"), _field("text", text)]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def manifest(docs: DataFrame, others: dict[str, Column] | None = None) -> DataFrame:
    """Every row's place in the manifest: doc_id, leaf, subroot, root (hexadecimal), witness (bytes), and ``others`` (expressions over ``docs``).

    Leaves of a language ascend by doc_id, a null doc_id first; rows with the same doc_id are leaves of
    their own, ordered by their digest. A null language is a tree of its own and
    the first; a null in any column has its own mark, so it differs from an
    empty text. Texts of any length are hashed where they are read. An empty table gives no rows.
    """
    others = others or {}
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))  # no language sorts before all, the empty one too
    leaves = docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"),
        *[c.alias(n) for n, c in others.items()], F.monotonically_increasing_id().alias("row_"),
    )
    order = [F.col("doc_id"), F.col("digest"), F.col("row_")]
    placed, subroots = trees(numbered(leaves, "tree", order, "manifest-leaves").drop("row_"), "manifest-blocks")
    above = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang_"), "digest"), "tree", [F.col("lang_")], "manifest-langs")
    langs, roots = trees(above, "manifest-top")
    root = roots.first()
    langs = langs.select(F.col("lang_").alias("tree"), F.col("digest").alias("subroot"), F.col("witness").alias("above_"))
    hex_of = lambda c: F.lower(F.hex(c))
    return placed.join(langs, "tree").select(
        "doc_id", hex_of("digest").alias("leaf"), hex_of("subroot").alias("subroot"), F.lit(root["digest"].hex() if root else "").alias("root"),
        F.concat("witness", "above_").alias("witness"), *others,
    )


def checked(entries: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with a column ``seen`` (the leaf found now, as bytes): proof_sha256 and folded_root in place of witness and seen."""
    names = [c for c in entries.columns if c not in ("witness", "seen")]
    schema = entries.select(*names).schema.add("proof_sha256", "string").add("folded_root", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            witness = batch.column("witness").to_pylist()
            proofs = [hashlib.sha256(b"".join(s for _, run in steps(w) for s in run).hex().encode()).hexdigest() for w in witness]
            folded = [fold(d, w).hex() for d, w in zip(batch.column("seen").to_pylist(), witness, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], names=schema.names)

    return entries.mapInArrow(run, schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = leaf_digest(F.translate("text", _CAPITALS, _CAPITALS.lower()))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    entries = manifest(docs, {"seen": F.when(hit, tampered).otherwise(leaf_digest())})
    return checked(entries).withColumn("verified", F.col("folded_root") == F.col("root"))
