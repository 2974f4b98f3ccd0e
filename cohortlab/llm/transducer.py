"""Operator 11: byte-level BPE as a lazily determinised transducer, and streaming decode.

Encoding. A sequence of tokens is the encoding of its bytes exactly if each
neighbouring pair of tokens stays apart when the pair alone is encoded (Berglund
and van der Merwe 2023). So the merges are a finite-state machine that reads
bytes, walks the trie of all tokens, and guesses where a token ends. ``State``
is a set of such guesses (subset construction). Each step names the token that
would end there; later bytes decide, after a bounded lookahead, which of these
tokens stand, and those are emitted. States and their transitions are made when
a text first needs them.

Decoding. Bytes of the tokens run through a UTF-8 state machine that holds the
at most three bytes of an unfinished character. Its steps over whole tokens are
also made on first use.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from cohortlab.llm.common import bounded_batches, slices, table

#: States a task remembers; beyond, it starts afresh.
STATES = 1 << 18
#: Bytes of a piece after which settled tokens are emitted; bytes of the longest piece whose path is remembered.
WINDOW, SHORT = 1024, 64
_NEVER = 1 << 40


class Merges:
    """Ranks of byte strings, and which tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.made: dict[int, tuple[bool, bool, tuple[int, ...]]] = {}
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.known: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes, stop: int = 1) -> tuple[list[bytes], list[int]]:
        """Merges by the definition: always the pair of the smallest rank, the leftmost of equals; the parts and the ranks used."""
        parts, order = [data[i : i + 1] for i in range(len(data))], []
        while len(parts) > stop:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            order.append(rank)
        return parts, order

    def making(self, token: int) -> tuple[bool, bool, tuple[int, ...]]:
        """Whether merges make the token of its bytes, whether by rising ranks, and the two tokens of the last merge (none: a byte)."""
        found = self.made.get(token)
        if found is None:
            parts, order = self.merged(self.tokens[token], stop=2)
            order = [*order, token] if len(parts) == 2 else order
            found = self.made[token] = (len(parts) <= 2, order == sorted(order), tuple(self.ranks[p] for p in parts) if len(parts) == 2 else ())
        return found

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens at one edge (0: left, 1: right) of a token while it is merged, from its byte up to itself."""
        found = self.edges[side].get(token)
        if found is None:
            halves = self.making(token)[2]
            found = self.edges[side][token] = [*(self.edge(halves[side], side) if halves else ()), token]
        return found

    def apart(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of both tokens gives these two tokens."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= 4 * STATES:
                self.known.clear()
            found = self.known[a, b] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        if not all(self.making(a)[:2] + self.making(b)[:2]):
            one, two = self.tokens[a], self.tokens[b]
            return self.merged(one + two)[0] == [one, two]
        # both sides grow by rising ranks; a merge across the border comes first if its rank is below what either side does next
        left, right = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            grow_left = left[i + 1] if i + 1 < len(left) else _NEVER
            grow_right = right[j + 1] if j + 1 < len(right) else _NEVER
            across = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]], _NEVER)
            if across < grow_left and across <= grow_right:
                return False
            if grow_left == grow_right == _NEVER:
                return True
            if grow_left <= grow_right:  # of equal ranks the leftmost is merged first
                i += 1
            else:
                j += 1


class State(dict):
    """A state: byte -> next state.

    ``guesses``: (token before, node) of each token that may still be open, the
    oldest first; the last one opens here. ``token``, ``length``: the last token of what was read, and its
    bytes. ``whole``: all that was read is this token, which no merges make.
    """

    __slots__ = ("machine", "guesses", "token", "length", "whole")

    def __init__(self, machine: Transducer, guesses: tuple[tuple[int, int], ...]):
        self.machine, self.guesses = machine, guesses
        self.token = guesses[-1][0]
        self.length = machine.length.get(self.token, 0)
        first, node = guesses[0]
        token = machine.token.get(node) if first == -1 else None
        self.whole = token if token is not None and not machine.merges.making(token)[0] else None

    def __missing__(self, byte: int) -> State:
        step = self[byte] = self.machine.step(self, byte)
        return step


class Transducer:
    """Encodes pieces by the ranks of a vocabulary that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int], limit: int = STATES):
        self.merges, self.limit = Merges(ranks), limit
        self.child: dict[int, int] = {}  # the trie: node * 256 + byte -> node; node 0 is the root
        self.token: dict[int, int] = {}
        self.inner: set[int] = set()
        self.depth = [0]
        self.length = {rank: len(token) for token, rank in ranks.items()}
        for token, rank in ranks.items():
            node = 0
            for at, byte in enumerate(token):
                self.inner.add(node)
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.depth)
                    self.depth.append(at + 1)
                node = to
            self.token[node] = rank
        self.paths: dict[bytes, list[int]] = {}
        self.start = State(self, ((-1, 0),))
        self.states = {self.start.guesses: self.start}

    def step(self, state: State, byte: int) -> State:
        """The guesses after one more byte. Exactly one token can end here: encodings of all beginnings are unique."""
        going, done = [], -1
        for before, node in state.guesses:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            token = self.token.get(to)
            if token is not None and self.merges.making(token)[0] and (before == -1 or self.merges.apart(before, token)):
                done = token
            if to in self.inner or (before == -1 and token is not None):
                going.append((before, to))
        return self.state((*going, (done, 0)))

    def state(self, guesses: tuple[tuple[int, int], ...]) -> State:
        found = self.states.get(guesses)
        if found is None:
            if len(self.states) >= self.limit:  # like any lazily built automaton: forget all but the start
                self.start.clear()
                self.states = {self.start.guesses: self.start}
            found = self.states[guesses] = State(self, guesses)
        return found

    def path(self, states: list[State], to: int) -> list[int]:
        """Tokens of the first ``to`` bytes read, the last first. ``states[i]``: the state after i + 1 bytes."""
        out = []
        while to > 0:
            state = states[to - 1]
            out.append(state.token)
            to -= state.length
        return out

    def settled(self, states: list[State]) -> int:
        """How many of the bytes read are encoded whatever follows: the ways to all open tokens meet there."""
        ways = []
        for _, node in states[-1].guesses:
            at = len(states) - self.depth[node]
            way = {at}
            for token in self.path(states, at):
                at -= self.length[token]
                way.add(at)
            ways.append(way)
        return max(set.intersection(*ways))

    def encode(self, pieces: Iterable[bytes]) -> list[int]:
        """Tokens of the pieces, in order.

        A short piece that was read before takes the remembered path through
        the machine in one step, the path's tokens with it.
        """
        out: list[int] = []
        for piece in pieces:
            found = self.paths.get(piece)
            if found is None:
                found = self.run(piece)
                if len(self.paths) >= self.limit:
                    self.paths.clear()
                if len(piece) <= SHORT:
                    self.paths[piece] = found
            out += found
        return out

    def run(self, piece: bytes) -> list[int]:
        """Tokens of one piece, byte by byte through the states.

        They are emitted at its end; in a long one, every WINDOW bytes, as far
        as they are settled, so little is held at any time.
        """
        out: list[int] = []
        if piece:
            state, begin = self.start, 0
            states = [state := state[byte] for byte in piece[:WINDOW]]
            while begin + WINDOW < len(piece):
                begin += WINDOW
                done = self.settled(states)
                out += self.path(states, done)[::-1]
                del states[:done]
                states += [state := state[byte] for byte in piece[begin : begin + WINDOW]]
            out += [state.whole] if state.whole is not None else self.path(states, len(states))[::-1]
        return out


def _follow(held: bytes) -> tuple[int, int, int]:
    """Of an unfinished character: bytes still missing, and the bounds of the next one (Unicode, table 3-7)."""
    lead = held[0]
    left = (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) - len(held)
    if len(held) > 1:
        return left, 0x80, 0xBF
    return left, {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)


class Utf8(dict):
    """A state of the decoder: token -> (text that is final, next state). ``held``: bytes of an unfinished character."""

    __slots__ = ("held", "tokens", "states")

    def __init__(self, tokens: dict[int, bytes], held: bytes = b"", states: dict[bytes, Utf8] | None = None):
        self.tokens, self.held = tokens, held
        self.states = {} if states is None else states
        self.states[held] = self

    def __missing__(self, token: int) -> tuple[str, Utf8]:
        text, held = self.fed(self.tokens[token])
        to = self.states[held] if held in self.states else Utf8(self.tokens, held, self.states)
        step = self[token] = (text, to)
        return step

    def fed(self, data: bytes) -> tuple[str, bytes]:
        """Characters that end within ``data``, and the unfinished rest; each broken sequence is one U+FFFD."""
        out, held = [], self.held
        for byte in data:
            if held:
                left, low, high = _follow(held)
                if low <= byte <= high:
                    held += bytes([byte])
                    if left == 1:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                held = bytes([byte])
            else:
                out.append("�")
        return "".join(out), held

    def decode(self, ids: Iterable[int]) -> str:
        state, out = self, []
        for token in ids:
            text, state = state[token]
            out.append(text)
        return "".join(out) + ("�" if state.held else "")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def machines(path: str) -> tuple[Transducer, Utf8]:
    transducer = Transducer(read_ranks(path))
    return transducer, Utf8(transducer.merges.tokens)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids and decoded text of every row, beside the columns ``keep``.

    Columns: ``keep``, then ids (array of ints), n_tokens and decoded. ``path``
    names the rank file, readable on every executor; each match of ``pattern``
    is encoded separately; there are no special tokens. A null or empty text has no
    tokens and decodes to an empty text; repeated rows are encoded alike; an
    empty table gives no rows; other columns are ignored. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = source.select(*keep).schema
    for name, kind in (("ids", ArrayType(IntegerType())), ("n_tokens", LongType()), ("decoded", StringType())):
        schema = schema.add(name, kind)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern)
        transducer, decoder = machines(path)
        for part in slices(batches, "text"):
            ids, ends, decoded = [], [0], []
            for text in part.column("text").to_pylist():
                found = transducer.encode(map(str.encode, cut.findall(text)))
                decoded.append(decoder.decode(found))
                ids.append(pa.array(found, pa.int32()))
                ends.append(ends[-1] + len(found))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(ids)),
                    pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64()), pa.array(decoded, pa.string()),
                ],
                names=[*names, "ids", "n_tokens", "decoded"],
            )

    return source.mapInArrow(run, schema)


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def op11_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id",))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", _digest(ids).alias("ids_sha256"), _digest(F.col("decoded")).alias("decoded_sha256")
    )
