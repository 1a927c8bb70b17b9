"""Byte-level BPE as a finite-state transducer, and streaming decoding.

Merging by rank has a property that makes it a left-to-right machine: in the encoding of a
prefix, the last token is the only token of the vocabulary that ends there and that
is compatible with the token before it (encoding the two alone gives the two). The transducer
reads bytes and holds the live readings: the bytes of a token that has begun, and the
tokens before it. Tokens that all live readings share are emitted, so the lookahead is bounded
by the longest token. States are determinised when an input first needs them and kept,
up to a bound, after which the machine starts again from none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Bounds of what a worker keeps; reaching one costs time only.
MAX_STATES = 400_000
MAX_PIECES = 200_000
#: Bytes of one piece after which its certain tokens are emitted.
MAX_HELD = 1024
ID = np.dtype("<u4")
#: How an arc holds its token.
TOKEN_BITS = 24
TOKEN_MASK = (1 << TOKEN_BITS) - 1
#: Stands for no token, and for the time before the first merge.
NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Transducer:
    """Reads the bytes of one piece of text and writes token ids.

    A live reading is (bytes of a token that has begun, class of the token before it); a state
    is the set of live readings. Each arc carries the one token that ends at its byte, from
    which the tokens that all live readings share are read back and emitted.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.never = max(self.tokens, default=0) + 1
        self.open = {token[:n] for token in ranks for n in range(1, len(token))}
        self.shut = {token[n:] for token in ranks for n in range(1, len(token))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.grown: dict[int, tuple[int, int] | None] = {}
        self.narrowed: dict[tuple[bytes, int], int] = {}
        # Class 0 is the place before the first token: nothing can be joined to it.
        self.classes: dict[tuple, int] = {(): 0}
        self.edges: list[tuple] = [()]
        self._forget()

    def _forget(self) -> None:
        """Begins anew with the start state. Readings are numbered, and a state is the tuple of its readings."""
        self.reading_numbers = {(b"", 0): 0}
        self.readings: list[tuple[bytes, int]] = [(b"", 0)]
        self.numbers: dict[tuple[int, ...], int] = {(0,): 0}
        self.states: list[tuple[int, ...]] = [(0,)]
        self.arcs: dict[int, int] = {}  # state and byte to next state and ended token

    def _borders(self, token: int) -> tuple[int, int] | None:
        """Classes of a token as the left and as the right neighbour; None for a token that merging does not give.

        A class is how the token's last (first) part grows while the token is merged alone: parts
        with the ranks of the merges that begin and end them, as far as any token goes on
        (begins) with them. Tokens of a class are compatible with the same neighbours.
        """
        known = self.grown.get(token, ())
        if known == ():
            parts = [bytes((c,)) for c in self.tokens[token]]
            first, last, since_first, since_last = [], [], NONE, NONE
            while len(parts) > 1:
                options = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
                if not options:
                    break
                rank, i = min(options)
                if i == 0:
                    first.append((parts[0], since_first, rank))
                    since_first = rank
                if i == len(parts) - 2:
                    last.append((parts[-1], since_last, rank))
                    since_last = rank
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = None
            if len(parts) == 1:
                first.append((parts[0], since_first, self.never))
                last.append((parts[0], since_last, self.never))
                known = (
                    self._class(tuple(x for x in last if x[0] in self.open)),
                    self._class(tuple(x for x in first if x[0] in self.shut)),
                )
            self.grown[token] = known
        return known

    def _class(self, edge: tuple) -> int:
        number = self.classes.get(edge)
        if number is None:
            number = self.classes[edge] = len(self.edges)
            self.edges.append(edge)
        return number

    def _relevant(self, begun: bytes, before: int) -> int:
        """The class without parts that no token beginning with these bytes can be joined to."""
        if not before:
            return 0
        known = self.narrowed.get((begun, before))
        if known is None:
            if len(self.narrowed) >= MAX_STATES // 2:
                self.narrowed.clear()
            heads = [begun[:n] for n in range(1, len(begun) + 1)]
            known = self.narrowed[begun, before] = self._class(tuple(
                x for x in self.edges[before] if x[0] + begun in self.open or any(x[0] + head in self.ranks for head in heads)
            ))
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Merging the bytes of two tokens of these classes gives just the two.

        Merges happen in the order of their ranks, since a token's rank is above its parts'. So the
        parts on both sides of the border grow as they do alone, unless two that are there at
        the same time make a token of a lower rank than the merges that end them. Of
        equal ranks the left one is merged first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 4 * MAX_STATES:
                self.pairs.clear()
            known = True
            for tail, since_tail, until_tail in self.edges[left]:
                for head, since_head, until_head in self.edges[right]:
                    if since_tail <= until_head and since_head < until_tail:
                        joined = self.ranks.get(tail + head)
                        if joined is not None and joined < until_tail and joined <= until_head:
                            known = False
            self.pairs[left, right] = known
        return known

    def _reading(self, begun: bytes, before: int) -> int:
        number = self.reading_numbers.get((begun, before))
        if number is None:
            number = self.reading_numbers[begun, before] = len(self.readings)
            self.readings.append((begun, before))
        return number

    def _state(self, readings: tuple[int, ...]) -> int:
        number = self.numbers.get(readings)
        if number is None:
            number = self.numbers[readings] = len(self.states)
            self.states.append(readings)
        return number

    def _arc(self, state: int, byte: int) -> int:
        """Determinises one transition: the next state, and the token that ends at its byte."""
        after, letter, ended = [], bytes((byte,)), NONE
        for reading in self.states[state]:
            begun, before = self.readings[reading]
            grown = begun + letter
            token = self.ranks.get(grown)
            if token is not None and ended == NONE:
                borders = self._borders(token)
                if borders is not None and self.compatible(before, borders[1]):
                    ended = token
                    after.append(self._reading(b"", borders[0]))
            if grown in self.open:
                after.append(self._reading(grown, self._relevant(grown, before)))
        after.sort()
        arc = self.arcs[state << 8 | byte] = self._state(tuple(after)) << TOKEN_BITS | ended
        return arc

    def _back(self, ended: list[int], at: int) -> list[int]:
        """Ends of the tokens of the reading that has a border at this place, from the last."""
        ends = []
        while at > 0:
            ends.append(at)
            at -= self.sizes[ended[at - 1]]
        return ends

    def encode(self, data: bytes) -> list[int]:
        """Token ids of a piece. A piece that is a token is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._forget()
        state, ids, ended, arcs = 0, [], [], self.arcs
        for byte in data:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = self._arc(state, byte)
            state = arc >> TOKEN_BITS
            ended.append(arc & TOKEN_MASK)
            if len(ended) >= MAX_HELD:
                begun = [self.readings[r] for r in self.states[state]]
                certain = max(set.intersection(*(set(self._back(ended, len(ended) - len(b))) for b, _ in begun)), default=0)
                ids.extend(ended[e - 1] for e in reversed(self._back(ended, certain)))
                ended = ended[certain:]
                if len(self.states) > MAX_STATES:  # keep only where we are
                    self._forget()
                    arcs, state = self.arcs, self._state(tuple(sorted(self._reading(*r) for r in begun)))
        ids.extend(ended[e - 1] for e in reversed(self._back(ended, len(ended))))
        return ids


class Utf8:
    """UTF-8 as a state machine over bytes. A state is what the next bytes must be: 0 is between characters."""

    def __init__(self) -> None:
        tail = range(0x80, 0xC0)
        #: Fixed values of the encoding: lead bytes, with the range of the byte after them and the state after that.
        leads = [
            (range(0xC2, 0xE0), tail, 0), (range(0xE0, 0xE1), range(0xA0, 0xC0), 1), (range(0xE1, 0xED), tail, 1),
            (range(0xED, 0xEE), range(0x80, 0xA0), 1), (range(0xEE, 0xF0), tail, 1), (range(0xF0, 0xF1), range(0x90, 0xC0), 2),
            (range(0xF1, 0xF4), tail, 2), (range(0xF4, 0xF5), range(0x80, 0x90), 2),
        ]
        # State 1 needs one byte, state 2 needs two; from 3 on, the state after each kind of lead byte.
        self.after: list[dict[int, int]] = [dict.fromkeys(range(0x80), 0), dict.fromkeys(tail, 0), dict.fromkeys(tail, 1)]
        for lead, second, then in leads:
            self.after[0].update(dict.fromkeys(lead, len(self.after)))
            self.after.append(dict.fromkeys(second, then))

    def run(self, state: int, data: bytes) -> int | None:
        """The state after the bytes, or None where they are not UTF-8."""
        for byte in data:
            state = self.after[state].get(byte)
            if state is None:
                return None
        return state


class Decoder:
    """Ids to text as they come: whole characters are handed on, and begun ones wait for their next token."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens, self.machine, self.steps = tokens, Utf8(), {}
        size = max(tokens, default=-1) + 1
        self.whole = np.zeros(size, bool)
        for rank, token in tokens.items():
            self.whole[rank] = self.machine.run(0, token) == 0

    def stream(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Chunks of bytes that end between characters. Bytes that are not UTF-8 are handed on as they are."""
        state, waiting = 0, []
        for rank in ids:
            step = self.steps.get((state, rank))
            if step is None:
                if len(self.steps) >= MAX_PIECES:
                    self.steps.clear()
                step = self.steps[state, rank] = self.machine.run(state, self.tokens[rank])
                if step is None:  # broken here: begin anew after it
                    step = self.steps[state, rank] = 0
            waiting.append(self.tokens[rank])
            state = step
            if not state:
                yield b"".join(waiting)
                waiting = []
        if waiting:
            yield b"".join(waiting)

    def decode(self, ids: np.ndarray) -> bytes:
        if self.whole[ids].all():
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        return b"".join(self.stream(ids.tolist()))


class Pieces(dict):
    """Ids (as little-endian bytes) of pieces met before, up to a bound; a missing piece goes through the transducer."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.transducer.encode(piece.encode()), ID).tobytes()
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Splits text by a pattern and encodes every match."""

    def __init__(self, path: str, pattern: str) -> None:
        self.transducer = Transducer(read_ranks(path))
        self.split = regex.compile(pattern)
        self.pieces = Pieces(self.transducer)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split.findall(text))), ID)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder({rank: token for token, rank in read_ranks(path).items()})


def encode(documents: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The documents with `ids`: the tokens of each whole text.

    Null and empty texts have no tokens. A column named like `ids` is replaced; all others stay.
    Rows are independent: repeated rows are each encoded, and there is no shuffle. The file
    of ranks must be at `path` on every executor.
    """
    kept = documents.drop(ids_col)
    names = kept.columns
    schema = ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in kept.dtypes), f"`{ids_col}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for batch in batches:
            lists = [made.encode(t or "") for t in batch.column(text_col).to_pylist()]
            ids = _list_array(lists)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, ids_col])

    return kept.mapInArrow(run, schema)


def _list_array(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)].astype(np.int32)
    values = np.concatenate(lists) if lists else np.empty(0, ID)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int32), pa.int32()))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """The rows with `decoded`: the bytes of each row's ids, null for null. An id that is not in the file is an error."""
    kept = tokens.drop(bytes_col)
    names = kept.columns
    schema = ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in kept.dtypes), f"`{bytes_col}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        for batch in batches:
            column = batch.column(ids_col)
            made = [None if not x.is_valid else back.decode(x.values.to_numpy(zero_copy_only=False)) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*names, bytes_col])

    return kept.mapInArrow(run, schema)


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and its ids decoded again.

    Does what `encode` and `decode` do, in one task step: ids and texts do not travel between processes.
    """
    source = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, back = codec(path, pattern), decoder(path)
        for batch in batches:
            counts, shas, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = there.encode(text or "")
                counts.append(len(ids))
                shas.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(back.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
