"""Alignment of two tokenizers' ids over the same bytes, and counts of aligned ids in a corpus.

The cumulative byte ends of both token lists become dictionaries from end to index. Ends that both
have, found by intersecting the two sets and sorted, slice both lists into groups. Inside a slice
tokens are linked where their byte ranges overlap; each such overlap ends at one end of either list,
so a slice of a and b tokens has a + b - 1 links at most, and none are made between slices.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailrisk.llm.common import bound_batches, pieces
from mailrisk.session import cut_lineage

#: Characters for which encoding unit by unit is certain to equal encoding the whole text.
PLAIN = re.compile(r"[\n\x20-\x7E¡-¬®-ſ]*")
#: A unit begins with a space after something else than white space, where both sides always end a token.
UNIT = re.compile(r" [ \n]*[^ \n]*(?:\n[ \n]*[^ \n]*)*(?: [ \n]*\Z)?")
#: Fixed value: how the byte-level tokenizer splits text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
SPACE = "▁"
MAX_UNITS, MAX_UNIT = 120_000, 64
#: Bytes of texts in a batch, and of those that are held as tokens at once.
TEXTS_BYTES, TEXT_AT_ONCE = 4 << 20, 1 << 20
#: Distinct pairs that a task sums before it hands them on, and that one broadcast block holds.
MAX_SUMMED, BLOCK_PAIRS = 1_000_000, 2_000_000


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(c): b for c, b in [*zip(printable, printable, strict=True), *((256 + i, b) for i, b in enumerate(others))]}


class ByteLevel:
    """Side A: byte-level BPE of a tokenizers file; special tokens' strings are plain text.

    Where the ids of the file follow its merges, tiktoken gives the same ids for plain text in a
    fraction of the time; other texts and files go to the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        letters = byte_letters()
        ids = made["model"]["vocab"] | {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        entries = [""] * (max(ids.values()) + 1)
        for entry, i in ids.items():
            entries[i] = entry
        # An entry outside the alphabet is a special one, which is never emitted.
        self.tokens = [bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode() for entry in entries]
        splits = made.get("pre_tokenizer") or {}
        self.plain = not made.get("normalizer") and splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space", True)
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in made["model"]["merges"]]
        alphabet = len(letters)
        self.fast = None
        if self.plain and entries[alphabet : alphabet + len(merges)] == merges and set(entries[:alphabet]) == set(letters):
            ranks = {token: i for i, token in enumerate(self.tokens[: alphabet + len(merges)])}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self) -> Tokenizer:
        """Loaded when a text needs it."""
        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def encode(self, texts: list[str], plain: bool) -> list[list[int]]:
        if not texts:
            return []
        if plain and self.fast:
            return list(map(self.fast.encode_ordinary, texts))
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Side B: BPE pieces of the sentencepiece library, which puts a space before the text itself."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = self.library.id_to_piece(list(range(self.library.get_piece_size())))
        self.tokens = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(e)) else e.replace(SPACE, " ").encode() for e in entries]
        # With a space inside an entry, a merge could reach over the border of two units.
        self.plain = not any(re.search(f"[^{SPACE}]{SPACE}", e) for e in entries)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        return self.library.encode(texts, num_threads=1) if texts else []


def slices(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Where each group ends in both lists, given the cumulative byte ends of their tokens, none of them empty."""
    at_a = dict(zip(ends_a, count(1)))
    at_b = dict(zip(ends_b, count(1)))
    common = sorted(at_a.keys() & at_b.keys())
    return list(zip(map(at_a.__getitem__, common), map(at_b.__getitem__, common)))


def overlaps(ends_a: list[int], ends_b: list[int], a: int, b: int, to_a: int, to_b: int) -> list[tuple[int, int]]:
    """The pairs of tokens whose bytes overlap in one slice, from a to to_a and from b to to_b."""
    if to_a - a == 1:
        return [(a, j) for j in range(b, to_b)]
    if to_b - b == 1:
        return [(i, b) for i in range(a, to_a)]
    found = [(a, b)]
    while a + 1 < to_a or b + 1 < to_b:  # the side whose token ends first goes on; they end together only at the end
        if ends_a[a] < ends_b[b]:
            a += 1
        else:
            b += 1
        found.append((a, b))
    return found


class Aligned(NamedTuple):
    """Tokens, groups and links of a text or unit; `links` are little-endian 64-bit, groups as in `align`."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


NOTHING = Aligned(0, 0, 0, "", b"")
#: The same of a unit, without what follows from the rest: tokens of A, groups and links.
Unit = tuple[int, str, bytes]
NO_UNIT: Unit = (0, "", b"")


def aligned(n_a: int, groups: str, links: bytes) -> Aligned:
    """A group of a and b tokens has one `|` and a + b - 1 links."""
    n_groups = groups.count("|")
    return Aligned(n_a, len(links) // 8 + n_groups - n_a, n_groups, groups, links)


class Aligner:
    """Both tokenizers. Units met before are kept up to a bound, those met again for longer."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.sizes_a, self.sizes_b = [len(t) for t in self.a.tokens], [len(t) for t in self.b.tokens]
        self.names_a, self.names_b = [f"{i}|" for i in range(len(self.sizes_a))], [str(i) for i in range(len(self.sizes_b))]
        self.units: dict[str, Unit] = {}
        self.older: dict[str, Unit] = {}

    def align_ids(self, text: str, ids_a: list[int], ids_b: list[int]) -> Unit:
        """Aligns the ids of both sides; nothing where the bytes of either differ from the text."""
        data = text.encode()
        if b"".join(map(self.b.tokens.__getitem__, ids_b)) != data or b"".join(map(self.a.tokens.__getitem__, ids_a)) != data:
            return NO_UNIT
        ends_a, ends_b = list(accumulate(map(self.sizes_a.__getitem__, ids_a))), list(accumulate(map(self.sizes_b.__getitem__, ids_b)))
        printed, links, n, a, b = [], [], len(self.sizes_b), 0, 0
        name_a, name_b = self.names_a, self.names_b
        for to_a, to_b in slices(ends_a, ends_b):
            x, y = ids_a[a], ids_b[b]
            if to_a - a == 1:
                if to_b - b == 1:
                    printed.append(name_a[x] + name_b[y])
                    links.append(x * n + y)
                else:
                    rest = ids_b[b + 1 : to_b]
                    printed.append(f"{name_a[x]}{name_b[y]},{','.join(map(str, rest))}")
                    links += [x * n + other for other in (y, *rest)]
            else:
                printed.append(f"{','.join(map(str, ids_a[a : to_a - 1]))},{name_a[ids_a[to_a - 1]]}{','.join(map(str, ids_b[b:to_b]))}")
                links += [ids_a[i] * n + ids_b[j] for i, j in overlaps(ends_a, ends_b, a, b, to_a, to_b)]
            a, b = to_a, to_b
        return len(ids_a), ";".join(printed), array("q", links).tobytes()

    def _whole(self, texts: list[str], plain: bool) -> Iterator[Unit]:
        """Aligns texts that begin with a space."""
        sides = zip(texts, self.a.encode(texts, plain), self.b.encode([t[1:] for t in texts]), strict=True)
        return (self.align_ids(*side) for side in sides)

    def align_all(self, texts: list[str | None]) -> list[Aligned]:
        """Aligns whole texts, plain ones by their units."""
        spaced = [" " + t for t in texts if t]
        both = self.a.plain and self.b.plain
        split = [UNIT.findall(t) if both and PLAIN.fullmatch(t) else None for t in spaced]
        if len(self.units) > MAX_UNITS:
            self.units, self.older = {}, self.units
        missing = set().union(*filter(None, split)).difference(self.units)
        # What is still in use moves on from the older half.
        self.units.update((unit, self.older[unit]) for unit in missing & self.older.keys())
        missing = list(missing.difference(self.units))
        known, long = self.units, []
        for unit, made in zip(missing, self._whole(missing, True), strict=True):
            known[unit] = made
            if len(unit) > MAX_UNIT:
                long.append(unit)
        others = self._whole([t for t, units in zip(spaced, split, strict=True) if units is None], False)
        done = iter([aligned(*(next(others) if units is None else self._joined(map(known.__getitem__, units)))) for units in split])
        for unit in long:
            del known[unit]
        return [next(done) if t else NOTHING for t in texts]

    def _joined(self, units: Iterable[Unit]) -> Unit:
        n_a, groups, links = zip(*units, strict=True)
        return (sum(n_a), ";".join(groups), b"".join(links)) if all(n_a) else NO_UNIT


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process."""
    return Aligner(path_a, path_b)


def align(documents: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """The documents with `n_a`, `n_b`, `n_groups`, `groups` and `links`; columns of these names are replaced.

    A is the byte-level BPE file at path_a, encoding space and text, B the pieces at path_b. `groups`
    reads `a1,a2|b1;a3|b2,b3`, ids in order. `links` holds each overlapping pair of token
    occurrences as id of A times the number of B's ids plus id of B. Null and empty texts, and texts
    that either side does not give back byte by byte, have no tokens: zeros, no links and empty
    `groups`. Rows are independent: repeated rows are each aligned, and there is no shuffle. Both
    files must be at their paths on every executor.
    """
    made_names = ["n_a", "n_b", "n_groups", "groups", "links"]
    kept = documents.drop(*made_names)
    names = kept.columns
    schema = ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in kept.dtypes), "n_a long, n_b long, n_groups long, groups string, links array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for some in pieces(batch, text_col, TEXT_AT_ONCE):
                n_a, n_b, n_groups, groups, links = zip(*both.align_all(some.column(text_col).to_pylist()), strict=True)
                ends = np.r_[0, np.cumsum([len(x) // 8 for x in links], dtype=np.int64)].astype(np.int32)
                values = np.frombuffer(b"".join(links), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()),
                     pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))],
                    names=[*names, *made_names])

    return kept.mapInArrow(run, schema)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's links end, the distinct pairs of all rows, and for each link the place of its pair."""
    ends = column.offsets.to_numpy().astype(np.int64)
    coded = column.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    return ends - ends[0], coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, documents): the number of rows of `aligned` that hold each link, once or more often.

    Each task sums what it reads before it hands it on. The result has at most one row for each
    pair of ids, whatever the number of documents. Rows without links count nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(summed.keys(), pa.int64()), pa.array(summed.values(), pa.int64())], names=["link", "documents"])

        for batch in batches:
            ends, pairs, place = _flat(batch.column(0))
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            once = pc.unique(pa.array(owner * max(1, len(pairs)) + place)).to_numpy() % max(1, len(pairs))
            for pair, n in zip(pairs.tolist(), np.bincount(once, minlength=len(pairs)).tolist(), strict=True):
                summed[pair] = summed.get(pair, 0) + n
            if len(summed) > MAX_SUMMED:
                yield out()
                summed.clear()
        if summed:
            yield out()

    return aligned.select("links").mapInArrow(run, "link long, documents long").groupBy("link").agg(F.sum("documents").alias("documents"))


def count_blocks(counts: DataFrame, n_ids_b: int, block_pairs: int = BLOCK_PAIRS) -> Iterator[tuple[int, int]]:
    """Ranges of ids of A, from and to, that together hold at most block_pairs counted pairs, or one id.

    One id of A has at most as many pairs as B has ids. The sizes that reach the driver are one per id of A.
    """
    sizes = counts.groupBy(F.expr(f"link div {n_ids_b}").alias("a")).count().orderBy("a").collect()
    start, held = None, 0
    for row in sizes:
        if start is not None and held + row["count"] > block_pairs:
            yield start, row["a"]
            start, held = None, 0
        start = row["a"] if start is None else start
        held += row["count"]
    if start is not None:
        yield start, sizes[-1]["a"] + 1


def weigh(aligned: DataFrame, counts: DataFrame, n_ids_b: int, keys: list[str], block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The columns `keys` of each row with `n_best` and `count_sum` over its links.

    `count_sum` adds the counts of all links, repeated ones each time; `n_best` counts the links
    whose pair is counted as often as any pair of the same id of A. The counts are broadcast in blocks of
    ids of A, at most block_pairs pairs at once. With several blocks, each reads the links of its own
    ids, and `keys` must tell the rows of `aligned` apart; with one, rows need no key and do not move.
    """
    blocks = list(count_blocks(counts, n_ids_b, block_pairs))
    kinds = dict(aligned.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_best long", "count_sum long"])
    parts = [_weigh_block(aligned.select(*keys, "links"), counts, n_ids_b, block, schema) for block in blocks or [(0, 0)]]
    if len(parts) == 1:
        return parts[0]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionAll(part)
    return together.groupBy(*keys).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _weigh_block(aligned: DataFrame, counts: DataFrame, n_ids_b: int, block: tuple[int, int], schema: str) -> DataFrame:
    low, high = block[0] * n_ids_b, block[1] * n_ids_b
    rows = counts.where((F.col("link") >= low) & (F.col("link") < high)).toArrow()
    known, n = rows["link"].to_numpy(), rows["documents"].to_numpy()
    order = np.argsort(known)
    known, n = known[order], n[order]
    _, first, owner = np.unique(known // n_ids_b, return_index=True, return_inverse=True)
    best = n == np.maximum.reduceat(n, first)[owner] if len(n) else np.zeros(0, bool)
    shared = aligned.sparkSession.sparkContext.broadcast((known, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            links = batch.column(batch.num_columns - 1)
            ends, pairs, place = _flat(links)
            inside = (pairs >= low) & (pairs < high)
            at = np.searchsorted(known, pairs[inside])
            per_pair, top = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            per_pair[inside], top[inside] = n[at], best[at]
            n_best, total = (np.diff(np.r_[0, np.cumsum(x[place])][ends]) for x in (top, per_pair))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_best), pa.array(total)], names=[*batch.schema.names[:-1], "n_best", "count_sum"])

    return aligned.mapInArrow(run, schema)


def report(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Groups and links of each document as numbers and a digest; see `align` for odd rows.

    Links are written once and read twice, to count them and to weigh them.
    """
    bound_batches(documents.sparkSession, TEXTS_BYTES)
    made = align(documents.select("doc_id", "text"), path_a, path_b)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = cut_lineage(made.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups",
        F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links"))
    n_ids_b = len(Pieces(path_b).tokens)
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    weighed = weigh(aligned, cut_lineage(link_counts(aligned)), n_ids_b, keys)
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
