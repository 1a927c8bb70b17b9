"""Packing documents into token sequences: length patterns fitted to the histogram of lengths.

Only the histogram (at most `capacity` counts) reaches the driver. There

1. patterns of a few documents that fill a sequence exactly are enumerated from the lengths present;
2. how often each is used is fitted to the histogram by non-negative least squares;
3. the fit is rounded within the counts, and what is left is packed by best fit, longest
   first, a whole group of equal sequences at a time.

The plan is a list of runs: the documents of one length with ranks from r0 on go to consecutive
sequences at one offset. Documents get their rank among those of their length by
row numbers inside (length, salt) groups of bounded size and the groups' summed counts.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm.common import as_bytes, pieces as byte_pieces
from mailrisk.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Rows that a group of one length and salt holds on average at most.
GROUP_ROWS = 10_000
MAX_WORDS_KEPT = 800_000
TEXT_AT_ONCE = 1 << 21


# --- tokens --------------------------------------------------------------------------


class Kept(dict):
    """What was met before, up to a bound: when it is full, only what is met again goes on."""

    def __init__(self, bound: int | None = None) -> None:
        self.bound, self.older = bound, {}

    def missing(self, keys: set) -> set:
        """Those of the keys that have to be made."""
        if len(self) > (self.bound or MAX_WORDS_KEPT) // 2:
            self.older = dict(self)
            self.clear()
        absent = keys.difference(self)
        again = absent & self.older.keys()
        self.update((key, self.older[key]) for key in again)
        return absent - again


class WordIds:
    """Ids of words by a tokenizer that drops white space and marks word ends: a text's ids are those of its words in a row.

    Words (between ASCII white space) met before are kept up to a bound. A new word is a run of
    letters with punctuation after it in most cases: the letters, in lower case if they are
    ASCII, go to the tokenizer in one text with those of other new words, and its ids are cut
    behind the tokens that end a word. All others are encoded by themselves.
    """

    #: Punctuation that is never part of what the tokenizer splits off together with letters, nor of a special token.
    PUNCTUATION = ".,!?;:%$#&*)]}\""

    def __init__(self, path: str, words_kept: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.words, self.letters, self.others = (Kept(words_kept) for _ in range(3))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.split() for t in texts]
        known, letters, others = self.words, self.letters, self.others
        new = list(known.missing(set(chain.from_iterable(split))))
        # Whole lists at a time: new words are many. A word is letters and the punctuation after them, or all of it is a rest.
        words = [w.decode() for w in new]
        cores = [w.rstrip(self.PUNCTUATION) for w in words]
        rests = [w[len(core) :] if core.isalpha() else w for w, core in zip(words, cores, strict=True)]
        cores = [(core.lower() if core.isascii() else core) if core.isalpha() else "" for core in cores]
        self._learn_letters(letters.missing(set(cores) - {""}))
        self._learn_others(others.missing(set(rests) - {""}))
        letters[""] = others[""] = b""
        known.update(zip(new, [letters[core] + others[rest] for core, rest in zip(cores, rests, strict=True)], strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def _learn_letters(self, new: set[str]) -> None:
        todo = list(new)
        for at in range(0, len(todo), 1024):
            some = todo[at : at + 1024]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            # Every word ends at least once, so as many ends as words means one each.
            if len(ends) == len(some) and ends[-1] == len(ids):
                data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.letters.update(zip(some, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
            else:
                self.letters.update({w: self._alone(w) for w in some})

    def _learn_others(self, new: set[str]) -> None:
        self.others.update({w: self._alone(w) for w in new})

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str, words_kept: int | None = None) -> WordIds:
    """One per worker process."""
    return WordIds(path, words_kept)


def token_pieces(
    documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, words_kept: int | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each whole text's ids and an end id, cut at the capacity.

    A null text counts as empty and is the end id alone. Repeated rows give repeated pieces. Other
    columns are not read. The tokenizer's file must be at `path` on every executor. `words_kept` (MAX_WORDS_KEPT) bounds the words
    whose ids a worker keeps: fewer take less memory and more time.
    """
    source = documents.select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = word_ids(path, words_kept)
        for batch in batches:
            for part in byte_pieces(batch, "text", TEXT_AT_ONCE):
                rows, owner, cut = [], [], []
                for i, ids in enumerate(made.encode([t or b"" for t in as_bytes(part.column(1))])):
                    ids += end
                    for at in range(0, len(ids), step):
                        some = ids[at : at + step]
                        owner.append(i)
                        rows.append((at // step, at // 4, len(some) // 4, zlib.crc32(some)))
                        if with_ids:
                            cut.append(np.frombuffer(some, "<u4").view(np.int32))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [part.column(0).take(pa.array(owner, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(cut, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


# --- the plan ----------------------------------------------------------------------

Pattern = tuple[int, ...]  # lengths, longest first


def patterns(counts: dict[int, int], capacity: int, per_length: int = 12, partners: int = 32) -> list[Pattern]:
    """Patterns of one to four documents, and of one length repeated, that fill a sequence exactly.

    Each length gets at most `per_length`, with partners from the most frequent lengths; those whose
    rarest length is most frequent come first.
    """
    common = sorted(counts, key=lambda n: (-counts[n], n))[:partners]
    duos = [(a + b, a, b) for a, b in combinations_with_replacement(common[:partners // 2], 2)]
    found: set[Pattern] = set()
    for length in counts:
        rest = capacity - length
        options = {(length,)} if rest == 0 else set()
        if rest in counts:
            options.add((length, rest))
        options |= {(length, b, rest - b) for b in common if rest - b in counts}
        options |= {(length, a, b, rest - both) for both, a, b in duos if rest - both in counts}
        times, left = divmod(capacity, length)
        if times > 4 and (not left or left in counts):
            options.add((length,) * times + ((left,) if left else ()))
        ranked = sorted((tuple(sorted(p, reverse=True)) for p in options), key=lambda p: (-min(counts[n] for n in p), p))
        found.update(ranked[:per_length])
    return sorted(found, reverse=True)


def fit(counts: dict[int, int], options: list[Pattern], sweeps: int = 20) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that minimise |A x - counts|^2, by coordinate descent."""
    left = {n: float(c) for n, c in counts.items()}
    parts = [[(n, p.count(n)) for n in sorted(set(p))] for p in options]
    weights = [sum(k * k for _, k in part) for part in parts]
    x = [0.0] * len(options)
    for _ in range(sweeps):
        moved = 0.0
        for i, part in enumerate(parts):
            step = sum(k * left[n] for n, k in part) / weights[i]
            step = max(step, -x[i])
            if step:
                x[i] += step
                for n, k in part:
                    left[n] -= k * step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return np.array(x)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each into the fullest sequence that has room; equal sequences move as one group."""
    rooms: list[int] = []  # rooms of open groups, sorted
    groups: dict[int, list[tuple[Pattern, int]]] = {}

    def add(pattern: Pattern, times: int) -> None:
        room = capacity - sum(pattern)
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((pattern, times))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if todo >= each:
                    add((length,) * each, todo // each)
                if todo % each:
                    add((length,) * (todo % each), 1)
                break
            room = rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            used = min(times, todo)
            if used < times:
                add(pattern, times - used)
            add((*pattern, length), used)
            todo -= used
    return [g for found in groups.values() for g in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY, share: float = 0.8) -> list[tuple[Pattern, int]]:
    """(pattern, times) that hold every document once.

    Patterns take `share` of what the fit gives them: best fit wastes next to nothing as long as it
    has some documents of every length, and the patterns would leave it only what fits badly.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    options = patterns(left, capacity)
    x = fit(left, options)
    done: list[tuple[Pattern, int]] = []
    for i in np.argsort(-x, kind="stable").tolist():
        pattern = options[i]
        # A length that fills a sequence alone has nothing to be mixed with.
        wanted = left[pattern[0]] if len(pattern) == 1 else int(x[i] * share)
        times = min(wanted, *(left[n] // pattern.count(n) for n in set(pattern)), left[pattern[0]])
        if times:
            done.append((pattern, times))
            for n in pattern:
                left[n] -= times
    return [*done, *best_fit(left, capacity)]


def runs(groups: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from the first on take consecutive sequences."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in groups:
        offset = 0
        for length in pattern:
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, offset))
            ranks[length] = first + times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# --- operators ---------------------------------------------------------------------


def pack(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The pieces with `sequence_id` and `offset`; columns of these names are replaced.

    Needs doc_id, piece, ids_crc32 (they order pieces of one length) and length, from 1 to the
    capacity. Offsets are gapless from 0 in every sequence. Repeated rows take places of
    their own. An empty table gives no rows.
    """
    cut = cut_lineage(cut.drop("sequence_id", "offset"))
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    placed = runs(plan(counts, capacity))
    salts = spark.createDataFrame([(n, -(-c // group_rows)) for n, c in counts.items()], "length long, __salts long")
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    salted = cut.join(F.broadcast(salts), "length").withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__salts")))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = sizes.select(
        "length", "__salt", (F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    numbered = salted.withColumn("__row", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)))
    ranked = numbered.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    names = cut.columns
    schema = ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in cut.dtypes), "sequence_id long, offset long"])
    length_at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = placed[:, 0] << 44 | placed[:, 1]
        for batch in batches:
            length, rank = batch.column(length_at).to_numpy(), batch.column(len(names)).to_numpy()
            at = np.searchsorted(starts, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(placed[at, 2] + rank - placed[at, 1]), pa.array(placed[at, 3])],
                names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "__rank").mapInArrow(place, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences of pieces that were made with ids. A group is at most one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
