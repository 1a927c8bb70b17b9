"""Hashed counts of words, word pairs and character n-grams, in one pass over a text.

Terms are hashed where they stand in the bytes: of many short texts at once, of a long text a block
at a time. No term is held as a string of its own beyond the words of one block of a long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex

from mailrisk.functions.exprs import TOKEN

CHAR_SIZES = (3, 4, 5)
#: Characters, and words, that are hashed at once.
CHARS_AT_ONCE, WORDS_AT_ONCE = 1 << 16, 1 << 14
#: Hashes of a text beyond which they are added up by column.
HASHES_HELD = 1 << 19
#: Bytes of texts whose vectors are made at once.
TEXT_AT_ONCE = 1 << 18
WORD = regex.compile(TOKEN)
#: Stands between texts; no byte of UTF-8.
FENCE = 0xFF
# The constants of 32-bit MurmurHash3, and the seed of the feature hash.
C1, C2, C3, C4, C5 = (np.uint32(c) for c in (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35))
SEED = 42


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def murmur3(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, front: int | None = None) -> np.ndarray:
    """Signed 32-bit MurmurHash3 of the byte runs data[start : start + size], each with the byte `front` before it if given."""
    shift = 0 if front is None else 1
    length = sizes + shift
    out = np.full(len(starts), SEED, np.uint32)
    # The four bytes from each place on, as one number; the first block begins with `front`.
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    four = np.ndarray((len(data) + 4,), "<u4", held, 0, (1,))

    def word(rows: np.ndarray, first: int) -> np.ndarray:
        if first == 0 and shift:
            return (four[starts[rows]] << np.uint32(8)) | np.uint32(front)
        return four[starts[rows] + (first - shift)]

    for block in range(int(length.max(initial=0)) // 4 + 1):
        first = 4 * block
        whole = np.flatnonzero(length >= first + 4)
        if len(whole):
            out[whole] = _rotated(out[whole] ^ _mixed(word(whole, first)), 13) * np.uint32(5) + C3
        tail = np.flatnonzero((length > first) & (length < first + 4))
        if len(tail):
            rest = (np.uint32(1) << (8 * (length[tail] - first)).astype(np.uint32)) - np.uint32(1)
            out[tail] ^= _mixed(word(tail, first) & rest)
    return _ended(out, length.astype(np.uint32))


def char_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of 'c' and each run of 3, 4 and 5 characters."""
    most = max(CHAR_SIZES)
    for at in range(0, len(text), CHARS_AT_ONCE):
        part = text[at : at + CHARS_AT_ONCE + most - 1]
        data = np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8)
        edges = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        for size in CHAR_SIZES:
            n = min(CHARS_AT_ONCE, len(edges) - size)
            if n > 0:
                starts = edges[:n]
                yield murmur3(data, starts, edges[size : size + n] - starts, ord("c"))


def word_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of 'w' and each word, and of 'w' and each two words that follow each other, joined by a space."""
    found = (m.group().encode("utf-8", "surrogatepass") for m in WORD.finditer(text))
    before: list[bytes] = []
    while some := list(islice(found, WORDS_AT_ONCE)):
        row = before + some
        # One run of bytes with the words apart by a space: words and pairs are both parts of it.
        data = np.frombuffer(b" ".join(row), np.uint8)
        sizes = np.array([len(w) for w in row], np.int64)
        starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        fresh = len(before)
        yield murmur3(data, starts[fresh:], sizes[fresh:], ord("w"))
        if len(row) > 1:
            yield murmur3(data, starts[:-1], sizes[:-1] + 1 + sizes[1:], ord("w"))
        before = row[-1:]


def counts(text: str, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, counts) of a lower-case text, columns ascending; `features` is their number."""
    held: list[np.ndarray] = []
    total = None
    for hashes in chain(word_hashes(text), char_hashes(text)):
        held.append(hashes)
        if sum(map(len, held)) > HASHES_HELD:
            total, held = _added(total, held, features), []
    if total is None:
        return np.unique(_columns(held, features), return_counts=True)
    total = _added(total, held, features)
    columns = np.flatnonzero(total)
    return columns, total[columns]


def _columns(held: list[np.ndarray], features: int) -> np.ndarray:
    hashes = np.concatenate([np.zeros(0, np.int32), *held])
    if features & (features - 1) == 0:
        return (hashes & np.int32(features - 1)).astype(np.int64)
    return hashes.astype(np.int64) % features


def _added(total: np.ndarray | None, held: list[np.ndarray], features: int) -> np.ndarray:
    more = np.bincount(_columns(held, features), minlength=features)
    return more if total is None else total + more


def batch_columns(texts: list[str], features: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of every term of lower-case texts, repeats included, in no order."""
    # A byte that no text has stands behind each text, so that nothing reaches from one into the next.
    joined = "\0".join([*texts, ""])
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8).copy()
    edges = np.flatnonzero((data & 0xC0) != 0x80)
    fences = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    data[edges[fences]] = FENCE
    text_of = np.zeros(len(data), np.int32)
    text_of[edges[fences[:-1]] + 1] = 1
    text_of = np.cumsum(text_of, dtype=np.int32)
    rows, hashes = [], []
    for at, found in chain(_char_terms(data, edges), _word_terms(joined, data, edges, fences)):
        rows.append(text_of[at])
        hashes.append(found)
    return np.concatenate(rows), _columns(hashes, features)


def _char_terms(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of each run of 3, 4 and 5 characters between fences: runs of ASCII all at once, the others one by one."""
    plain = data < 0x80
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    # The four bytes from each place on, as one number.
    four = np.ndarray((len(data) + 4,), "<u4", held, 0, (1,)).copy()
    n = len(data)
    # 'c' and the first three bytes are a block of the hash, common to the three sizes.
    begun = _rotated(np.uint32(SEED) ^ _mixed((four[:n] << np.uint32(8)) | np.uint32(ord("c"))), 13) * np.uint32(5) + C3
    whole = plain
    for size in range(2, max(CHAR_SIZES) + 1):
        whole = whole[:-1] & plain[size - 1 :]
        if size not in CHAR_SIZES:
            continue
        at = np.flatnonzero(whole)
        rest = four[at + 3] & np.uint32((1 << 8 * (size - 3)) - 1)
        yield at, _ended(begun[at] ^ _mixed(rest), np.uint32(size + 1))
    fenced = np.r_[0, np.cumsum(data == FENCE)]
    for size in CHAR_SIZES:
        starts, ends = edges[:-size], edges[size:]
        wide = np.flatnonzero((ends - starts > size) & (fenced[starts] == fenced[ends]))
        if len(wide):
            yield starts[wide], murmur3(data, starts[wide], ends[wide] - starts[wide], ord("c"))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotated(k * C1, 15) * C2


def _ended(out: np.ndarray, length: np.ndarray | np.uint32) -> np.ndarray:
    out = out ^ length
    out ^= out >> np.uint32(16)
    out *= C4
    out ^= out >> np.uint32(13)
    out *= C5
    out ^= out >> np.uint32(16)
    return out.view(np.int32)


def _word_terms(joined: str, data: np.ndarray, edges: np.ndarray, fences: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of each word, and of each two words of a text that follow each other, joined by a space."""
    letter = _in_word(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"))
    letter[fences] = False
    before = np.r_[False, letter[:-1]]
    first, behind = np.flatnonzero(letter & ~before), np.flatnonzero(~letter & before)
    if not len(first):
        return
    places, ends = edges[first], edges[behind]
    # Words apart by one space: of what stands between two words the first byte is kept, as a space.
    inside = np.zeros(len(data), np.int8)
    inside[places] = 1
    inside[ends] -= 1
    inside = np.cumsum(inside, dtype=np.int8).view(bool)
    kept = inside.copy()
    kept[ends] = True
    row = np.where(inside, data, np.uint8(32))[kept]
    sizes = ends - places
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    yield places, murmur3(row, starts, sizes, ord("w"))
    follows = np.flatnonzero(np.diff(np.searchsorted(fences, first)) == 0)
    if len(follows):
        yield places[follows], murmur3(row, starts[follows], sizes[follows] + 1 + sizes[follows + 1], ord("w"))


#: Of each code point: whether it is part of a word, 2 while it has not been asked.
_LETTERS = np.full(0x110000, 2, np.uint8)


def _in_word(points: np.ndarray) -> np.ndarray:
    found = _LETTERS[points]
    if (found == 2).any():
        for point in np.unique(points[found == 2]).tolist():
            _LETTERS[point] = WORD.fullmatch(chr(point)) is not None
        found = _LETTERS[points]
    return found.astype(bool)


def batch_counts(texts: list[str], features: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """`counts` of each text. Texts beyond TEXT_AT_ONCE are read a block at a time."""
    short = [i for i, t in enumerate(texts) if len(t) <= TEXT_AT_ONCE]
    out: list = [counts(t, features) if len(t) > TEXT_AT_ONCE else None for t in texts]
    if short:
        rows, columns = batch_columns([texts[i] for i in short], features)
        # Half as wide numbers, where they do, are sorted in half the time.
        kind = np.uint32 if len(short) * features <= 1 << 32 else np.int64
        terms = rows.astype(kind) * kind(features) + columns.astype(kind)
        terms.sort()
        fresh = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]][: len(terms)])
        n, terms = np.diff(np.r_[fresh, len(terms)]), terms[fresh].astype(np.int64)
        cuts = np.searchsorted(terms, np.arange(len(short) + 1, dtype=np.int64) * features)
        for at, i in enumerate(short):
            own = slice(cuts[at], cuts[at + 1])
            out[i] = terms[own] - at * features, n[own]
    return out


def weighted_sums(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The sum, for each lower-case text, of its terms' weights; these are one per column."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if len(text) > TEXT_AT_ONCE:
            columns, n = counts(text, len(weights))
            out[i] = weights[columns] @ n
    if any(len(t) <= TEXT_AT_ONCE for t in texts):
        rows, columns = batch_columns([t if len(t) <= TEXT_AT_ONCE else "" for t in texts], len(weights))
        out += np.bincount(rows, weights=weights[columns], minlength=len(texts))
    return out


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with TEXT_AT_ONCE bytes of texts, or one row."""
    sizes = batch.column(column).cast(pa.large_binary())
    ends = np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in sizes])
    start = before = 0
    for at, end in enumerate(ends.tolist()):
        if at > start and end - before > TEXT_AT_ONCE:
            yield batch.slice(start, at - start)
            start, before = at, int(ends[at - 1])
    if start < batch.num_rows:
        yield batch.slice(start)


def sparse_vectors(texts: pa.Array, features: int, weights: np.ndarray | None = None) -> pa.StructArray:
    """The stored form of sparse vectors: counts of each lower-case text, none for null; times its column's weight, if given."""
    found = batch_counts([t.as_py() or "" for t in texts], features)
    ends = pa.array(np.r_[0, np.cumsum([len(c) for c, _ in found], dtype=np.int64)].astype(np.int32))
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    columns, values = (join([pair[i] for pair in found], kind) for i, kind in ((0, np.int32), (1, np.float64)))
    if weights is not None:
        values *= weights[columns]
    n = len(found)
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, features, np.int32)),
         pa.ListArray.from_arrays(ends, pa.array(columns)), pa.ListArray.from_arrays(ends, pa.array(values))],
        names=["type", "size", "indices", "values"])


PACKED = "low binary, high binary, times binary"
MOST_GAP, MOST_TIMES = 65535, 255


def packed(texts: pa.Array, features: int) -> list[pa.Array]:
    """Counts of each lower-case text in three bytes a column: low and high byte of the distance from the column before, and times.

    A distance beyond MOST_GAP takes more entries, of no times; so does a count beyond MOST_TIMES, at distance 0.
    """
    found = batch_counts([t.as_py() or "" for t in texts], features)
    sizes = np.array([len(c) for c, _ in found], np.int64)
    columns, times = (np.concatenate([np.zeros(0, np.int64), *[pair[i] for pair in found]]) for i in (0, 1))
    gaps = np.diff(columns, prepend=0)
    starts = np.r_[0, np.cumsum(sizes)]
    begun = starts[:-1][sizes > 0]
    gaps[begun] = columns[begun]
    far, often = gaps // MOST_GAP, (times - 1) // MOST_TIMES
    if (far + often).any():
        entries = far + often + 1
        ends = np.cumsum(entries)
        term = np.repeat(np.arange(len(entries)), entries)
        at = np.arange(len(term)) - (ends - entries)[term] - far[term]
        gaps = np.where(at < 0, MOST_GAP, np.where(at == 0, (gaps % MOST_GAP)[term], 0))
        times = np.where(at < 0, 0, np.where(at < often[term], MOST_TIMES, (times - MOST_TIMES * often)[term]))
        starts = np.r_[0, ends][starts]
    bounds = pa.py_buffer(starts.astype(np.int32))
    planes = (gaps & 0xFF, gaps >> 8, times)
    return [pa.Array.from_buffers(pa.binary(), len(found), [None, bounds, pa.py_buffer(x.astype(np.uint8))]) for x in planes]


def unpacked(low: pa.Array, high: pa.Array, times: pa.Array, merged: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, counts, entries of each text) of `packed`. A column may come more than once, or zero times, unless `merged`."""
    def plane(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        return data[bounds[0] : bounds[-1]], bounds

    (below, bounds), above, n = plane(low), plane(high)[0], plane(times)[0]
    sizes = np.diff(bounds).astype(np.int64)
    ends = np.cumsum(below + (above.astype(np.int64) << 8))
    columns = ends - np.repeat(np.r_[0, ends][np.r_[0, np.cumsum(sizes)[:-1]]], sizes)
    if not merged:
        return columns, n, sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    fresh = np.flatnonzero(np.r_[True, (np.diff(columns) != 0) | (np.diff(row) != 0)][: len(columns)])
    n = np.add.reduceat(n, fresh, dtype=np.int64) if len(fresh) else n.astype(np.int64)
    kept = fresh[n > 0]
    return columns[kept], n[n > 0], np.bincount(row[kept], minlength=len(sizes))
