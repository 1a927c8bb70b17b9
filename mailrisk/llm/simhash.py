"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

The perfect Golay code of length 23 puts every 23-bit word within three bits of exactly one of
4096 codewords. The keys of a segment are the indices of the codewords that the word
and its one-bit neighbours decode to: one key, or six. Two segments that differ in at
most two bits have a neighbour in common, and so a key.

A fingerprint of 64 bits is cut into segments A and B of 23 bits and C of 18. With
three errors in all, (a, b, c) per segment, these keys meet in every case:

    exact A, fuzzy B                 a = 0, b <= 2
    fuzzy A, exact B                 b = 0, a <= 2
    exact B, exact C                 a = 3
    exact A, exact C                 b = 3
    fuzzy A, exact C                 c = 0, a <= 2
    fuzzy A, half of B, half of C    a <= 2, b <= 1, c <= 1

Each has 30 bits or more. Fingerprints with a common key are verified, and links contracted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm import components
from mailrisk.llm.common import as_bytes
from mailrisk.session import MAX_BROADCAST_BYTES, cut_lineage

#: Bits of the segments, from the lowest.
A_BITS = B_BITS = 23
C_BITS = 18
MAX_BITS = 3
#: Buckets of more distinct fingerprints than this are linked by neighbour balls, see `_ball_links`.
BUCKET_LIMIT = 4096
#: Keys that may be broadcast.
FEW_KEYS = 500_000
#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Shingle hashes that are counted at once, which bounds the memory for any text.
HASHES_AT_ONCE = 1 << 17


# --- fingerprints ---------------------------------------------------------------


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of lower-cased ASCII-space separated words; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    lows, highs = starts[:n].tolist(), (ends[-n:] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        some = zip(lows[at : at + HASHES_AT_ONCE], highs[at : at + HASHES_AT_ONCE], strict=True)
        hashes = np.array([digest(joined[i:j], 42) for i, j in some], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp long) of whole texts; null counts as empty. text_hash tells rows of one id apart."""
    source = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t or b"", shingle) for t in as_bytes(batch.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made.view(np.int64))], names=["doc_id", "text_hash", "fp"]
            )

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, text_hash long, fp long")


# --- Golay keys -------------------------------------------------------------------


@lru_cache(maxsize=1)
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 12-bit message, and the error pattern of at most three bits of each syndrome."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    remainders = np.array([remainder(m << 11) for m in range(4096)], np.int64)
    errors = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            errors[remainders[pattern >> 11] ^ (pattern & 2047)] = pattern
    return remainders, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    remainders, errors = _decoder()
    return (words ^ errors[remainders[words >> 11] ^ (words & 2047)]) >> 11


def fuzzy_indices(words: np.ndarray, bits: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """(n x k indices, n x k marks of those to use): codewords of each word and of its one-bit neighbours."""
    flips = np.r_[0, 1 << np.arange(bits)]
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    return found, np.c_[np.ones(len(words), bool), found[:, 1:] != found[:, :-1]]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint (int64 or uint64)."""
    fps = fps.astype(np.uint64)
    a = (fps & np.uint64((1 << A_BITS) - 1)).astype(np.int64)
    b = (fps >> np.uint64(A_BITS) & np.uint64((1 << B_BITS) - 1)).astype(np.int64)
    c = (fps >> np.uint64(A_BITS + B_BITS)).astype(np.int64)
    near_a, use_a = fuzzy_indices(a)
    near_b, use_b = fuzzy_indices(b)
    rows, keys = [], []

    def add(kind: int, exact: np.ndarray, near: np.ndarray | None = None, use: np.ndarray | None = None) -> None:
        if near is None:
            rows.append(np.arange(len(fps)))
            keys.append(exact | kind << 59)
        else:
            row, at = np.nonzero(use)
            rows.append(row)
            keys.append((exact[row] << 12 | near[row, at]) | kind << 59)

    add(0, a, near_b, use_b)
    add(1, b, near_a, use_a)
    add(2, b << C_BITS | c)
    add(3, a << C_BITS | c)
    add(4, c, near_a, use_a)
    for i, half_b in enumerate((b & 4095, b >> 12)):
        for j, half_c in enumerate((c & 511, c >> 9)):
            add(5 + 2 * i + j, half_b << 9 | half_c, near_a, use_a)
    return np.concatenate(rows), np.concatenate(keys)


# --- links --------------------------------------------------------------------


def links(distinct: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): enough for every component at MAX_BITS, none longer.

    A key of two fingerprints is verified from the smallest and largest of its group, in
    the aggregation. Larger buckets are regrouped by key and reduced to a spanning forest
    inside their task. Buckets above the limit are never gathered.
    """
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy()
                row, key = golay_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(expand, "key long, fp long")
    buckets = cut_lineage(
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = buckets.where(F.col("n") == 2).where(near).select("a", "b")
    members = cut_lineage(keyed.join(buckets.where("n > 2").select("key", "n"), "key"))
    cold = members.where(F.col("n") <= bucket_limit).select("key", "fp").repartition("key").sortWithinPartitions("key")
    hot = members.where(F.col("n") > bucket_limit).select("fp").distinct()
    found = pairs.union(cold.mapInArrow(_bucket_links, "a long, b long"))
    return cut_lineage(found.union(_ball_links(hot)).distinct())


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the near pairs of rows sorted by key. A batch may end inside a bucket."""
    held = np.empty((2, 0), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], axis=1)
        cut = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
        if cut:
            yield _forest(held[:, :cut])
            held = held[:, cut:]
    yield _forest(held)


def _forest(rows: np.ndarray) -> pa.RecordBatch:
    key, fp = rows
    ends = np.searchsorted(key, key, side="right")
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    at, step = np.arange(len(key)), 1
    new_a, new_b, held = [a], [b], 0
    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            break
        other = at + step
        near = np.bitwise_count((fp[at] ^ fp[other]).view(np.uint64)) <= MAX_BITS
        new_a.append(fp[at[near]])
        new_b.append(fp[other[near]])
        held += int(near.sum())
        if held > 1 << 20:
            a, b = components.local_roots(np.concatenate(new_a), np.concatenate(new_b))
            new_a, new_b, held = [a], [b], 0
        step += 1
    a, b = components.local_roots(np.concatenate(new_a), np.concatenate(new_b))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _ball_links(hot: DataFrame) -> DataFrame:
    """Links of fingerprints in crowded buckets, in work and rows that grow with their number only.

    All fingerprints within one bit of a word u are within two bits of each other, and those within
    two bits of u are within three of them. So each u that has one within one bit links all
    within two bits to the smallest of these; every pair at distance three or less meets at some u.
    """
    one = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)]
    two = np.array([1 << i | 1 << j for i, j in combinations(range(64), 2)], dtype=np.uint64)

    def ball(masks: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    fps = batch.column(0).slice(at, 64).to_numpy()
                    words = (fps.view(np.uint64)[:, None] ^ masks[None, :]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(fps, len(masks)))], names=["u", "fp"])
        return run

    inner = hot.mapInArrow(ball(one), "u long, fp long")
    outer = inner.union(hot.mapInArrow(ball(two), "u long, fp long"))
    centre = inner.groupBy("u").agg(F.min("fp").alias("b"))
    return outer.join(centre, "u").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


# --- operators ------------------------------------------------------------------


def near_duplicates(documents: DataFrame, shingle: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): documents whose fingerprints are linked by steps of at most three bits.

    root is the smallest fingerprint of the component, component_id the smallest doc_id reachable, itself included. Equal fingerprints are
    one node, so a group of copies costs as much as one document. Null and empty texts have
    fingerprint zero and are linked like any other. A null doc_id is larger than any other: it
    names a component only if no other row of it has an id. Repeated rows stay. Empty tables
    give no rows; other columns are not read.
    """
    marked = cut_lineage(fingerprints(documents, shingle))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components.stars(links(distinct, bucket_limit)).withColumnRenamed("node", "fp")
    linked = cut_lineage(roots.union(roots.select(F.col("root").alias("fp"), "root").distinct()))
    named = linked.join(distinct, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    whole = distinct.join(linked, "fp", "left").join(named, "root", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    return marked.join(whole, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_fingerprint(fp="fp") -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint")


def deduplicate(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, of equal ids the smallest text hash.

    The columns are those of the input. Exact repeats of the row that stays go too. Rows with
    a null doc_id stay only where nothing in their component has an id.
    """
    return one_of_each(documents, near_duplicates(documents, shingle))


def _broadcast_few(keys: DataFrame) -> DataFrame:
    """The keys, to be broadcast if they are counted to be few."""
    size = keys.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col("__id").cast("string"))).alias("bytes")).first()
    return F.broadcast(keys) if size["rows"] <= FEW_KEYS and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES else keys


def one_of_each(documents: DataFrame, groups: DataFrame, write: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """The document with the smallest doc_id of each root, then the smallest text hash, of groups(doc_id, text_hash, root).

    `write` writes the only table that the result reads besides `documents`.
    """
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    stay = groups.groupBy("root").agg(smallest.alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.text_hash").alias("_hash"))
    rows = groups.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("n"))
    found = rows["__id"].eqNullSafe(stay["_id"]) & (rows["__hash"] == stay["_hash"])
    place = rows.join(stay, found, "left").select("__id", "__hash", "n", F.col("_hash").isNotNull().alias("stays"))
    # Texts need no shuffle where few rows go: what goes is looked up, not what stays.
    place = write(place.where("not stays or n > 1"))
    gone, repeated = (_broadcast_few(rows.select("__id", "__hash")) for rows in (place, place.where("stays")))
    source = documents.withColumn("__hash", F.xxhash64("text")).withColumnRenamed("doc_id", "__id")

    def same(keys: DataFrame) -> F.Column:
        return source["__id"].eqNullSafe(keys["__id"]) & (source["__hash"] == keys["__hash"])

    kept = source.join(gone, same(gone), "left_anti")
    once = source.join(repeated, same(repeated), "left_semi").dropDuplicates(["__id", "__hash"])
    return kept.unionAll(once).withColumnRenamed("__id", "doc_id").select(*documents.columns)
