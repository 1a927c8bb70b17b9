"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHashes that differ in three bits at most give the first candidates (`simhash`). At 0.8 the 64-bit
SimHashes of two texts differ in ten bits on average, too many for keys on them. The other candidates
come from minima of the shingle hashes: 24 keys of five minima each meet with probability 1 - (1 - 0.8^5)^24 > 0.9999 at 0.8, and oftener above. Every
candidate pair is then checked on the exact sets. Links are contracted between four rounds, and
only pairs that are not connected yet go to the next:

    neighbours in each bucket, by the next key: near sets are likely to have that in common too
    neighbours in each bucket, by a hash of key and node
    all pairs of each bucket of at most CROWD nodes
    crowded buckets, block by block

Texts that share most of a common passage crowd a bucket without being near copies. Such a bucket
is dealt in blocks of nodes, and each task compares two blocks with arrays: it hands on the links
that connect what was not connected, so a task gives fewer rows than it reads, whatever the number of
similar pairs. Pairs are compared in the first bucket that they share, and on their exact sets if at
least AGREE of their 120 minima agree: of similar pairs, one in a million has fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm import components, simhash
from mailrisk.llm.common import as_bytes, pieces
from mailrisk.session import cut_lineage, release_memory

SHINGLE = 5
#: Similarity as a fraction, so that the comparison is exact.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 24, 5
#: Shingle hashes whose minima are taken at once, which bounds the memory for any text.
HASHES_AT_ONCE = 4096
#: Bytes of texts whose sets one batch holds.
SETS_BYTES = 4 << 20
#: Word hashes that are kept between texts.
WORDS_KEPT = 1 << 16
#: Pairs of one bucket that a batch holds.
PAIRS_AT_ONCE = 1 << 18
#: Nodes beyond which a bucket is compared in blocks, the nodes of a block on average, and minima that agree.
CROWD, BLOCK, AGREE = 32, 512, 74
#: Parts that the copies of a text are dealt to, when one of them is looked up.
COPIES = 16

_MIX = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word, 42)
        return made


_WORD_HASHES = _Hashes()


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words; a shorter text is one run, and without words none."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([_WORD_HASHES[w] for w in words], np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    made = np.full(n, size, np.uint64)
    for k in range(size):
        made = made * _STEP + hashes[k : k + n]
        made ^= made >> np.uint64(29)
    return np.unique(made)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the BANDS * ROWS mixed orders of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        some = (hashes[None, at : at + HASHES_AT_ONCE] ^ _MIX[0]) * _MIX[1]
        least = np.minimum(least, some.min(axis=1))
    return least


def band_keys(hashes: np.ndarray) -> list[int]:
    """Keys of a set: one for each band of minima, none for the empty set."""
    if not len(hashes):
        return []
    bands = minima(hashes).reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), i)) for i, band in enumerate(bands)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, size, keys, fp): node names the set of shingles, so texts of equal sets are one node; fp is the SimHash."""
    source = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, fps = [], [], [], []
            for text in as_bytes(batch.column(2)):
                found = shingles(text or b"")
                fps.append(_signed(simhash.fingerprint(text or b"")))
                nodes.append(_signed(xxhash.xxh64_intdigest(found.tobytes(), 7)))
                sizes.append(len(found))
                keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())],
                names=["doc_id", "text_hash", "node", "size", "keys", "fp"])

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, text_hash long, node long, size long, keys array<long>, fp long")


# --- links --------------------------------------------------------------------


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, hashes) of texts(node, text): the sorted hashes of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", SETS_BYTES):
                sets = [shingles(t or b"").view(np.int64) for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes array<long>")


def _sets(column: pa.ListArray) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; sets(node, hashes) has the set of each node."""
    one, other = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"hashes_{c}")) for c in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)
            near = pa.array([similar(x, y) for x, y in sides], pa.bool_())
            yield batch.select(["a", "b"]).filter(near)

    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "hashes_a", "hashes_b")
    return joined.mapInArrow(run, "a long, b long")


def _ratio_holds(one: str, other: str) -> F.Column:
    """Sets of sizes further apart than the similarity cannot be similar."""
    return F.least(one, other) * DENOMINATOR >= F.greatest(one, other) * NUMERATOR


def _neighbours(members: DataFrame, *order) -> DataFrame:
    """(a, b) that follow each other in a bucket of members(key, node, size, root), in different components."""
    inside = Window.partitionBy("key").orderBy(*order)
    before = members.select("node", "size", "root", *[F.lag(c).over(inside).alias(f"_{c}") for c in ("node", "size", "root")])
    pairs = before.where((F.col("root") != F.col("_root")) & _ratio_holds("size", "_size"))
    return pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of different components of rows (key, node, size, root) sorted by key. A batch may end inside a bucket."""
    held = np.empty((4, 0), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        cut = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
        if cut:
            yield from _cross_pairs(held[:, :cut])
            held = held[:, cut:]
    yield from _cross_pairs(held)


def _cross_pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    key, node, size, root = rows
    ends = np.searchsorted(key, key, side="right")
    at, step, found, count = np.arange(len(key)), 1, [], 0
    while True:
        at = at[at + step < ends[at]]
        if len(at):
            x, y = size[at], size[at + step]
            use = (root[at] != root[at + step]) & (np.minimum(x, y) * DENOMINATOR >= np.maximum(x, y) * NUMERATOR)
            found.append(np.stack([node[at[use]], node[at[use] + step]]))
            count += int(use.sum())
            step += 1
        if found and (count > PAIRS_AT_ONCE or not len(at)):
            pairs = np.sort(np.concatenate(found, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
            found, count = [], 0
        if not len(at):
            return


def _block_links(rows: pa.Table) -> pa.Table:
    """Links (a, b) that connect different roots, among rows (band, one, other, part, node, root, hashes) of two blocks of a bucket."""
    band, one, other = (rows.column(c)[0].as_py() for c in ("band", "one", "other"))
    part, node, root = (rows.column(c).to_numpy() for c in ("part", "node", "root"))
    sets = [s for chunk in rows.column("hashes").chunks for s in _sets(chunk)]
    least = np.array([minima(s) for s in sets])
    left = np.flatnonzero(part == one)
    right = left if one == other else np.flatnonzero(part == other)
    place = {r: i for i, r in enumerate(np.unique(root).tolist())}
    label = list(range(len(place)))

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    found: list[tuple[int, int]] = []
    for x, y in _candidates(least, root, np.array([len(s) for s in sets]), left, right, band):
        u, v = find(place[root[x]]), find(place[root[y]])
        if u != v and similar(sets[x], sets[y]):
            label[u] = v
            found.append((min(node[x], node[y]), max(node[x], node[y])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _candidates(least, root, size, left, right, band: int) -> Iterator[tuple[int, int]]:
    """Pairs of different roots that may be similar and share no band before this one, those with most minima in common first."""
    agree = np.zeros((len(left), len(right)), np.uint8)
    earlier = np.zeros(agree.shape, bool)
    for b in range(BANDS):
        whole = np.ones(agree.shape, bool)
        for k in range(b * ROWS, b * ROWS + ROWS):
            same = least[left, k][:, None] == least[right, k][None, :]
            agree += same
            whole &= same
        if b < band:
            earlier |= whole
    small, large = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
    use = (agree >= AGREE) & ~earlier & (root[left][:, None] != root[right][None, :]) & (small * DENOMINATOR >= large * NUMERATOR)
    if left is right:
        use &= np.tri(len(left), k=-1, dtype=bool)
    x, y = np.nonzero(use)
    order = np.argsort(-agree[x, y].astype(np.int16), kind="stable")
    return zip(left[x[order]].tolist(), right[y[order]].tolist(), strict=True)


def _crowded_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of buckets of placed(key, band, node, root, n), each dealt in blocks of about BLOCK nodes."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocks = dealt.select("key", "band", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("other"), "part", "node", "root")
    rows = blocks.join(sets, "node")
    return rows.groupBy("key", "band", "one", "other").applyInArrow(_block_links, "a long, b long").distinct()


def simhash_pairs(marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of marked(node, fp) whose SimHashes are equal or linked (`simhash.links`), a < b."""
    pairs = cut_lineage(marked.select("fp", "node").distinct())
    first = cut_lineage(pairs.groupBy("fp").agg(F.min("node").alias("first")))
    equal = pairs.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    one, other = (first.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(c)) for c in ("a", "b"))
    found = simhash.links(first.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    both = equal.union(found.join(one, "fp_a").join(other, "fp_b").select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def roots(sets: DataFrame, texts: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(node, root) of each node that is not the smallest of its component. Pairs `first` (a, b) are compared before all others.

    sets(node, text_hash, size, keys) has the hash of one text of each node, which is looked up in
    texts(text_hash, text, part), where `part` deals copies of a text to COPIES parts.
    """
    keyed = sets.select("node", "size", "keys", F.posexplode("keys").alias("band", "key"))
    keyed = keyed.select("node", "size", "band", "key", F.get("keys", F.pmod(F.col("band") + 1, F.size("keys"))).alias("next"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(keyed.join(shared, "key"))
    nodes = members.select("node")
    if first is not None:
        nodes = nodes.union(first.select("a")).union(first.select("b"))
    wanted = cut_lineage(sets.join(nodes.distinct(), "node").select("node", "text_hash"))
    anywhere = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    found = texts.join(anywhere, ["text_hash", "part"]).dropDuplicates(["node", "part"]).dropDuplicates(["node"])
    near = cut_lineage(shingle_sets(found))
    known, tested, links = None, None, None
    if first is not None:
        # Contracted together with the links of the next round.
        tested, links = first, cut_lineage(verified(first, near))
    for turn in range(4):
        if known is None:
            placed = members.withColumn("root", F.col("node"))
        else:
            placed = members.join(known.withColumnRenamed("root", "_root"), "node", "left").select(
                "key", "band", "next", "node", "size", "n", F.coalesce("_root", "node").alias("root"))
            # Buckets inside one component have nothing left to test.
            open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
            placed = cut_lineage(placed.join(open_, "key"))
        if turn == 3:
            found = cut_lineage(_crowded_links(placed.where(F.col("n") > CROWD), near))
        else:
            if turn == 0:
                pairs = _neighbours(placed, "next", "node")
            elif turn == 1:
                pairs = _neighbours(placed, F.xxhash64("key", "node"), "node")
            else:
                few = placed.where(F.col("n") <= CROWD).select("key", "node", "size", "root")
                pairs = few.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_pairs, "a long, b long").distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = cut_lineage(pairs)
            found = cut_lineage(verified(pairs, near))
            tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        known = components.stars(links)
        release_memory(sets.sparkSession)
    return known


# --- operator -------------------------------------------------------------------


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, root): rows whose texts are linked by steps of similarity 0.8 or more have one root.

    SimHashes of three-word shingles that differ in three bits at most give the first pairs (`simhash.links`); the others
    come from minima. All pairs are checked on the exact sets.
    Null and empty texts are one group. Texts of fewer than five words are near copies of equal ones
    only. Upper and lower case and the spaces between words make no difference. Repeated rows stay.
    """
    marked = cut_lineage(sketches(documents.select("doc_id", "text")))
    sets = cut_lineage(
        marked.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).cast("int")
    found = documents.select(F.xxhash64("text").alias("text_hash"), part.alias("part"), "text").where("text is not null")
    known = roots(sets, found, cut_lineage(simhash_pairs(marked)))
    return marked.join(known, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def deduplicate(documents: DataFrame, write: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """One document of each group: which one, and what happens to odd rows, is as in `simhash.deduplicate`; `write` as in `simhash.one_of_each`."""
    return simhash.one_of_each(documents, groups(documents), write)
