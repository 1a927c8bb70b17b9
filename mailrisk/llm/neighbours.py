"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling.

Vectors are normalised and turned by a random rotation, after which the distance over the first
d of D dimensions, times D/d, estimates the whole one with an error that falls with the
square root of d. A list is scanned in blocks of columns; after each, the hypothesis that a
candidate is as near as the k-th found is tested, and candidates that fail it are
abandoned. Survivors are scored exactly, in double precision, on the original vectors.

Equal vectors are one candidate with its smallest ids, and equal queries are one search, so a
vector that a third of the rows share is neither a crowded list nor many searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.session import cut_lineage

#: Vectors that the lists are fitted on, at most.
SAMPLE = 20_000
#: Inverted lists, at most; below that their number follows the square root of the rows.
MAX_LISTS = 4096
#: Candidates of one list that one task scans; longer lists are dealt to several.
BLOCK_ROWS = 8192
COLUMNS = 16
#: Width of the hypothesis test: candidates within it are kept.
EPSILON = 2.1
#: What squared distances of unit vectors in single precision may be off by: equal ones stay together.
ROUNDING = 1e-6
#: Share of true neighbours within the sample that the probed lists must hold.
TARGET = 0.98


@dataclass
class Index:
    rotation: np.ndarray  # D x D
    centroids: np.ndarray  # lists x D, rotated and normalised
    probes: int

    def turn(self, vectors: np.ndarray) -> np.ndarray:
        """Normalised in double precision, then rotated."""
        vectors = scaled(vectors)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return unit @ self.rotation

    def lists_of(self, turned: np.ndarray) -> np.ndarray:
        return np.argmax(turned @ self.centroids.T, axis=1)


def fit(sample: np.ndarray, rows: int, neighbours: int, seed: int = 11, rounds: int = 8) -> Index:
    """Lists by k-means on the sphere; as many probes as hold TARGET of the sample's own nearest neighbours."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    rotation, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
    turned = Index(rotation, np.zeros((1, dims)), 1).turn(sample)
    lists = int(min(MAX_LISTS, max(1, round(rows**0.5)), max(1, len(turned) // 8)))
    centroids = turned[rng.choice(len(turned), lists, replace=False)]
    for _ in range(rounds):
        near = _nearest(turned, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, turned)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids)
    near = _nearest(turned, centroids)
    tried = turned[rng.choice(len(turned), min(300, len(turned)), replace=False)]
    needed = []
    for at in range(0, len(tried), 50):
        some = tried[at : at + 50]
        best = np.argsort(-(some @ turned.T), axis=1)[:, 1 : neighbours + 1]
        ranks = np.argsort(np.argsort(-(some @ centroids.T), axis=1), axis=1)
        needed.append(np.take_along_axis(ranks, near[best], axis=1).ravel())
    ranks = np.sort(np.concatenate(needed)) if needed and needed[0].size else np.zeros(1, int)
    probes = int(ranks[min(len(ranks) - 1, int(TARGET * len(ranks)))]) + 1
    return Index(rotation, centroids, min(lists, probes))


def _nearest(turned: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(turned[at : at + 4096] @ centroids.T, axis=1) for at in range(0, len(turned), 4096)])


def scan(query: np.ndarray, columns: list[np.ndarray], wanted: int) -> np.ndarray:
    """Rows of a list that may be among the `wanted` nearest of a query; `columns` are its column blocks.

    The first rows are measured whole and give the first threshold. The rest goes by in chunks;
    of each, the columns are read block by block for the candidates that are still in.
    """
    rows, dims = len(columns[0]), sum(c.shape[1] for c in columns)
    places = np.cumsum([0, *(c.shape[1] for c in columns)])
    parts = [query[i:j] for i, j in zip(places[:-1], places[1:], strict=True)]
    kept, kept_distance, threshold = np.empty(0, np.int64), np.empty(0), np.inf
    start, size = 0, max(4 * wanted, 64)
    while start < rows:
        alive = np.arange(start, min(rows, start + size))
        distance = np.zeros(len(alive))
        for done, (column, part) in enumerate(zip(columns, parts, strict=True), 1):
            distance = distance + np.square(column[alive] - part).sum(axis=1)
            seen = places[done]
            if seen < dims:
                stay = distance * (dims / seen) <= threshold * (1 + EPSILON / np.sqrt(seen)) ** 2
                alive, distance = alive[stay], distance[stay]
        kept, kept_distance = np.r_[kept, alive], np.r_[kept_distance, distance]
        if len(kept) > wanted:
            threshold = np.partition(kept_distance, wanted - 1)[wanted - 1] + ROUNDING
            stay = kept_distance <= threshold
            kept, kept_distance = kept[stay], kept_distance[stay]
        start, size = start + size, 2048
    return kept


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """In double precision, row by row, so that equal vectors have equal scores."""
    query, vectors = scaled(query), scaled(vectors)
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


# --- operators ----------------------------------------------------------------------


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors that take part: not null or empty, every component finite, not all zero."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return found.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(whole).where(F.exists("v", lambda x: x != 0))


def _distinct(valid: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each different vector with its `keep` smallest ids.

    Copies are reduced in each batch, then in groups by vector and a salt, then by vector, so
    that no group holds more than a small part of a crowd's rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[bytes, list[int]] = {}
            first: dict[bytes, int] = {}
            for row, (number, vector) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                key = vector.values.to_numpy(zero_copy_only=False).tobytes()
                first.setdefault(key, row)
                met.setdefault(key, []).append(number)
            ids = [sorted(set(x))[:keep] for x in met.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(first.values(), pa.int32())), pa.array(ids, pa.list_(pa.int64()))], names=["v", "ids"])

    def merged(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))

    reduced = valid.select("id", "v").mapInArrow(run, "v array<double>, ids array<long>")
    salted = reduced.withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(256)))
    return merged(merged(salted, "v", "salt"), "v")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int = SAMPLE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines found for each query among all vectors but its own id.

    Rows: queries and vectors that are null, empty, zero or not finite take no part, nor do those
    of another number of dimensions than the most frequent one, or without id. Ties go to
    the smaller id. Rows repeated with their id count once. A query has fewer than k rows only
    where there are fewer candidates. Lists are fitted on the `sample_rows` vectors with the
    smallest hash; every vector is in the index.
    """
    spark = vectors.sparkSession
    valid, asked = _valid(vectors, id_col, vector_col), _valid(queries, id_col, vector_col)
    distinct = cut_lineage(_distinct(valid, k + 1))
    sizes = distinct.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, rows = sizes["d"], sizes["count"]
    distinct, asked = distinct.where(F.size("v") == dims), asked.where(F.size("v") == dims).distinct()
    sample = distinct.orderBy(F.xxhash64("v"), "v").limit(sample_rows).select("v").toArrow()
    index = fit(_matrix(sample["v"], dims), rows, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = index.lists_of(index.turn(_matrix(batch.column(0), dims)))
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *batch.columns], names=["list", "v", "ids"])

    listed = cut_lineage(distinct.select("v", "ids").mapInArrow(assign, "list int, v array<double>, ids array<long>"))
    counted = listed.groupBy("list").count()
    held = {r["list"]: r["count"] for r in counted.collect()}  # at most MAX_LISTS rows, here and in the broadcast
    blocks = {n: -(-c // block_rows) for n, c in held.items()}
    split = F.broadcast(counted.select("list", F.ceil(F.col("count") / block_rows).alias("blocks")))
    dealt = listed.join(split, "list").withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int")).drop("blocks")
    searches = cut_lineage(asked.groupBy("v").agg(F.min("id").alias("q")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(index.turn(_matrix(batch.column(0), dims)) @ index.centroids.T), axis=1, kind="stable")
            owner, lists, parts = [], [], []
            for i, row in enumerate(order.tolist()):
                reach = 0
                for n, number in enumerate(row):
                    if n >= index.probes and reach > k:
                        break
                    reach += held.get(number, 0)
                    for block in range(blocks.get(number, 0)):
                        owner.append(i)
                        lists.append(number)
                        parts.append(block)
            picked = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int32()), pa.array(parts, pa.int32()), batch.column(1).take(picked), batch.column(0).take(picked)],
                names=["list", "block", "q", "v"])

    probes = searches.select("v", "q").mapInArrow(probe, "list int, block int, q long, v array<double>")

    def scan_list(_, asked_here: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[int, float, list[int]]] = []
        if asked_here.num_rows and candidates.num_rows:
            own = _matrix(candidates["v"], dims)
            turned = index.turn(own).astype(np.float32)
            columns = [np.ascontiguousarray(turned[:, at : at + COLUMNS]) for at in range(0, dims, COLUMNS)]
            ids = candidates["ids"].to_pylist()
            smallest = np.array([some[0] for some in ids])
            wanted = _matrix(asked_here["v"], dims)
            for q, query, around in zip(asked_here["q"].to_pylist(), wanted, index.turn(wanted).astype(np.float32), strict=True):
                near = scan(around, columns, k + 1)
                scores = cosines(query, own[near])
                # Of equal scores the vector with the smaller smallest id goes first, so k + 1 vectors hold the k + 1 first ids.
                for at in np.lexsort((smallest[near], -scores))[: k + 1].tolist():
                    found.append((q, float(scores[at]), ids[near[at]]))
        return pa.table({
            "q": pa.array([f[0] for f in found], pa.int64()), "score": pa.array([f[1] for f in found], pa.float64()),
            "ids": pa.array([f[2] for f in found], pa.list_(pa.int64()))})

    pairs = probes.groupBy("list", "block").cogroup(dealt.groupBy("list", "block")).applyInArrow(
        scan_list, "q long, score double, ids array<long>")
    # Of each search at most (k + 1) vectors per scanned block come together here.
    flat = pairs.select("q", "score", F.explode("ids").alias("vec_id")).select("q", F.struct((-F.col("score")).alias("far"), "vec_id").alias("e"))
    best = flat.groupBy("q").agg(F.slice(F.array_sort(F.collect_set("e")), 1, (k + 1) * (k + 1)).alias("near"))
    named = asked.join(searches, "v").select(F.col("id").alias("query_id"), "q").distinct()
    own = named.join(best, "q").select(
        "query_id", F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "e")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.far")).alias("score"))
