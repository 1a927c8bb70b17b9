"""Substring dedup: word windows that also start in a document with a smaller id are removed.

Identical windows of `window` words hold the same smallest hash of their word 8-grams (their
minimizer), so the minimizer tells which shard a window belongs to. Three steps:

1. Each document gives its distinct minimizers, about one per 22 words. Those of a single
   document cannot belong to a repeated window and end here.
2. The other stretches (runs of windows with one minimizer) are reduced to distinct texts
   with their smallest document, and dealt to shards by minimizer.
3. Each shard builds a compressed FM-index of its stretches. Streaming them through it by
   backward search gives the matching statistics: for each window, the suffixes that
   begin with it, and the smallest document among them.

A minimizer with more than `crowd` distinct stretches (a passage of very many documents, each
with its own surroundings) would overfill its shard; its windows are compared by a 128-bit hash
in an aggregation with partial minima instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.common import as_bytes
from mailrisk.llm.fm_index import FmIndex
from mailrisk.session import cut_lineage, passing_tables

WINDOW = 50
GRAM = 8
#: Windows of one stretch at most, so that no row is longer than window + STRETCH words.
STRETCH = 64
#: Distinct stretches of one minimizer that a shard takes.
CROWD = 2048
#: Words that a shard holds on average.
SHARD_WORDS = 200_000
MAX_WORDS_KEPT = 200_000

Stretch = tuple[int, int, int]  # minimizer, first window, number of windows


class _WordHashes(dict):
    """64-bit hashes of words met before, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS_KEPT:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


_HASHES = _WordHashes()


def minimizers(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The smallest mixed hash of the 8-grams of each window (int64), one per window."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    gram = min(GRAM, window)
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    count = len(words) - gram + 1
    mixed = one[:count].copy()
    for i in range(1, gram):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += one[i : i + count]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(factor)
    mixed ^= mixed >> np.uint64(32)
    least, width, span = mixed.view(np.int64), 1, window - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def stretches(least: np.ndarray, wanted: np.ndarray) -> list[Stretch]:
    """Runs of windows with one minimizer, of those wanted, cut at STRETCH windows."""
    if not len(least) or not len(wanted):
        return []
    edges = np.flatnonzero(np.r_[True, least[1:] != least[:-1], True])
    out = []
    for begin, end, use in zip(edges[:-1].tolist(), edges[1:].tolist(), np.isin(least[edges[:-1]], wanted).tolist(), strict=True):
        if use:
            out += [(int(least[begin]), i, min(STRETCH, end - i)) for i in range(begin, end, STRETCH)]
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# --- the three steps ------------------------------------------------------------------


def _survey(documents: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, whole_sha256, minimizers) of each row."""
    source = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, least = [], [], []
            for text in as_bytes(batch.column(2)):
                words = (text or b"").split()
                sizes.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                least.append(np.unique(minimizers(words, window)))
            offsets = np.r_[0, np.cumsum([len(x) for x in least], dtype=np.int64)].astype(np.int32)
            values = np.concatenate(least) if least else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))],
                names=["doc_id", "text_hash", "n_words", "whole_sha256", "minimizers"])

    return source.mapInArrow(
        run, f"doc_id {dict(source.dtypes)['doc_id']}, text_hash long, n_words long, whole_sha256 string, minimizers array<long>")


def _suspects(documents: DataFrame, surveyed: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, words, stretches) of rows with a minimizer that another document has too."""
    each = surveyed.where(F.col("doc_id").isNotNull()).select("doc_id", "text_hash", F.explode("minimizers").alias("m"))
    shared = each.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("m")
    wanted = each.join(shared, "m").groupBy("doc_id", "text_hash").agg(F.collect_set("m").alias("wanted"))
    source = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(wanted, ["doc_id", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = [], []
            for text, ms in zip(as_bytes(batch.column("text")), batch.column("wanted"), strict=True):
                words = (text or b"").split()
                found = stretches(minimizers(words, window), ms.values.to_numpy(zero_copy_only=False))
                joined = b" ".join(words)
                texts.append(joined)
                at = _word_places(words)
                lists.append([
                    {"m": m, "begin": i, "n": n, "h": _signed(xxhash.xxh64_intdigest(joined[at[i] : at[i + n + window - 1] - 1], 7))}
                    for m, i, n in found
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(texts, pa.binary()), pa.array(lists, pa.list_(kind))],
                names=["doc_id", "text_hash", "words", "stretches"])

    kind = pa.struct([("m", pa.int64()), ("begin", pa.int32()), ("n", pa.int32()), ("h", pa.int64())])
    return source.select("doc_id", "text_hash", "text", "wanted").mapInArrow(
        run, f"doc_id {dict(source.dtypes)['doc_id']}, text_hash long, words binary, "
             "stretches array<struct<m:bigint,begin:int,n:int,h:bigint>>")


def _word_places(words: list[bytes]) -> list[int]:
    """Where each word begins in the words joined by single bytes, and one past the end plus one."""
    return np.r_[0, np.cumsum([len(w) + 1 for w in words], dtype=np.int64)].tolist()


def _distinct_stretches(suspects: DataFrame, window: int) -> DataFrame:
    """(m, h, words, owner, last_owner): each distinct stretch with the smallest and largest document that has it."""
    source = suspects.select("doc_id", "words", "stretches")
    id_kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[tuple[int, int], list] = {}
            for doc_id, joined, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = _word_places(joined.split())
                for s in found:
                    known = met.get((s["m"], s["h"]))
                    if known is None:
                        met[s["m"], s["h"]] = [doc_id, doc_id, joined[at[s["begin"]] : at[s["begin"] + s["n"] + window - 1] - 1]]
                    else:
                        known[0], known[1] = min(known[0], doc_id), max(known[1], doc_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in met], pa.int64()), pa.array([k[1] for k in met], pa.int64()),
                 pa.array([v[2] for v in met.values()], pa.binary()),
                 pa.array([v[0] for v in met.values()], batch.schema.field(0).type),
                 pa.array([v[1] for v in met.values()], batch.schema.field(0).type)],
                names=["m", "h", "words", "owner", "last_owner"])

    each = source.mapInArrow(run, f"m long, h long, words binary, owner {id_kind}, last_owner {id_kind}")
    return each.groupBy("m", "h").agg(
        F.min("owner").alias("owner"), F.max("last_owner").alias("last_owner"), F.first("words").alias("words"))


def _indexed(distinct: DataFrame, shards: int, window: int) -> DataFrame:
    """(m, h, owners): the smallest document of each window, by one FM-index per shard."""
    id_kind = dict(distinct.dtypes)["owner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = pa.Table.from_batches(held)
        sequences = [w.split(b" ") for w in shard["words"].to_pylist()]
        owners = shard["owner"].to_numpy().astype(np.int64)
        found = FmIndex(sequences, owners, window).matching_statistics()
        offsets = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int64()))
        made = pa.table([shard["m"], shard["h"], lists], names=["m", "h", "owners"])
        yield from made.to_batches()

    placed = distinct.select("m", "h", "words", "owner").repartition(shards, "m")
    return placed.mapInArrow(run, "m long, h long, owners array<long>").withColumn("owners", F.col("owners").cast(f"array<{id_kind}>"))


def _compared(crowded: DataFrame, window: int) -> DataFrame:
    """The same for crowded minimizers: every window by two hashes, with partial minima before the shuffle."""
    id_kind = dict(crowded.dtypes)["owner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m, h, joined, owner in zip(*(batch.column(c).to_pylist() for c in ("m", "h", "words", "owner")), strict=True):
                at = _word_places(joined.split(b" "))
                for i in range(len(at) - window):
                    digest = xxhash.xxh128_digest(joined[at[i] : at[i + window] - 1])
                    rows.append((m, h, i, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), owner))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), batch.schema.field("owner").type]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["m", "h", "place", "a", "b", "owner"])

    windows = crowded.select("m", "h", "words", "owner").mapInArrow(run, f"m long, h long, place int, a long, b long, owner {id_kind}")
    least = windows.groupBy("a", "b").agg(F.min("owner").alias("least"))
    placed = windows.join(least, ["a", "b"]).groupBy("m", "h").agg(F.array_sort(F.collect_list(F.struct("place", "least"))).alias("w"))
    return placed.select("m", "h", F.col("w.least").alias("owners"))


def repeated_windows(
    documents: DataFrame, window: int = WINDOW, crowd: int = CROWD, shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(surveyed rows, suspect rows, spans): spans holds (doc_id, text_hash, spans) with the windows to remove,
    as an array of (begin, n) runs of n windows from window `begin` on."""
    documents = documents.select("doc_id", "text")
    surveyed = cut_lineage(_survey(documents, window))
    suspects = cut_lineage(_suspects(documents, surveyed, window))
    distinct = cut_lineage(_distinct_stretches(suspects, window))
    counts = distinct.groupBy("m").agg(F.count("*").alias("n"))
    crowds = cut_lineage(counts.where(F.col("n") > crowd).select("m"))
    sized = suspects.select(F.explode("stretches.n").alias("n")).agg(F.sum(F.col("n") + window - 1)).first()[0]
    shards = max(1, -(-int(sized or 0) // shard_words))
    found = _indexed(distinct.join(crowds, "m", "left_anti"), shards, window).union(
        _compared(distinct.join(crowds, "m", "left_semi"), window))
    # A stretch of one document whose windows no smaller document has needs no answer.
    kept = found.join(distinct.select("m", "h", "owner", "last_owner"), ["m", "h"]).where(
        (F.array_min("owners") < F.col("owner")) | (F.col("owner") < F.col("last_owner"))).select("m", "h", "owners")
    placed = suspects.select("doc_id", "text_hash", F.explode("stretches").alias("s")).select("doc_id", "text_hash", "s.*").distinct()
    runs = F.when(F.array_max("owners") < F.col("doc_id"), F.array(F.struct("begin", "n"))).otherwise(
        F.expr("filter(transform(owners, (o, i) -> if(o < doc_id, struct(begin + i as begin, 1 as n), null)), x -> x is not null)"))
    spans = (
        placed.join(cut_lineage(kept), ["m", "h"]).where(F.array_min("owners") < F.col("doc_id"))
        .select("doc_id", "text_hash", runs.alias("runs"))
        .groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("spans"))
    )
    return surveyed, suspects, spans


# --- operators ------------------------------------------------------------------


def _kept_words(joined: bytes, spans: list[dict], window: int) -> tuple[bytes, int]:
    """The words that no removed window covers, joined by a space, and how many are gone."""
    words = joined.split()
    change = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        change[s["begin"]] += 1
        change[s["begin"] + s["n"] + window - 1] -= 1
    stay = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, keep in zip(words, stay.tolist(), strict=True) if keep]), int((~stay).sum())


def report(documents: DataFrame, window: int = WINDOW, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row.

    Null texts have no words. Rows of one doc_id are one document's versions: none takes words from
    the other. A row without doc_id is neither judged nor compared with. Empty tables give no
    rows; other columns are not read.
    """
    surveyed, suspects, spans = repeated_windows(documents, window, crowd, shard_words)
    spans = cut_lineage(spans)
    id_kind = dict(surveyed.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_kept_words(w, s, window) for w, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())],
                names=["doc_id", "text_hash", "n_removed", "kept"])

    changed = suspects.join(spans, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "words", "spans").mapInArrow(
        run, f"doc_id {id_kind}, text_hash long, n_removed long, kept string").dropDuplicates(["doc_id", "text_hash"])
    return surveyed.join(changed, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept", "whole_sha256").alias("kept_sha256"))


def deduplicate(documents: DataFrame, window: int = WINDOW, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents without repeated passages. All rows and columns stay.

    A text that loses words becomes its other words joined by single spaces, and its `n_chars` (if
    there) is counted anew; every other text is unchanged to the byte.
    """
    with passing_tables(documents.sparkSession) as lasting:
        spans = lasting(repeated_windows(documents, window, crowd, shard_words)[2])
    names = documents.columns
    marked = documents.withColumn("__hash", F.xxhash64("text"))
    marks = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), F.col("spans").alias("__spans"))
    joined = marked.join(marks, (marked["doc_id"] == marks["__id"]) & (marked["__hash"] == marks["__text"]), "left")
    place = names.index("text")
    schema = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if s is None else _kept_words(t, s, window)[0]
                     for t, s in zip(as_bytes(batch.column(place)), batch.column(len(names)).to_pylist(), strict=True)]
            columns = list(batch.columns)[: len(names)]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = joined.select(*[documents[n] for n in names], "__spans").mapInArrow(run, schema)
    if "n_chars" in names:
        kind = dict(documents.dtypes)["n_chars"]
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*names)
    return kept


def sql(window: int = WINDOW) -> str:
    """The same report as DuckDB SQL over `documents`."""
    return f"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT r, doc_id, i, hash(array_to_string(w[i : i + {window - 1}], ' ')) AS h, md5(array_to_string(w[i : i + {window - 1}], ' ')) AS k
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM words WHERE doc_id IS NOT NULL AND len(w) >= {window})),
first_of AS MATERIALIZED (SELECT h, k, min(doc_id) AS owner FROM windows GROUP BY h, k),
hit AS (SELECT r, i FROM windows JOIN first_of USING (h, k) WHERE owner < doc_id),
gone AS (SELECT r, list(DISTINCT p) AS places FROM (SELECT r, unnest(range(i, i + {window})) AS p FROM hit) GROUP BY r),
kept AS (
  SELECT words.r, doc_id, w, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, p: NOT list_contains(places, p)) END AS stay
  FROM words LEFT JOIN gone USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(stay, ' ')) AS kept_sha256
FROM kept"""
