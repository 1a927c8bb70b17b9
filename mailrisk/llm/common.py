"""What the operators share: reading tables, byte views of Arrow columns, batches bounded by bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows that one Arrow batch may bring into a Python worker.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, bounded for Arrow: long texts give batches of fewer rows."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession, max_bytes: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose texts hold at most limit bytes, or a single row."""
    sizes = [len(x or b"") for x in as_bytes(batch.column(column))]
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def held_out(doc_id) -> F.Column:
    """True for the fold that no label is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def crc_text(value) -> int:
    return zlib.crc32(str(value).encode())


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most `rows` labelled training texts of at most `max_bytes` bytes each, with their label.

    The rows are those with the smallest hash of their id, so the sample is the same at
    every run. Held-out rows and rows without a label or id take no part. A document with
    several different labels counts by its largest. Both bounds are parameters of the
    classifiers; nothing else about a corpus is sampled.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    texts = documents.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "text")
    sizes = texts.select("doc_id").join(ids, "doc_id")
    chosen = sizes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    # At most `rows` ids and labels: bounded, so the texts need no shuffle.
    found = texts.join(F.broadcast(chosen), "doc_id")
    got = found.select("doc_id", "label", "text").limit(2 * rows).toArrow()
    order = sorted(zip(got["doc_id"].to_pylist(), got["text"].to_pylist(), got["label"].to_pylist(), strict=True))
    return [(text, label) for _, text, label in order]
