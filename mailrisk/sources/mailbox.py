"""Mail sources: message files, base64url exports and mailbox listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_message_files(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """A directory of message files as raw_messages(source_id, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return files.option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("source_id"), "content"
    )


def _decoded(raw: Column) -> Column:
    """Bytes of strict base64url without required padding, or NULL.

    Both alphabets are accepted. Anything else is refused: foreign characters,
    white space, padding beyond the next multiple of four, an impossible length.
    """
    body = F.rtrim(raw, F.lit("="))
    pads = F.length(raw) - F.length(body)
    rest = F.length(body) % 4
    fits = (
        raw.rlike("\\A[A-Za-z0-9+/_\\-]*={0,2}\\z")
        & (rest != 1)
        & ((pads == 0) | ((rest > 0) & (rest + pads <= 4)))
    )
    return F.when(fits, F.try_to_binary(F.translate(body, "-_", "+/"), F.lit("base64")))


def decode_raw(export: DataFrame, col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """export(source_id, raw) to (raw_messages, rejects); failures are transport errors."""
    decoded = export.select("source_id", F.col(col).alias("raw"), _decoded(F.col(col)).alias("content"))
    missing = F.col("raw").isNull() | (F.col("raw") == "")
    good = decoded.where(~missing & F.col("content").isNotNull()).select("source_id", "content")
    rejects = decoded.where(missing | F.col("content").isNull()).select(
        "source_id",
        F.lit("transport").alias("stage"),
        F.when(missing, "no raw payload").otherwise("not valid base64url").alias("reason"),
    )
    return good, rejects


def select_message_ids(
    listing: DataFrame, predicate: Column | str, max_results: int | None = None
) -> DataFrame:
    """Ids of a mailbox listing(pos, id, ...) that fit the predicate, in listing order.

    Entries without an id are skipped and repeats are kept. max_results stops the
    listing; zero or less gives no rows.
    """
    found = listing.where(predicate).where(F.col("id").isNotNull() & (F.col("id") != ""))
    found = found.select("pos", "id").orderBy("pos")
    if max_results is None:
        return found
    return found.limit(max(max_results, 0))
