"""Stored assessments: write them, and read the latest per message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_assessments(assessments: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by level. A message without a score keeps a NULL level partition."""
    assessments.write.mode(mode).partitionBy("level").parquet(path)


def latest_assessments(assessments: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest assessment of each message, newest first.

    The newest row is a maximum, so repeats of a message are reduced before the
    shuffle and a message that was scored very often costs one row per task.
    """
    others = [c for c in assessments.columns if c not in ("message_id", "scored_at")]
    newest = assessments.groupBy("message_id").agg(
        F.max(F.struct("scored_at", *others)).alias("newest")
    )
    ordered = newest.select("message_id", "newest.*").select(*assessments.columns).orderBy(
        F.col("scored_at").desc(), "message_id"
    )
    return ordered if limit is None else ordered.limit(limit)


def as_json(assessments: DataFrame) -> DataFrame:
    """Assessments as JSON text, one object per message."""
    return assessments.select("message_id", F.to_json(F.struct(*assessments.columns)).alias("json"))
