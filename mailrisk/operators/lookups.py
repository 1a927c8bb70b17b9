"""Lookups with a time to live, and availability of recorded feeds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.operators import asof
from mailrisk.schemas import INTEL_TTL_S
from mailrisk.session import if_small

MAX_FEEDS = 100_000


def ttl_lookup(
    events: DataFrame,
    lookups: DataFrame,
    key: str,
    event_ts: str,
    fetched_at: str,
    ttl_s: int,
    tasks: int | None = None,
) -> DataFrame:
    """For each event the newest record of its key fetched at or before it, within the TTL.

    Adds the lookup columns; they are NULL when there is no valid record, and for events without key
    or time, which are answered where they are. A record that says "nothing known" is a
    record like any other. Of records fetched at the same time, the greatest by the other
    columns counts. Events and records are merged by time in ranges of equal size (`asof`), `tasks` of
    them, by default as many as there are shuffle partitions.
    """
    payload = [c for c in lookups.columns if c != key]
    at = F.col(fetched_at).cast("timestamp")
    record = F.struct(at.alias("_at"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(payload)])
    records = lookups.where(F.col(fetched_at).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), at.alias("_time"), record.alias("_record"))
    askable = F.col(key).isNotNull() & F.col(event_ts).isNotNull()
    event = F.struct(F.col(event_ts).cast("timestamp").alias("_time"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(events.columns)])
    asked = events.where(askable).select(F.col(key).alias("_key"), F.col(event_ts).cast("timestamp").alias("_time"), event.alias("_event"))
    found = asof.merge(asked, records, tasks)
    age = F.unix_micros("_event._time") - F.unix_micros("_record._at")
    valid = found.withColumn("_record", F.when(age <= ttl_s * 1_000_000, F.col("_record")))
    answered = valid.select(
        *[F.col(f"_event._{i}").alias(c) for i, c in enumerate(events.columns)],
        *[F.col(f"_record._{i}").alias(c) for i, c in enumerate(payload)])
    unanswered = events.where(~askable).select(
        *events.columns, *[F.lit(None).cast(lookups.schema[c].dataType).alias(c) for c in payload])
    return answered.union(unanswered)


def feed_status(
    snapshots: DataFrame, as_of: datetime | Column, ttl_s: int = INTEL_TTL_S, expected: DataFrame | None = None
) -> DataFrame:
    """State of each feed at a moment: feed_status(feed, snapshot_at, newest_ok, usable).

    snapshots(feed, fetched_at, status). The last good snapshot counts even when the
    newest one failed, as long as it is within the TTL. expected(feed) are the feeds there should
    be, by default all that ever had a snapshot; one without a snapshot by then is not usable.
    """
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    good = F.col("status") == "ok"
    known = snapshots.where(F.col("fetched_at") <= moment)
    newest = known.groupBy("feed").agg(
        F.max(F.when(good, F.col("fetched_at"))).alias("snapshot_at"),
        F.max_by(good, "fetched_at").alias("newest_ok"),
    )
    fresh = F.unix_micros(moment.cast("timestamp")) - F.unix_micros(
        F.col("snapshot_at").cast("timestamp")
    )
    wanted = (snapshots if expected is None else expected).select("feed").distinct()
    return wanted.join(newest, "feed", "left").select(
        "feed", "snapshot_at", F.coalesce("newest_ok", F.lit(False)).alias("newest_ok"),
        F.coalesce(fresh <= ttl_s * 1_000_000, F.lit(False)).alias("usable"))


def current_entries(entries: DataFrame, status: DataFrame) -> DataFrame:
    """The rows of each usable feed's last good snapshot: entries(feed, url, fetched_at) by feed_status.

    What a feed listed earlier and lists no more does not match, nor does anything of a feed whose
    last good snapshot is beyond the TTL.
    """
    valid = status.where("usable").select("feed", F.col("snapshot_at").alias("fetched_at"))
    return entries.join(if_small(valid, MAX_FEEDS), ["feed", "fetched_at"], "left_semi")


def intel_available(status: DataFrame) -> DataFrame:
    """One row: can the intelligence layer complete, and if not, why.

    Every feed has to be usable, and there has to be one. A message that was only checked against some of
    the feeds has not been found clean.
    """
    missing = F.array_sort(F.collect_list(F.when(~F.col("usable"), F.col("feed"))))
    return status.agg(missing.alias("missing"), F.count("*").alias("feeds")).select(
        ((F.size("missing") == 0) & (F.col("feeds") > 0)).alias("completed"),
        F.when(F.col("feeds") == 0, F.lit("no feed is expected")).when(
            F.size("missing") > 0, F.concat(F.lit("no usable snapshot: "), F.array_join("missing", ", "))
        ).alias("error"),
    )
