"""As-of merge: for each event the newest record of its key at or before it, without hot groups.

Events and records are one sequence, ordered by key and time, and cut into ranges by quantiles that
Spark samples from the rows themselves: a key or a moment with a third of all rows becomes a third
of the ranges. Each range is scanned once, in order, and carries the last record forward. What a
range inherits is decided by one summary row per range, so records are never copied and no rows are
joined with a table that grows with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from mailrisk.session import cut_lineage

#: Rows of the sequence, in order: _record is null for events, _event for records.
ORDER = ("_key", "_time", "_kind", "_record")


def sequence(events: DataFrame, records: DataFrame, tasks: int) -> DataFrame:
    """events(_key, _time, _event) and records(_key, _time, _record) in sorted ranges of about equal size.

    At one moment records come before events. Rows that are equal up to there are told apart by a
    hash, so that any number of them is spread too.
    """
    def spread(frame: DataFrame, column: str):
        inner = frame.schema[column].dataType
        return F.xxhash64(*[F.col(column)[f.name] for f in inner.fields if isinstance(f.dataType, AtomicType)])

    asked = events.select("_key", "_time", F.lit(1).alias("_kind"), F.lit(None).cast(records.schema["_record"].dataType).alias("_record"), "_event", spread(events, "_event").alias("_hash"))
    known = records.select("_key", "_time", F.lit(0).alias("_kind"), "_record", F.lit(None).cast(events.schema["_event"].dataType).alias("_event"), spread(records, "_record").alias("_hash"))
    merged = asked.unionByName(known).withColumn("_row", F.xxhash64("_hash", F.monotonically_increasing_id()))
    ranges = merged.repartitionByRange(tasks, "_key", "_time", "_kind", "_hash", "_row")
    return ranges.sortWithinPartitions(*ORDER).drop("_hash", "_row")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events with the last record before them in this range, then one row (_opens, _ends, _record, _rows) about the range."""
    number = TaskContext.get().partitionId()
    opens = tail = None  # first key; last key with the record that stands there, as a table of one row
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows += batch.num_rows
        table = pa.Table.from_batches([batch]).select(["_key", "_kind", "_record", "_event"])
        if opens is None:
            opens = table["_key"].slice(0, 1)
        ahead = 0 if tail is None else 1
        if ahead:
            table = pa.concat_tables([tail, table])
        table = table.combine_chunks()
        n, keys = table.num_rows, table["_key"]
        place = np.arange(n)
        change = np.r_[True, pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)]
        group = np.maximum.accumulate(np.where(change, place, 0))
        has = table["_record"].is_valid().to_numpy(zero_copy_only=False).astype(bool)
        last = np.maximum.accumulate(np.where(has, place, -1))
        last = np.where(last >= group, last, -1)
        records = table["_record"].combine_chunks()
        found = records.take(pa.array(last, mask=last < 0))
        first = pc.equal(keys, opens[0]).combine_chunks()
        event = table["_kind"].to_numpy() == 1
        if ahead:
            event[0] = False
        some = pa.array(event)
        events = int(event.sum())
        key_type = keys.type
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(events, number, np.int32)), first.filter(some), table["_event"].combine_chunks().filter(some), found.filter(some),
             pa.nulls(events, key_type), pa.nulls(events, key_type), pa.nulls(events, pa.int64())],
            names=["_range", "_first", "_event", "_record", "_opens", "_ends", "_rows"])
        tail = pa.table({"_key": keys.slice(n - 1), "_kind": table["_kind"].slice(n - 1), "_record": found.slice(n - 1), "_event": table["_event"].slice(n - 1)}, schema=table.schema)
    if tail is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([None], pa.bool_()), pa.nulls(1, tail["_event"].type), tail["_record"].combine_chunks(),
             opens.combine_chunks(), tail["_key"].combine_chunks(), pa.array([rows], pa.int64())],
            names=["_range", "_first", "_event", "_record", "_opens", "_ends", "_rows"])


def scanned(rows: DataFrame) -> DataFrame:
    """The sequence scanned range by range: events, and a summary row of each range (where _rows is not null)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"_range int, _first boolean, _event {kinds['_event']}, _record {kinds['_record']}, _opens {kinds['_key']}, _ends {kinds['_key']}, _rows long"
    return rows.mapInArrow(_scan, schema)


def carried(summary: DataFrame) -> DataFrame:
    """(_range, _carry): the record that the first key of a range has from ranges before it.

    There is one row per range, whatever the number of rows. A key that ends a range and opens the next has
    all ranges between to itself, so the running greatest record by key is what it brings along.
    """
    by_key = Window.partitionBy("_ends").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_range")
    upto = summary.withColumn("_upto", F.max("_record").over(by_key))
    brought = upto.select("_range", "_opens", F.lag("_ends").over(before).alias("_before"), F.lag("_upto").over(before).alias("_carry"))
    return brought.where(F.col("_before") == F.col("_opens")).select("_range", "_carry")


def merge(events: DataFrame, records: DataFrame, tasks: int | None = None) -> DataFrame:
    """(_event, _record) of events(_key, _time, _event) and records(_key, _time, _record), whose keys and times are not null.

    _record is the greatest record of the event's key among those with the latest time at or before it, or null.
    Records begin with their time, so that of equal times the other fields decide. One shuffle; what
    is scanned is written once.
    """
    tasks = tasks or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = cut_lineage(scanned(sequence(events, records, tasks)))
    carry = carried(done.where("_rows IS NOT NULL"))
    # One row per range: bounded by the number of tasks.
    joined = done.where("_rows IS NULL").join(F.broadcast(carry), "_range", "left")
    newest = F.when(F.col("_first"), F.greatest("_record", "_carry")).otherwise(F.col("_record"))
    return joined.select("_event", newest.alias("_record"))
