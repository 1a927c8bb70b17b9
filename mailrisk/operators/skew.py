"""Joins and running sums that hold when one key has a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailrisk.session import cut_lineage, is_small

# Beyond this many rows (or the byte bound of a broadcast) the right side is joined by a shuffle.
SMALL_ROWS = 200_000
# A key is hot when it holds more than this part of a mean task's rows.
HOT_PART = 0.25


def hot_keys(counts: DataFrame, key: str, tasks: int, total: int | None = None) -> DataFrame:
    """Keys of counts(key, n) with more than HOT_PART of a mean task's rows: fewer than tasks / HOT_PART. `total` is the sum of n."""
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > max(1.0, HOT_PART * total / tasks)).select(key)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    small_rows: int = SMALL_ROWS,
    counts: DataFrame | None = None,
    written: bool = False,
) -> DataFrame:
    """Left join to a table with one row per key, safe for hot keys on the left.

    A right side that is counted to be small is broadcast, and the left is not shuffled. For a larger
    one the left is written once. Its hot keys are fewer than tasks / HOT_PART, so their
    right rows are broadcast; rows of hot keys and rows without a key are answered where
    they are and take no part in the shuffled join of the others. `counts` (key, n) gives the
    keys' numbers, of a written table, where they need not be counted on `left`; `written` says that both sides only
    read written tables, which need not be written again.
    """
    payload = [c for c in right.columns if c != key]
    packed = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.struct(*payload).alias("_found"))

    def answered(rows: DataFrame, by: DataFrame) -> DataFrame:
        joined = rows.join(by, F.col(key) == F.col("_key"), "left")
        return joined.select(*[F.col(c) for c in left.columns], *[F.col("_found")[c].alias(c) for c in payload])

    if is_small(packed, small_rows, written=written):
        return answered(left, F.broadcast(packed))
    left = left if written else cut_lineage(left)
    known = F.col(key).isNotNull()
    total = None
    if counts is None:
        total = left.where(known).count()
        counts = left.where(known).groupBy(key).agg(F.count("*").alias("n"))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(cut_lineage(hot_keys(counts, key, tasks, total).withColumnRenamed(key, "_hot_key")))
    same = F.col(key) == F.col("_hot_key")
    crowded = left.where(known).join(hot, same, "left_semi")
    others = left.where(known).join(hot, same, "left_anti")
    few = F.broadcast(packed.join(hot, F.col("_key") == F.col("_hot_key"), "left_semi"))
    without = left.where(~known).select(
        *left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in payload])
    return answered(crowded, few).union(answered(others, packed)).union(without)


def running_total(
    df: DataFrame, group: list[str], order: Column, bucket: Column, values: list[str]
) -> DataFrame:
    """Add before_<value>, the sum over rows of the group that sort before this one, and all_<value>.

    `bucket` is a coarse integer that agrees with `order`, from a bounded range. Each
    bucket gets one row in front that carries the sum of the buckets before it, so a
    window holds one bucket of rows, or one row per bucket, and never a whole group.
    `df` is read twice; pass a written table when it is expensive.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_front", F.lit(False))
    totals = rows.groupBy(*group, "_bucket").agg(*[F.sum(v).alias(v) for v in values])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    fronts = totals.select(
        *group,
        "_bucket",
        F.lit(True).alias("_front"),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in values],
        *[F.sum(v).over(whole).alias(f"all_{v}") for v in values],
    )
    merged = rows.unionByName(fronts, allowMissingColumns=True)
    in_bucket = Window.partitionBy(*group, "_bucket").orderBy(F.col("_front").desc(), order)
    before = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = merged.select(
        *df.columns,
        "_front",
        *[F.sum(v).over(before).alias(f"before_{v}") for v in values],
        *[F.first(f"all_{v}").over(upto).alias(f"all_{v}") for v in values],
    )
    return summed.where(~F.col("_front")).drop("_front")
