"""Joins and running sums against plain loops, with hot keys, ties and missing keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailrisk import session
from mailrisk.operators import asof, lookups, skew


def largest_share(frame):
    """Rows of the fullest task over the mean of all, as a plan's last stage deals them."""
    sizes = [r["n"] for r in frame.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / (sum(sizes) / len(sizes))


@pytest.fixture
def plain_shuffles(spark):
    """Eight tasks, no help from the optimizer."""
    fixed = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in fixed}
    for k, v in fixed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lookup_join_is_a_left_join(spark):
    random.seed(1)
    left = [("hot", i) for i in range(300)] + [(random.choice("abcdefgh"), i) for i in range(300, 400)] + [(None, 400), (None, 401)]
    right = {"hot": 1, "a": 2, "b": 3, "c": None, "unused": 5}
    frame = spark.createDataFrame(left, "k string, n long")
    table = spark.createDataFrame([*right.items(), (None, 9)], "k string, v int")
    want = sorted(((k, n, right.get(k)) for k, n in left), key=repr)
    for small in (0, 1000):
        got = skew.lookup_join(frame, table, "k", small).collect()
        assert sorted(map(tuple, got), key=repr) == want, small


def test_small_table_shuffles_nothing(spark):
    frame = spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"), F.col("id").alias("n"))
    joined = skew.lookup_join(frame, spark.createDataFrame([("1", 1)], "k string, v int"), "k")
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd", ["one key", "identical rows", "no key"])
def test_large_table_spreads_a_crowd(spark, plain_shuffles, crowd):
    """A third of the rows on one key: none of it goes through the shuffle."""
    hot = F.lit(None).cast("string") if crowd == "no key" else F.lit("hot")
    number = F.lit(0).cast("long") if crowd == "identical rows" else F.col("id")
    key = F.when(F.col("id") % 3 == 0, hot).otherwise((F.col("id") % 5000).cast("string"))
    frame = spark.range(60_000, numPartitions=8).select(key.alias("k"), number.alias("n"))
    table = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([("hot", -1)], "k string, v long"))
    joined = skew.lookup_join(frame, table, "k", 0)
    assert joined.count() == 60_000 and joined.where("k = 'hot' and v = -1").count() == (0 if crowd == "no key" else 20_000)
    assert largest_share(joined) <= 2


def test_hot_keys_are_bounded(spark):
    counts = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(10).alias("n"))
    assert skew.hot_keys(counts, "k", 8).count() == 0
    assert skew.hot_keys(counts, "k", 1000).count() <= 4000


def test_running_total(spark):
    random.seed(2)
    rows = [(g, random.randint(0, 99) / 100, random.randint(0, 5)) for g in ("a", "b", None) for _ in range(80)]
    rows = list({(g, s): (g, s, v) for g, s, v in rows}.values())
    frame = spark.createDataFrame(rows, "g string, s double, v long")
    got = skew.running_total(frame, ["g"], F.col("s").desc(), F.floor((1 - F.col("s")) * 8), ["v"])
    for r in got.collect():
        same = [(s, v) for g, s, v in rows if g == r["g"]]
        assert r["before_v"] == sum(v for s, v in same if s > r["s"])
        assert r["all_v"] == sum(v for _, v in same)


def test_ttl_lookup_agrees_with_a_loop(spark):
    random.seed(5)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(minutes=30 * random.randint(0, 400))
    keys = ["hot"] * 6 + ["a", "b", None]
    events = [(i, random.choice(keys), random.choice([None, at(), at(), at()])) for i in range(400)]
    records = list({(k, t): (k, t, random.choice([None, "x", "y"])) for k, t in ((random.choice(keys), at()) for _ in range(120))}.values())
    ev = spark.createDataFrame(events, "id long, k string, ts timestamp")
    rec = spark.createDataFrame(records, "k string, fetched_at timestamp, answer string")
    for ttl, tasks in ((6 * 3600, None), (3 * 86400, 1), (1800, 50), (30 * 86400, 13)):
        got = {r["id"]: (r["fetched_at"], r["answer"]) for r in
               lookups.ttl_lookup(ev, rec, "k", "ts", "fetched_at", ttl, tasks).collect()}
        assert len(got) == len(events)
        for i, k, t in events:
            known = [(f, a) for rk, f, a in records if rk == k and k is not None and t is not None and f <= t]
            best = max(known, key=lambda r: r[0], default=(None, None))
            if best[0] is None or t - best[0] > timedelta(seconds=ttl):
                best = (None, None)
            assert got[i] == best, (i, k, t, ttl, tasks)


@pytest.mark.parametrize("crowd", ["no key", "no time", "one key in one hour"])
def test_ttl_lookup_spreads_a_crowd(spark, plain_shuffles, crowd):
    start = F.lit("2024-01-01").cast("timestamp")
    moment = F.timestamp_add("SECOND", F.col("id") % F.lit(1800 if crowd == "one key in one hour" else 90000), start)
    third = F.col("id") % 3 == 0
    key = F.when(third, F.lit(None if crowd == "no key" else "hot").cast("string")).otherwise((F.col("id") % 4000).cast("string"))
    ts = F.when(third, F.lit(None).cast("timestamp")).otherwise(moment) if crowd == "no time" else moment
    events = spark.range(60_000, numPartitions=8).select("id", key.alias("k"), ts.alias("ts"))
    records = spark.range(4000).select(F.col("id").cast("string").alias("k"), start.alias("fetched_at"), F.lit("x").alias("answer"))
    found = lookups.ttl_lookup(events, records.union(records.limit(1).withColumn("k", F.lit("hot"))), "k", "ts", "fetched_at", 10**6)
    assert found.where("answer = 'x'").count() == (60_000 if crowd == "one key in one hour" else 40_000)
    # the others are answered in the tasks that read them
    assert largest_share(found.where("k IS NOT NULL AND ts IS NOT NULL")) <= 2


@pytest.mark.parametrize("crowd", ["events", "records", "equal events", "equal records"])
def test_asof_ranges_are_even(spark, plain_shuffles, crowd):
    """A third of all rows, or 10^5 records, on one key in one hour or one moment: each range reads about the mean, and rows are not copied."""
    start = F.lit("2024-01-01").cast("timestamp")
    often = F.timestamp_add("SECOND", F.lit(0) if crowd.startswith("equal") else F.col("id") % 3600, start)
    few, many = spark.range(20_000, numPartitions=8), spark.range(100_000, numPartitions=8)
    hot = lambda f: f.select(F.lit("hot").alias("_key"), often.alias("_time"), "id")
    plain = lambda f: f.select((F.col("id") % 3000).cast("string").alias("_key"), F.timestamp_add("SECOND", F.col("id") % 90_000, start).alias("_time"), "id")
    on_records = crowd.endswith("records")
    ev = plain(few).union(hot(spark.range(1000)) if on_records else hot(few))
    rec = plain(few).union(hot(many) if on_records else hot(spark.range(10)))
    events = ev.select("_key", "_time", F.struct("id").alias("_event"))
    records = rec.select("_key", "_time", F.struct(F.col("_time").alias("_at"), "id").alias("_record"))
    total = events.count() + records.count()
    rows = [r["_rows"] for r in asof.scanned(asof.sequence(events, records, 8)).where("_rows IS NOT NULL").collect()]
    assert sum(rows) == total and len(rows) == 8
    assert max(rows) <= 2 * total / 8
    merged = asof.merge(events, records)
    assert merged.count() == events.count()
    assert merged.where("_event.id < 10 AND _record IS NULL").count() <= 10
    # the only shuffle between the tables and what is written is the one into ranges
    plan = asof.scanned(asof.sequence(events, records, 8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_asof_carries_across_many_ranges(spark):
    """One record long before a hot key's events, keys between, ties at one time: as a loop finds."""
    random.seed(9)
    moment = datetime(2024, 1, 1)
    events = [(k, moment + timedelta(minutes=random.randint(0, 40)), i) for i, k in enumerate(random.choices("abh", [1, 1, 8], k=500))]
    records = [("h", moment, 1), ("h", moment, 7), ("h", moment + timedelta(minutes=20), 3), ("h", moment + timedelta(minutes=20), 2), ("b", moment + timedelta(minutes=39), 5), ("c", moment, 4)]
    ev = spark.createDataFrame(events, "k string, ts timestamp, id int")
    rec = spark.createDataFrame(records, "k string, at timestamp, v int")
    for tasks in (1, 3, 60):
        for r in lookups.ttl_lookup(ev, rec, "k", "ts", "at", 10**6, tasks).collect():
            known = [(t, v) for k, t, v in records if k == r["k"] and t <= r["ts"]]
            assert (r["at"], r["v"]) == max(known, default=(None, None)), (r, tasks)
    clash = lookups.ttl_lookup(ev.withColumnRenamed("id", "_record"), rec.withColumnRenamed("v", "_event"), "k", "ts", "at", 10**6)
    assert clash.columns == ["k", "ts", "_record", "at", "_event"] and clash.count() == 500
    assert lookups.ttl_lookup(ev.limit(0), rec, "k", "ts", "at", 1).count() == 0
    assert lookups.ttl_lookup(ev, rec.limit(0), "k", "ts", "at", 1).where("at IS NULL").count() == 500


def test_feed_status_uses_the_last_good_snapshot(spark):
    noon = datetime(2024, 1, 1, 12)
    h = lambda n: noon - timedelta(hours=n)
    rows = [("a", h(5), "ok"), ("a", h(1), "failed"), ("b", h(7), "ok"), ("c", h(1), "failed"), ("d", h(2), "ok"), ("d", h(-1), "failed")]
    snapshots = spark.createDataFrame(rows, "feed string, fetched_at timestamp, status string")
    status = lookups.feed_status(snapshots, noon, 6 * 3600)
    got = {r["feed"]: (r["snapshot_at"], r["newest_ok"], r["usable"]) for r in status.collect()}
    assert got == {"a": (h(5), False, True), "b": (h(7), True, False), "c": (None, False, False), "d": (h(2), True, True)}
    assert tuple(lookups.intel_available(status).first()) == (False, "no usable snapshot: b, c")
    assert tuple(lookups.intel_available(status.where("usable")).first()) == (True, None)
    assert tuple(lookups.intel_available(status.limit(0)).first()) == (False, "no feed is expected")
    expected = spark.createDataFrame([("a",), ("d",), ("late",)], "feed string")
    late = snapshots.unionByName(spark.createDataFrame([("late", h(-2), "ok")], snapshots.schema))
    state = lookups.intel_available(lookups.feed_status(late, noon, expected=expected)).first()
    assert tuple(state) == (False, "no usable snapshot: late")


def test_stale_entries_do_not_match(spark):
    noon = datetime(2024, 1, 1, 12)
    h = lambda n: noon - timedelta(hours=n)
    snapshots = spark.createDataFrame([("a", h(5), "ok"), ("a", h(3), "ok"), ("a", h(1), "failed"), ("b", h(7), "ok")], "feed string, fetched_at timestamp, status string")
    entries = spark.createDataFrame([("a", "old", h(5)), ("a", "now", h(3)), ("a", "half", h(1)), ("b", "gone", h(7))], "feed string, url string, fetched_at timestamp")
    found = lookups.current_entries(entries, lookups.feed_status(snapshots, noon))
    assert [r["url"] for r in found.collect()] == ["now"]


def test_a_written_table_is_counted_where_it_is(spark, monkeypatch):
    """No row is brought to one task, and the answer is that of a count that stops."""
    rows = session.cut_lineage(spark.range(50).select(F.col("id").cast("string").alias("token")))
    expected = [session.is_small(rows, most, size) for most, size in ((50, 1 << 20), (49, 1 << 20), (50, 10))]
    limit = type(rows).limit  # first() takes one row of the counts
    monkeypatch.setattr(type(rows), "limit", lambda frame, n: limit(frame, n) if n == 1 else pytest.fail("rows are moved"))
    assert [session.is_small(rows, most, size, written=True) for most, size in ((50, 1 << 20), (49, 1 << 20), (50, 10))] == expected == [True, False, False]
    assert skew.lookup_join(rows, rows.withColumn("n", F.lit(1)), "token", 10, written=True).where("n = 1").count() == 50
    assert session.is_small(rows.where("false"), 0, written=True)
