"""A Bloom filter loses no key, lets few others through and moves no row."""

import numpy as np
from pyspark.sql import functions as F

from mailrisk.operators import bloom, intel


def test_no_key_is_lost_and_few_others_pass(spark):
    listed = spark.range(30_000).select(F.concat(F.lit("https://bad.example.com/"), "id").alias("url")).union(spark.createDataFrame([(None,)], "url string"))
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 100 == 7, F.concat(F.lit("https://bad.example.com/"), F.expr("id div 100"))).when(
        F.col("id") % 100 == 8, None).otherwise(F.concat(F.lit("https://fine.example.org/"), "id")).alias("url"))
    left = bloom.sieve(rows, listed, "url")
    assert left.where("url LIKE 'https://bad%'").count() == 600
    assert left.where("url LIKE 'https://fine%'").count() < 0.02 * 60_000 and left.where("url IS NULL").count() == 0
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()


def test_bits_are_those_of_the_hashes(spark):
    keys = ["a", "b", "ü", "", "x" * 500]
    made = bloom.build(spark.createDataFrame([(k,) for k in keys], "k string"), "k")
    hashes = np.array([r["h"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k").alias("h")).collect()])
    assert made.holds(hashes).all() and made.bits == 64
    plain = np.zeros(made.bits, bool)
    for h in hashes.tolist():
        for i in range(bloom.HASHES):
            plain[((h & 0xFFFFFFFF) + i * ((h >> 32) & 0xFFFFFFFF)) % made.bits] = True
    assert [bool(int(made.words[p >> 6]) >> (p & 63) & 1) for p in range(made.bits)] == plain.tolist()


def test_odd_tables(spark):
    rows = spark.createDataFrame([("a",), (None,)], "k string")
    assert bloom.sieve(rows, rows.limit(0), "k").count() == 0
    assert bloom.sieve(rows.limit(0), rows, "k").count() == 0
    assert [r["k"] for r in bloom.sieve(rows, rows.union(rows), "k").collect()] == ["a"]
    assert bloom.build(spark.range(1000), "id", max_bytes=64) is None
    assert bloom.sieve(rows, rows, "k").columns == ["k"]


def test_a_large_feed_gives_the_same_signals(spark):
    feeds = spark.range(2000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("feed"), F.concat(F.lit("https://h"), F.col("id") % 700, F.lit(".example.com/")).alias("url"))
    seen = spark.range(5000).select(F.concat(F.lit("m"), F.col("id") % 900).alias("message_id"), F.concat(F.lit("https://h"), F.col("id"), F.lit(".example.com/")).alias("url"))
    suffixes = spark.createDataFrame([("com", "normal")], "suffix string, kind string")
    rows = lambda f: sorted(map(str, f.collect()))
    assert rows(intel.url_ioc_signals(seen, feeds)) == rows(intel.url_ioc_signals(seen, feeds, small_rows=0))
    assert rows(intel.domain_ioc_signals(seen, feeds, suffixes)) == rows(intel.domain_ioc_signals(seen, feeds, suffixes, small_rows=0))
