"""Layer 4: correlation with recorded indicator feeds and network lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.functions import exprs
from mailrisk.operators import bloom
from mailrisk.operators.domains import registrable_domain
from mailrisk.operators.signals import emit
from mailrisk.operators.networks import listed as listed_addresses
from mailrisk.operators.networks import matches as hosting_matches
from mailrisk.operators.skew import SMALL_ROWS, lookup_join
from mailrisk.session import cut_lineage, is_small


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Feeds of different origin as one table feeds(feed, url)."""
    return reduce(DataFrame.unionByName, [f.select("feed", "url") for f in feeds])


def _by_indicator(feeds: DataFrame, indicator: str) -> DataFrame:
    """One row per indicator with the feeds that list it."""
    return feeds.where(F.col(indicator).isNotNull()).groupBy(indicator).agg(
        F.array_join(F.array_sort(F.collect_set("feed")), ", ").alias("feeds")
    )


def _listed(hits: DataFrame, indicator: str, name: str, key: str) -> DataFrame:
    """One signal per message with a listed indicator, naming the first and all feeds."""
    per_message = hits.groupBy(key).agg(
        F.min(F.struct(indicator, "feeds")).alias("first"),
        F.count_distinct(indicator).alias("matches"),
    ).select(key, "first.*", "matches")
    return emit(
        per_message,
        name,
        F.format_string("%s is listed by %s", indicator, "feeds"),
        key=key,
        **{"indicator": F.col(indicator), "feeds": F.col("feeds"), "matches": F.col("matches")},
    )


def _hits(seen: DataFrame, listed: DataFrame, indicator: str, small_rows: int) -> DataFrame:
    """Rows of `seen` whose indicator is listed, with its feeds.

    Beyond the size of a broadcast, a Bloom filter of the list drops nearly all rows without a hit where
    they are, and only the others meet the list in a shuffle.
    """
    if not is_small(listed, small_rows):
        listed = cut_lineage(listed)
        seen = bloom.sieve(seen, listed, indicator)
    return lookup_join(seen, listed, indicator, small_rows).where("feeds IS NOT NULL")


def url_ioc_signals(
    observations: DataFrame, feeds: DataFrame, key: str = "message_id", small_rows: int = SMALL_ROWS
) -> DataFrame:
    """url_ioc: an observed URL is in a feed."""
    hits = _hits(observations.select(key, "url"), _by_indicator(feeds, "url"), "url", small_rows)
    return _listed(hits, "url", "url_ioc", key)


def with_domain(df: DataFrame, suffixes: DataFrame, url_col: str = "url") -> DataFrame:
    """Add `domain`, the registrable domain of a URL."""
    hosts = df.withColumn("_host", exprs.url_host(F.col(url_col)))
    return registrable_domain(hosts, "_host", suffixes, "domain").drop("_host")


def domain_ioc_signals(
    observations: DataFrame, feeds: DataFrame, suffixes: DataFrame, key: str = "message_id", small_rows: int = SMALL_ROWS
) -> DataFrame:
    """domain_ioc: the registrable domain of an observed URL is that of a feed entry."""
    seen = with_domain(observations, suffixes).select(key, "domain").distinct()
    listed = _by_indicator(with_domain(feeds, suffixes), "domain")
    return _listed(_hits(seen, listed, "domain", small_rows), "domain", "domain_ioc", key)


def hosting_signals(
    observations: DataFrame, dns: DataFrame, networks: DataFrame, key: str = "message_id"
) -> DataFrame:
    """hosting_flag: a URL's host resolves into a listed network, by recorded dns(host, ip).

    Owners are looked up for the one address that each listed host is named with; until then it
    only counts whether an address is listed.
    """
    dns = dns.select("host", "ip").distinct()
    listed = listed_addresses(dns, networks).withColumn("listed", F.lit(True))
    flagged = cut_lineage(
        lookup_join(dns, listed, "ip").where("listed").groupBy(F.lower("host").alias("host")).agg(F.min("ip").alias("ip"))
    )
    seen = observations.select(key, exprs.url_host(F.col("url")).alias("host")).distinct()
    hits = lookup_join(seen, flagged, "host").where("ip IS NOT NULL")
    first = hits.groupBy(key).agg(
        F.min(F.struct("host", "ip")).alias("first"), F.count("*").alias("hosts")
    ).select(key, "first.*", "hosts")
    per_message = lookup_join(first, cut_lineage(hosting_matches(flagged, networks)), "ip")
    return emit(
        per_message,
        "hosting_flag",
        F.concat("host", F.lit(" resolves to "), "ip", F.lit(" of "), F.array_join("owners", ", ")),
        key=key,
        host=F.col("host"),
        ip=F.col("ip"),
        hosts=F.col("hosts"),
    )
