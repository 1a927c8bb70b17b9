"""Registrable domain by longest public-suffix rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.operators.skew import lookup_join
from mailrisk.session import is_small

# A public-suffix list has about ten thousand rules.
MAX_BROADCAST_RULES = 200_000

IPV4 = "^[0-9]{1,3}(\\.[0-9]{1,3}){3}$"


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """suffixes(suffix, kind) to one row per suffix with a flag per kind."""
    has = lambda kind: F.max(F.col("kind") == kind)
    return suffixes.groupBy(F.lower("suffix").alias("suffix")).agg(
        has("normal").alias("normal"),
        has("wildcard").alias("wildcard"),
        has("exception").alias("exception"),
    )


def registrable_domain(
    df: DataFrame,
    host_col: str,
    suffixes: DataFrame,
    out: str = "registrable_domain",
    max_broadcast: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """Add the registrable domain of a host.

    Rules are suffixes of kind normal, wildcard (one more label belongs to the
    suffix) and exception (one label fewer). An exception wins, then the longest
    rule; without a rule it is the last two labels. An address is its own domain. A
    host that is no longer than its public suffix has none.

    Only the last n labels can match, n being the longest rule, so the host table
    gets n equality lookups on the rule table and is neither exploded nor regrouped.
    With the usual rule list every lookup is a broadcast and the host table is not
    shuffled at all. A list beyond the bound is prepared for the distinct hosts only, by one join of
    their suffixes, and brought back by one lookup; the table is read twice at any depth.
    """
    rules = suffix_rules(suffixes)
    depth = rules.agg(F.max(F.size(F.split("suffix", "\\.")))).first()[0] or 0
    if not is_small(rules, max_broadcast):
        hosts = df.select(F.col(host_col).alias("_host")).where(F.col("_host").isNotNull()).distinct()
        split = F.split("_host", "\\.")
        tails = F.transform(
            F.sequence(F.lit(1), F.least(F.size(split), F.lit(depth))),
            lambda n: F.struct(n.alias("n"), F.array_join(F.slice(split, F.size(split) - n + 1, n), ".").alias("suffix")))
        spelled = lookup_join(hosts.select("_host", F.inline(tails)), rules, "suffix", 0)
        found = spelled.groupBy("_host").agg(*[
            F.first(F.when(F.col("n") == n, F.struct("normal", "wildcard", "exception")), ignorenulls=True).alias(f"_rule{n}")
            for n in range(1, depth + 1)
        ])
        named = _taken(found, "_host", depth, out).withColumnRenamed("_host", host_col).select(host_col, out)
        return lookup_join(df, named, host_col)

    host = F.col(host_col)
    labels = F.size(F.split(host, "\\."))

    def add_rule(frame: DataFrame, n: int) -> DataFrame:
        """Left join the rule spelled by the last n labels."""
        tail = F.when(labels >= n, F.substring_index(host, ".", -n))
        key = f"_suffix{n}"
        rule = rules.select(
            F.col("suffix").alias(key), F.struct("normal", "wildcard", "exception").alias(f"_rule{n}")
        )
        return frame.withColumn(key, tail).join(F.broadcast(rule), key, "left").drop(key)

    return _taken(reduce(add_rule, range(1, depth + 1), df), host_col, depth, out)


def _taken(joined: DataFrame, host_col: str, depth: int, out: str) -> DataFrame:
    """The registrable domain from the rules found for each number of labels."""
    host = F.col(host_col)
    labels = F.size(F.split(host, "\\."))
    steps = range(1, depth + 1)

    def longest(kind: str, extra: int) -> list:
        return [
            F.when(F.col(f"_rule{n}.{kind}") & (labels >= n + max(extra, 0)), F.lit(n + extra))
            for n in steps
        ]

    nothing = F.lit(None).cast("int")
    exception = F.greatest(nothing, nothing, *longest("exception", -1))
    normal = F.greatest(nothing, nothing, *longest("normal", 0), *longest("wildcard", 1))
    taken = F.coalesce(exception, normal, F.lit(1)) + 1
    domain = (
        F.when(host.rlike(IPV4) | host.startswith("["), host)
        .when(labels >= taken, F.concat_ws(".", F.slice(F.split(host, "\\."), -taken, taken)))
    )
    return joined.withColumn(out, domain).drop(*[f"_rule{n}" for n in steps])
