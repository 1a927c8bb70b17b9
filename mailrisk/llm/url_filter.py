"""URL filter: domain and path rules first, a weighted vocabulary of URL terms for the rest.

The vocabulary is one Aho-Corasick automaton that reads each url once. A hit counts only
between boundaries: no ASCII letter or digit stands on either side of it. A url is
blocked on one strict term, or on `soft_needed` distinct soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: The rules of the query's contract.
RULES = (
    Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"),
)

STRICT_TERMS = (
    "porn", "porno", "xxx", "hentai", "camgirls", "escorts", "warez", "keygen", "crackz", "torrents",
    "onlinecasino", "sexcam", "nudes", "milf", "bdsm", "adult",
)
SOFT_TERMS = (
    "sex", "sexy", "nude", "dating", "casino", "poker", "bet", "bets", "betting", "gambling", "slots", "jackpot",
    "viagra", "cialis", "pills", "loan", "payday", "cheap", "free", "bonus", "crack", "serial", "torrent",
    "download", "click", "ads", "track", "tracking", "affiliate", "replica", "hot", "girls", "win",
)


@dataclass(frozen=True)
class Vocabulary:
    """Strict and soft terms in lower-case ASCII; a term in both lists counts as strict."""

    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    soft_needed: int = 2
    _automaton: list = field(default_factory=list, compare=False, repr=False)

    def automaton(self) -> ahocorasick.Automaton:
        if not self._automaton:
            made = ahocorasick.Automaton()
            for term in self.soft:
                made.add_word(term, (term, False))
            for term in self.strict:
                made.add_word(term, (term, True))
            if len(made):
                made.make_automaton()
            self._automaton.append(made)
        return self._automaton[0]

    def __getstate__(self):
        return {"strict": self.strict, "soft": self.soft, "soft_needed": self.soft_needed, "_automaton": []}

    def count(self, url: str) -> tuple[int, int]:
        """Distinct strict and distinct soft terms of a url."""
        automaton = self.automaton()
        if not len(automaton):
            return 0, 0
        text = url.lower() if url.isascii() else "".join(c.lower() if c < "\x80" else c for c in url)
        strict, soft = set(), set()
        for end, (term, is_strict) in automaton.iter(text):
            if not _inside(text, end - len(term)) and not _inside(text, end + 1):
                (strict if is_strict else soft).add(term)
        return len(strict), len(soft)


def _inside(text: str, at: int) -> bool:
    """An ASCII letter or digit stands at this place."""
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def url_parts(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def apply_rules(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `rule` and `rule_verdict` of the longest rule that fits host and path, else null.

    Longest counts the characters of host and path together; on a tie the longer host,
    then the first in the list. The rules are a short parameter, so they become one
    expression without a join.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ranked):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.host + r.path).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary | None = None,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, strict_hits, soft_hits.

    Null urls and urls without `://` have an empty host and path; no rule fits them, and
    a null url has no terms, so it is allowed. Repeated rows are each judged. Other
    columns are not read, whatever their names. There is no shuffle.
    """
    vocabulary = vocabulary or Vocabulary()

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [vocabulary.count(u) if u else (0, 0) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h[0] for h in hits], pa.int32()),
                 pa.array([h[1] for h in hits], pa.int32())],
                names=["id", "url", "strict_hits", "soft_hits"],
            )

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = dict(source.dtypes)["id"]
    counted = source.mapInArrow(count_terms, f"id {kind}, url string, strict_hits int, soft_hits int")
    host, path = url_parts("url")
    parted = counted.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    by_terms = F.when((F.col("strict_hits") >= 1) | (F.col("soft_hits") >= vocabulary.soft_needed), "block").otherwise("allow")
    return apply_rules(parted, rules).select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("rule_verdict", by_terms).alias("verdict"), "strict_hits", "soft_hits",
    )


def sql(vocabulary: Vocabulary | None = None, rules: tuple[Rule, ...] = RULES) -> str:
    """The same judgement as DuckDB SQL over `pages`."""
    vocabulary = vocabulary or Vocabulary()
    bounded = r"(^|[^a-z0-9]){}($|[^a-z0-9])"
    low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hits = lambda terms: " + ".join(
        f"CAST(coalesce(regexp_matches({low}, '{bounded.format(t)}'), false) AS INTEGER)" for t in terms) or "0"
    ranked = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host)))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ranked)
    soft = [t for t in vocabulary.soft if t not in vocabulary.strict]
    return f"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    CAST({hits(vocabulary.strict)} AS INTEGER) AS strict_hits, CAST({hits(soft)} AS INTEGER) AS soft_hits
  FROM rest)
SELECT page_id, host, path, {case(lambda r: r.host + r.path)} ELSE NULL END AS rule,
  {case(lambda r: r.verdict)} WHEN strict_hits >= 1 OR soft_hits >= {vocabulary.soft_needed} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits
FROM parts"""
