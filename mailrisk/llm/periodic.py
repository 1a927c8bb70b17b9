"""Periodic run detection: a sparse dynamic program over lags, one word after the other.

A diagonal is a lag at which words repeat: its match length grows with each word that equals the
word one lag earlier, and when it ends, a long enough one is a run. A frequent word has many
earlier occurrences, nearly all of which lead nowhere, so each word counts only those that a run
can need. A run of smallest period q has at least (k - 1) * q matching words, k being the least
number of periods. For the power of two g with g / 2 < q <= g, g words ending inside the run occur
q words earlier, and nowhere nearer: an occurrence at a lag d < q would give the run the periods d
and q over d + q words or more, hence the period gcd(d, q) < q. So of the earlier occurrences of a
word, the nearest one with the same g words before it suffices for the lags of that g, a few dozen
candidates at most for any text, and none for a text without repetitions. A diagonal is then open
exactly while its lag is that nearest one, which makes its period the smallest and its ends maximal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_PERIODS = 24, 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def occurrences(ids: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, words known to match) of the earlier occurrences that a run can need, by word.

    Names of 2 g words are made from two names of g words; words whose name is unique drop out, so
    ordinary text costs a few passes and no more.
    """
    if min_periods < 3:
        raise ValueError("runs need three periods or more")
    n, size = len(ids), 1
    least = 1 << max(0, (min_length * (min_periods - 1) // min_periods).bit_length() - 1)
    at, names = np.arange(n), np.asarray(ids, np.int64)
    full = np.empty(n, np.int64)
    found = []
    while size == 1 or size <= least or (size // 2) * min_periods < n:
        repeated = np.bincount(names)[names] > 1 if len(names) else np.zeros(0, bool)
        at, names = at[repeated], names[repeated]
        if not len(at):
            break
        if size >= least:
            order = np.argsort(names, kind="stable")
            again = names[order][1:] == names[order][:-1]
            here, before = at[order[1:][again]], at[order[:-1][again]]
            lag = here - before
            own = (lag <= size) & (lag > (size // 2 if size > least else 0))
            found.append((here[own], lag[own], np.full(own.sum(), size)))
        full.fill(-1)
        full[at] = names
        kept = at >= size
        at, names = at[kept], names[kept]
        left = full[at - size]
        both = left >= 0
        at = at[both]
        names = pd.factorize(left[both] * n + names[both])[0].astype(np.int64)
        size *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    where, lag, known = (np.concatenate(parts) for parts in zip(*found, strict=True))
    order = np.argsort(where, kind="stable")
    return where[order], lag[order], known[order]


def runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of words, by start, then period.

    `ids` names each word by a number below the number of words. The period is the smallest
    one; a run has at least min_length words and min_periods periods.
    """
    emitted: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # lag to match length up to the word `before`
    before = -1

    def end(lags) -> None:
        for lag in lags:
            length = active[lag] + lag
            if length >= max(min_length, min_periods * lag):
                emitted.append((before + 1 - length, length, lag))

    earlier = zip(*(x.tolist() for x in occurrences(ids, min_length, min_periods)), strict=True)
    for word, met in groupby(earlier, itemgetter(0)):
        if word > before + 1:
            end(active)
            active = {}
        still = {lag: active.get(lag, known - 1) + 1 for _, lag, known in met}
        end(active.keys() - still.keys())
        active, before = still, word
    end(active)
    return sorted(emitted)


def name_words(words: list[bytes]) -> np.ndarray:
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not found:
        return words
    stay = np.ones(len(words), bool)
    for start, length, period in found:
        stay[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stay).tolist()]


def find_runs(documents: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """The documents with `runs` (start, length and period in words) and `collapsed`, the text without repetitions.

    Words are what stands between spaces and the control characters 9 to 13. `collapsed` joins
    the kept words by one space. Null and empty texts have no runs and an empty `collapsed`.
    Columns named like these two are replaced, all others stay. Rows are independent, repeated rows
    give repeated results, and there is no shuffle. Texts of any length are read whole, in memory
    and time about proportional to their words.
    """
    kept = documents.drop("runs", "collapsed")
    names = kept.columns
    schema = ", ".join([
        *(f"`{n.replace('`', '``')}` {t}" for n, t in kept.dtypes),
        "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, collapsed = [], []
            for text in batch.column(text_col).cast(pa.binary()):
                words = (text.as_py() or b"").split()  # of bytes: exactly the six separators
                got = runs(name_words(words), min_length, min_periods) if len(words) >= min_length else []
                found.append([{"start": s, "length": n, "period": p} for s, n, p in got])
                collapsed.append(b" ".join(collapse(words, got)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=[*names, "runs", "collapsed"])

    return kept.mapInArrow(run, schema)


def strongest(found: str = "runs") -> Column:
    """The run with most periods, compared exactly; of equals the first by start, then period. Null without runs."""
    runs_ = F.col(found)
    return F.aggregate(
        F.slice(runs_, 2, F.greatest(F.size(runs_) - 1, F.lit(0))), F.get(runs_, F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def words_of(text_col: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_repetitions(documents: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the checksum of its id gets a periodic end.

    With h the crc32 of the decimal id and g = floor(h / 10), a document with h % 10 = 0 keeps its
    words before a = g % n; the words from there on repeat the p = 1 + floor((n - a) / (3 + g % 8)) first of
    them. Its words are joined by one space. Documents without an id or words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10), words_of("text")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    ending = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(ending, F.lit(1), n - a)), " ")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    return documents.select("doc_id", F.when(chosen, F.when(n > 0, repeated)).otherwise(F.col("text")).alias("text"))


def report(documents: DataFrame) -> DataFrame:
    """Runs of each document after `with_repetitions`, as digests; see find_runs for odd rows."""
    best = strongest()
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = find_runs(with_repetitions(documents)).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
