import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailrisk.llm import periodic

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    """By the border table, independent of the operator."""
    border = [0] * len(words)
    for i in range(1, len(words)):
        k = border[i - 1]
        while k and words[i] != words[k]:
            k = border[k - 1]
        border[i] = k + (words[i] == words[k])
    return len(words) - border[-1]


def brute_runs(words, least=24, periods=3):
    found = set()
    for lag in range(1, len(words) // periods + 1):
        i = lag
        while i < len(words):
            if words[i] != words[i - lag]:
                i += 1
                continue
            start = i - lag
            while i < len(words) and words[i] == words[i - lag]:
                i += 1
            if i - start >= max(least, periods * lag) and smallest_period(words[start:i]) == lag:
                found.add((start, i - start, lag))
    return sorted(found)


def planted(doc_id, text):
    words = SPLIT.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_report(doc_id, text):
    words = planted(doc_id, text)
    found = brute_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{p}\n" for s, n, p in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def named(words):
    return periodic.name_words([str(w).encode() for w in words])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 30)), max_size=4),
       st.sampled_from([(24, 3), (6, 3), (1, 3), (10, 4)]))
def test_runs_equal_brute_force(parts, bounds):
    words = [w for block, times in parts for w in block * times][:400]
    assert periodic.runs(named(words), *bounds) == brute_runs(words, *bounds)


def test_nested_and_overlapping_runs():
    inner = ["a"] * 30
    words = (inner + ["b", "c"]) * 4 + ["x"] + ["p", "q"] * 12 + ["p"] + ["q", "p", "r"] * 9
    assert periodic.runs(named(words)) == brute_runs(words)
    assert len(periodic.runs(named(words))) >= 6


def test_lengths_at_the_threshold():
    for period, length in [(1, 23), (1, 24), (7, 23), (8, 24), (9, 26), (9, 27), (50, 149), (50, 150)]:
        words = ["l"] + [f"w{i % period}" for i in range(length)] + ["r"]
        assert periodic.runs(named(words)) == ([(1, length, period)] if length >= max(24, 3 * period) else [])


def test_two_periods_are_refused():
    with pytest.raises(ValueError, match="three"):
        periodic.runs(named(["a"] * 30), 24, 2)


def test_a_long_text_of_one_word_needs_few_candidates():
    where, _, _ = periodic.occurrences(named(["w"] * 200_000))
    assert len(where) < 200_000 * 20
    assert periodic.runs(named(["w"] * 200_000)) == [(0, 200_000, 1)]
    block = [str(i) for i in range(50_000)]
    assert periodic.runs(named(block * 4)) == [(0, 200_000, 50_000)]


def test_report_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(None, "a " * 40), (1, None), (2, ""), (3, " \t\n"), (3, "one two"), (4, "é x " * 30), (5, "w\x0b" * 23), (6, "w " * 24)]
    for doc_id in range(10, 200):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 120))]
        rows.append((doc_id, rng.choice([" ", "\n", "  "]).join(words)))
    rows += rows[-3:]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in periodic.report(frame).collect()), key=str)
    assert got == sorted((brute_report(*r) for r in rows), key=str)
    assert any(r[1] for r in got if zlib.crc32(str(r[0]).encode()) % 10 == 0)


def test_documents_of_the_table_equal_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in periodic.report(documents).collect())
    short = [(i, t) for i, t in documents.collect() if len(t or "") < 12_000]
    wanted = {brute_report(*r) for r in short}
    assert wanted <= set(got) and len(got) == documents.count()


def test_other_columns_stay_and_clashing_ones_go(spark):
    frame = spark.createDataFrame([(1, "a " * 30, "x", 5)], "id int, body string, runs string, `od d` int")
    found = periodic.find_runs(frame, "body")
    assert found.columns == ["id", "body", "od d", "runs", "collapsed"]
    row = found.first()
    assert [tuple(r) for r in row.runs] == [(0, 30, 1)] and row.collapsed == "a"
    assert periodic.find_runs(frame.limit(0), "body").count() == 0
    assert periodic.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
