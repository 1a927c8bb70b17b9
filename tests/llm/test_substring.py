"""Substring dedup: the index against brute force, minimizers, crowds, odd rows."""

import hashlib
import random

import numpy as np
import pytest

from mailrisk.llm import substring
from mailrisk.llm.fm_index import FmIndex, RankBits, WaveletMatrix


def test_ranks():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        bits = rng.random(n) < 0.4
        assert RankBits(bits).rank(np.arange(n + 1)).tolist() == np.r_[0, np.cumsum(bits)].tolist()
    for alphabet in (1, 2, 5, 64, 1000):
        symbols = rng.integers(0, alphabet, 700)
        matrix, at = WaveletMatrix(symbols, alphabet), rng.integers(0, 701, 300)
        asked = rng.integers(0, alphabet, 300)
        assert matrix.rank(asked, at).tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(asked, at)]


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 50])
def test_matching_statistics(window):
    rng = random.Random(window)
    for _ in range(30):
        letters = [b"a", b"b", b"c"][: rng.choice([1, 2, 3])]
        sequences = [[rng.choice(letters) for _ in range(rng.randint(0, 20) + (50 if window == 50 else 0))] for _ in range(rng.randint(1, 12))]
        owners, least = [rng.randint(0, 9) for _ in sequences], {}
        for s, o in zip(sequences, owners, strict=True):
            for i in range(len(s) - window + 1):
                least[tuple(s[i : i + window])] = min(o, least.get(tuple(s[i : i + window]), o))
        want = [[least[tuple(s[i : i + window])] for i in range(len(s) - window + 1)] for s in sequences]
        assert [x.tolist() for x in FmIndex(sequences, np.array(owners), window).matching_statistics()] == want


def test_minimizers_are_those_of_the_window_alone():
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 30)}".encode() for _ in range(300)]
    least = substring.minimizers(words)
    assert len(least) == 251 and len(substring.minimizers(words[:49])) == 0
    for i in range(0, 251, 7):
        assert substring.minimizers(words[i : i + 50]).tolist() == [least[i]]


def slow_report(rows, window):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, text in rows:
        words, gone = (text or "").encode().split(), set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def case(n, seed, vocabulary):
    """Documents that share passages of many lengths, whole copies, repeated words, odd rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice(vocabulary)
    passages = [[word() for _ in range(rng.choice([9, 10, 11, 12, 25, 70, 160]))] for _ in range(8)]
    rows = [(None, None), (0, None), (0, ""), (1, "  \t\n "), (2, "x " * 400), (3, "x " * 300), (3, "x " * 300), (None, "x " * 300)]
    for i in range(n):
        words = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(passages) + [word() for _ in range(rng.randint(0, 9))]
        rows.append((rng.choice([i, i, 7]), rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


WIDE = [f"word{i}é" for i in range(5000)]
NARROW = ["a", "b", "cc"]


@pytest.mark.parametrize("vocabulary,crowd,shard_words", [(WIDE, 2048, 200_000), (WIDE, 3, 500), (NARROW, 2048, 900), (NARROW, 2, 900)])
def test_report(spark, vocabulary, crowd, shard_words):
    rows = case(60, len(vocabulary), vocabulary)
    docs = spark.createDataFrame([(i, t, 1, "h", "k") for i, t in rows], "doc_id long, text string, n_words int, m string, spans string").repartition(3)
    got = [tuple(r) for r in substring.report(docs, 10, crowd, shard_words).collect()]
    assert sorted(got, key=str) == sorted(slow_report(rows, 10), key=str)


def test_deduplicate_changes_only_what_repeats(spark):
    rows = case(40, 5, WIDE)
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id long, text string, n_chars long, words string")
    kept = substring.deduplicate(docs, 10)
    assert kept.columns == docs.columns
    want = sorted((str(i), sha) for i, _, _, sha in slow_report(rows, 10))
    got = kept.collect()
    assert sorted((str(r.doc_id), hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in got) == want
    untouched = {(i, t) for (i, t), (_, _, removed, _) in zip(rows, slow_report(rows, 10), strict=True) if not removed}
    assert untouched <= {(r.doc_id, r.text) for r in got}
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert substring.deduplicate(docs.limit(0)).count() == 0 == substring.report(docs.limit(0)).count()
