"""Hashed term counts against the grams held as strings and hashed by the library."""

import random
import resource

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer

from mailrisk.functions import grams
from mailrisk.operators import body

ODD = [None, "", "a", "ab", "abc", "one", "one two", "One  TWO, three-four", "é" * 7, "漢字🙂🙂かな x", "İstanbul ǅ", "x" * 40, "a\nb\r\n\tc 1٣²", "̈mark"]


def plain(df, features):
    """Words, pairs and grams as arrays, counted by the library's hash."""
    marked = "concat(transform(concat(words, pairs), w -> concat('w', w)), transform(chars, c -> concat('c', c))) AS terms"
    stages = [NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement=f"SELECT *, {marked} FROM __THIS__"),
              HashingTF(inputCol="terms", outputCol="tf", numFeatures=2 * features)]
    return PipelineModel(stages).transform(body.gram_columns(df, "text"))


@pytest.mark.parametrize("features", [1 << 18, 500])
def test_counts_equal_the_library(spark, features):
    rng = random.Random(4)
    letters = "ab c\n.é漢🙂1A "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(100)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["tf"] for r in body.term_counts(frame, "text", features).collect()}
    for r in plain(frame, features).select("id", "tf").collect():
        assert got[r["id"]] == r["tf"], texts[r["id"]]


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice("abc é🙂  ") for _ in range(5000))
    whole = grams.counts(text, 1000)
    for name, value in (("CHARS_AT_ONCE", 7), ("WORDS_AT_ONCE", 3), ("HASHES_HELD", 50)):
        monkeypatch.setattr(grams, name, value)
        assert all(np.array_equal(a, b) for a, b in zip(grams.counts(text, 1000), whole, strict=True))


def test_a_long_text_needs_little_memory():
    """Ten megabytes: what is held beside the text stays under 200 MB."""
    text = " ".join(f"word{i % 9973}" for i in range(1_000_000))
    assert len(text) > 8_500_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    columns, n = grams.counts(text, 1 << 19)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 200
    assert n.sum() == 2_000_000 - 1 + sum(len(text) - k + 1 for k in (3, 4, 5)) and np.all(np.diff(columns) > 0)


def test_features_keep_columns_and_replace_tf(spark):
    frame = spark.createDataFrame([(1, "act now", "x"), (2, None, "y")], "id int, text string, tf string")
    made = body.term_counts(frame, "text", 64)
    assert made.columns == ["id", "text", "tf"]
    empty = made.where("id = 2").first()["tf"]
    assert empty.size == 128 and empty.numNonzeros() == 0
    assert body.term_counts(frame.limit(0), "text", 64).count() == 0
    assert body.urgency_features(frame.select("id", "text")).columns == ["id", "text", "features"]
