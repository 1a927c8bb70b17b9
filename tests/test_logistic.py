"""The urgency classifier on packed counts against the library's, which holds all vectors unpacked."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mailrisk.functions import grams
from mailrisk.operators import body, logistic

ODD = ["", "a", "ab", "one", "é" * 7, "漢字🙂🙂かな x", "x\0 \0y", "aaa" * 3000, "1٣² ̈mark", "tail"]


def texts(n):
    rng = random.Random(3)
    words = ["act", "now", "urgent", "lunch", "notes", "é漢", "report", "x"]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("features", [1 << 19, 1000])
def test_texts_at_once_and_packed_counts(monkeypatch, features):
    """Terms do not reach from one text into the next; far columns and many repeats take more entries."""
    some = texts(30)
    want = [grams.counts(t, features) for t in some]
    for (columns, n), (c, k) in zip(want, grams.batch_counts(some, features), strict=True):
        assert np.array_equal(columns, c) and np.array_equal(n, k)
    for most in (grams.MOST_GAP, 50):
        monkeypatch.setattr(grams, "MOST_GAP", most)
        packed = grams.packed(pa.array([*some, None]), features)
        columns, n, sizes = grams.unpacked(*packed, merged=True)
        assert sizes.tolist() == [len(c) for c, _ in want] + [0]
        assert np.array_equal(columns, np.concatenate([c for c, _ in want])) and np.array_equal(n, np.concatenate([k for _, k in want]))
        columns, n, sizes = grams.unpacked(*[p.slice(5, 20) for p in packed])
        assert np.bincount(np.repeat(np.arange(20), sizes), weights=n).tolist() == [k.sum() for _, k in want[5:25]]
    weights = np.arange(features) / features
    monkeypatch.setattr(grams, "TEXT_AT_ONCE", 100)
    assert grams.weighted_sums(some, weights) == pytest.approx([weights[c] @ k for c, k in want])


def test_fit_equals_the_library(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, t, int("urgent" in t) if rng.random() < 0.9 else rng.randrange(2)) for i, t in enumerate(texts(120))]
    frame = spark.createDataFrame(rows + [(900, "no label", None), (901, None, 0)], "id long, text string, label int").repartition(5)
    counted = body.term_counts(frame.where("label IS NOT NULL").select("text", F.col("label").cast("double").alias("label")), "text", 256)
    last = LogisticRegression(maxIter=20, regParam=0.01, featuresCol="features", labelCol="label")
    library = Pipeline(stages=[IDF(inputCol="tf", outputCol="features"), last]).fit(counted)
    for most in (logistic.MOST_VECTORS, 1):
        monkeypatch.setattr(logistic, "MOST_VECTORS", most)
        model = body.fit_urgency(frame, features=256)
        assert model.weights == pytest.approx(library.stages[0].idf.toArray() * library.stages[1].coefficients.toArray(), abs=1e-9)
        assert model.intercept == pytest.approx(library.stages[1].intercept, abs=1e-9)
    plain = library.transform(body.term_counts(frame, "text", 256)).select("id", F.get(vector_to_array("probability"), F.lit(1)))
    want = dict(map(tuple, plain.collect()))
    for scorer in (model, library):
        got = {r["id"]: r["urgency"] for r in body.score_urgency(scorer, frame).collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_labels_of_one_kind_and_none(spark):
    frame = spark.createDataFrame([("a b", 1), ("c", 1), (None, None)], "text string, label int")
    urgency = lambda df: {r["urgency"] for r in body.score_urgency(body.fit_urgency(df, features=16), df).collect()}
    assert urgency(frame) == {1.0} and urgency(frame.withColumn("label", F.lit(0))) == {0.0}
    with pytest.raises(ValueError, match="no labelled text"):
        body.fit_urgency(frame.where("label IS NULL"), features=16)
    with pytest.raises(ValueError, match="0 and 1"):
        body.fit_urgency(frame.withColumn("label", F.lit(2)), features=16)


def test_training_holds_counts_packed(spark, monkeypatch):
    """What fitting reads again and again takes three bytes an entry; the library kept twelve in memory or on disk."""
    written, plain = [], body.cut_lineage
    monkeypatch.setattr(body, "cut_lineage", lambda df: (written.append(plain(df)), written[-1])[1])
    frame = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts(50))], "text string, label int")
    body.fit_urgency(frame, max_iter=2)
    entries = sum(len(grams.counts(t, 1 << 19)[0]) for t in texts(50))
    size = written[0].select(sum(F.length(c) for c in ("low", "high", "times")).alias("n")).agg(F.sum("n")).first()[0]
    assert len(written) == 1 and size < 3.5 * entries
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_features_write_no_vectors(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate([*texts(40), None])), "doc_id long, text string")
    counted = body.term_counts(docs, "text", 512)
    want = {r["doc_id"]: r["features"] for r in IDF(inputCol="tf", outputCol="features").fit(counted).transform(counted).collect()}
    monkeypatch.setattr(body, "cut_lineage", lambda df: pytest.fail("vectors are written"))
    got = {r["doc_id"]: r["features"] for r in body.urgency_features(docs, features=512).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.array_equal(got[k].indices, v.indices) and np.allclose(got[k].values, v.values, rtol=1e-12, atol=0)
