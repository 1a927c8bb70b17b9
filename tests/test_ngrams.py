"""The Kneser-Ney model against a plain one in Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailrisk.operators import body, ngrams

D = 0.75


class Plain:
    """Interpolated Kneser-Ney over lists of words."""

    def __init__(self, sentences):
        self.pairs = Counter(p for s in sentences for p in zip(["^", *s], s))  # noqa: B905
        self.total, self.kinds, self.after = Counter(), Counter(), Counter()
        for (v, w), n in self.pairs.items():
            self.total[v] += n
            self.after[v] += 1
            self.kinds[w] += 1
        self.unseen = D * len(self.kinds) / len(self.pairs) / (len(self.kinds) + 1)

    def word(self, w):
        return ((self.kinds[w] - D) / len(self.pairs) if w in self.kinds else 0) + self.unseen

    def pair(self, v, w):
        if v not in self.total:
            return self.word(w)
        return max(self.pairs[v, w] - D, 0) / self.total[v] + D * self.after[v] / self.total[v] * self.word(w)

    def nll(self, sentence):
        return -sum(math.log(self.pair(v, w)) for v, w in zip(["^", *sentence], sentence)) / len(sentence)  # noqa: B905


def made(n, words, seed):
    rng = random.Random(seed)
    return [[rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in range(n)]


def texts(spark, sentences, per=3):
    rows = [(f"m{i // per}", i) for i in range(0, len(sentences), per)]
    return spark.createDataFrame(
        [(m, ". ".join(" ".join(s) for s in sentences[i : i + per])) for m, i in rows], "message_id string, body_text string")


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_scores_equal_the_plain_model(spark, broadcast):
    known = made(300, "a b c d e f the of é 7".split(), 1)
    asked = made(120, "a b c the of new other x".split(), 2)
    plain, lm = Plain(known), body.fit_ngram_lm(texts(spark, known), "body_text", order=2)
    got = {(r["message_id"], r["sentence"]): r for r in body.sentence_scores(texts(spark, asked), lm, order=2, broadcast_words=broadcast).collect()}
    assert len(got) == len(asked)
    for i, sentence in enumerate(asked):
        row = got[f"m{i // 3}", i % 3]
        assert row["tokens"] == len(sentence) and row["nll"] == pytest.approx(plain.nll(sentence)), sentence


def test_probabilities_sum_to_one(spark):
    known = made(60, "a b c d e".split(), 3)
    plain = Plain(known)
    for v in [*plain.total, "never"]:
        assert sum(plain.pair(v, w) for w in [*plain.kinds, "unseen"]) == pytest.approx(1)
    lm = {r["token"]: math.exp(-r["nll"]) for r in body.fit_ngram_lm(texts(spark, known), "body_text", order=2).collect()}
    for v in plain.total:
        seen = sum(p for t, p in lm.items() if t and t.startswith(f"{v} ") and not t.endswith(" "))
        others = sum(lm[f" {w}"] for w in plain.kinds if f"{v} {w}" not in lm) + lm[None]
        assert seen + lm[f"{v} "] * others == pytest.approx(1)


def test_odd_corpora(spark):
    none = spark.createDataFrame([("m", None), ("n", ""), ("o", " .. !")], "message_id string, body_text string")
    empty = body.fit_ngram_lm(none, "body_text", order=2)
    assert [tuple(r) for r in empty.collect()] == [(None, 0.0)]
    asked = spark.createDataFrame([("m", "one two"), ("n", None)], "message_id string, body_text string")
    assert [tuple(r) for r in body.sentence_scores(asked, empty, order=2).collect()] == [("m", 0, 2, 0.0)]
    lm = body.fit_ngram_lm(asked, "body_text", order=2)
    assert body.sentence_scores(none, lm, order=2).count() == 0
    cut = body.sentence_scores(asked, lm, order=2, max_tokens=1).collect()
    assert [(r["message_id"], r["tokens"]) for r in cut] == [("m", 1)]
    for wrong in (0, 1):
        with pytest.raises(ValueError, match="discount"):
            ngrams.fit(none, discount=wrong)
    with pytest.raises(ValueError, match="orders"):
        body.fit_ngram_lm(asked, "body_text", order=3)


def test_a_hot_pair_is_summed_before_it_moves(spark):
    """A third of all words are one pair: counts leave each task once per kind."""
    frame = spark.range(6000, numPartitions=6).select(F.lit("hot pair").alias("text"), F.col("id"))
    counts = ngrams.pair_counts(ngrams.sentence_pairs(body.sentence_words(frame, "text")))
    assert sorted(tuple(r) for r in counts.collect()) == [("^", "hot", 6000), ("hot", "pair", 6000)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 1 and plan.index("partial_count") > plan.index("Exchange")
