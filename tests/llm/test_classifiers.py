"""Quality and toxicity: parts of the models, held-out accuracy, odd rows, and that scores do not depend on batches."""

import random
import zlib

import numpy as np
import pytest

from mailrisk.llm import common, quality, toxicity
from mailrisk.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def auc(labels, scores):
    order = sorted(zip(scores, labels, strict=True))
    rank, total, at = {}, 0, 0
    for score, _ in order:
        rank.setdefault(score, []).append(at)
        at += 1
    for score, label in order:
        total += label * (sum(rank[score]) / len(rank[score]) + 1)
    ones = sum(labels)
    return (total - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def held_out_rows(spark, query, label):
    rows = {r.doc_id: r for r in QUERIES[query](spark, FOLDER).collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows.values())
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    return [(r[label], rows[r.doc_id]) for r in labels if rows[r.doc_id].held_out]


def test_toxicity_on_held_out_rows(spark):
    found = held_out_rows(spark, "op8_toxicity", "toxic")
    assert auc([y for y, _ in found], [r.score for _, r in found]) > 0.93
    assert sum(r.predicted for y, r in found if y) / sum(y for y, _ in found) > 0.85
    assert sum(r.predicted for y, r in found if not y) / sum(1 - y for y, _ in found) < 0.02
    assert all(r.predicted == (r.score >= 0.3) for _, r in found)


def test_quality_on_held_out_rows(spark):
    found = held_out_rows(spark, "op6_quality", "quality")
    assert auc([y for y, _ in found], [r.score for _, r in found]) > 0.95
    assert sum(r.predicted == y for y, r in found) / len(found) > 0.95
    assert all(r.predicted == (r.score >= 0.7) for _, r in found)


def test_grammar_weighs_clauses_not_words():
    model = toxicity.fit([])
    weight = lambda text: sum(model.clauses(text))
    assert weight("you are an idiot") > weight("the idiot") > weight("he said idiot") > 0
    assert weight("you are not an idiot") < weight("you are an idiot")
    assert weight("not today as we all know you idiot") == weight("you idiot")  # the negation has ended
    assert weight("I will kill you") > 0 == weight("kill the process")
    assert weight("They never met. You idiot") == weight("You idiot")  # a clause ends at the stop
    assert weight("a plain sentence about you") == 0 == weight("")
    assert len(model.clauses("You idiot! You moron; you scum")) == 3


def test_lexicon_learns_words_and_stems():
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(["stone", "river", "glass", "paper"]) for _ in range(20))
    sample = [(f"{plain()} grumbl{rng.choice('abcdefg')}{rng.choice('xyz')} zork {plain()}", 1) for _ in range(40)] + [(plain(), 0) for _ in range(200)]
    model = toxicity.fit(sample)
    assert model.entry("zork")[0] == toxicity.INSULT == model.entry("grumblqq")[0]
    assert model.entry("stone")[0] == toxicity.OTHER
    assert model.score("the zork of glass") > 0.5 > model.score("the river of glass")


def test_chunks_cover_the_whole_text():
    for size in (0, 1, 31, 32, 33, 255, 256, 257, 480, 481, 5000):
        data = bytes(i % 251 for i in range(size))
        made = quality.chunks(data)
        step = quality.CHUNK - quality.OVERLAP
        back = b"".join(c[: step if i < len(made) - 1 else None].tobytes() for i, c in enumerate(made))
        assert back[:size] == data and not any(back[size:])


def test_gradients():
    rng = np.random.default_rng(0)
    model = quality.fit([])
    model.embedding = rng.normal(0, 0.5, model.embedding.shape)
    model.filters = rng.normal(0, 0.3, model.filters.shape)
    model.weights = rng.normal(0, 0.5, model.weights.shape)
    picked = [quality.chunks(rng.bytes(700)) for _ in range(3)]
    y, balance = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        total = 1e-4 / 2 * (model.weights**2).sum()
        for block, label, weight in zip(picked, y, balance, strict=True):
            got = model.respond(block)
            p = 1 / (1 + np.exp(-model.logit(got.mean(axis=0), got.max(axis=0))))
            total -= weight / len(y) * np.log(p if label else 1 - p)
        return total

    gradients = quality._gradients(model, picked, y, balance)
    for part, gradient in ((model.weights, gradients[3]), (model.filters, gradients[1]), (model.embedding, gradients[0])):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in part.shape)
            kept, small = part[at], 1e-6
            part[at] = kept + small
            up = loss()
            part[at] = kept - small
            down = loss()
            part[at] = kept
            assert abs((up - down) / (2 * small) - gradient[at]) < 1e-4


def test_quality_scores_do_not_depend_on_their_batch():
    rng = random.Random(2)
    sample = [(" ".join(rng.choice(["one", "two", "three"]) for _ in range(60)), 1) for _ in range(60)]
    sample += [("%%% ".join(rng.choice(["one", "two", "three"]) for _ in range(60)), 0) for _ in range(60)]
    model = quality.fit(sample)
    texts = [t.encode() for t, _ in sample] + [b"", b"x", b"long text " * 40000]
    together = model.scores(texts)
    assert np.abs(together - np.array([model.score(t) for t in texts])).max() <= 2e-6
    labels = np.array([y for _, y in sample])
    assert ((together[: len(labels)] >= 0.7) == labels).mean() > 0.95


@pytest.mark.parametrize("operator,column", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, operator, column):
    rows = [(1, None, 0.5, "a"), (1, "", 0.5, "a"), (None, "you idiot", None, "b"), (None, "you idiot", None, "b"), (5, "word " * 100000, 1.0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], f"doc_id long, {column} int")
    for frame in (docs, docs.limit(0)):
        model = operator.fit_tables(frame, labels)
        got = operator.score(frame, model).collect()
        assert len(got) == frame.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    same = {r.score for r in operator.score(docs, model).collect() if not r.text}
    assert len(same) == 1, "null and empty texts score alike"


def test_drop_toxic_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "you idiot, you moron. you scum", 7.0, "x"), (2, "fine", 8.0, "y")], "doc_id long, text string, score double, predicted string")
    kept = toxicity.drop_toxic(docs, toxicity.fit([]))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "fine", 8.0, "y")]


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    sample = common.labelled_sample(docs, labels, "toxic", 100, 3000)
    assert len(sample) == 100 and all(len(t.encode()) <= 3000 for t, _ in sample)
    out = {r.text for r in docs.join(labels.where(common.held_out("doc_id")), "doc_id").select("text").collect()}
    ins = {r.text for r in docs.join(labels.where(~common.held_out("doc_id")), "doc_id").select("text").collect()}
    assert all(t in ins for t, _ in sample) and len({t for t, _ in sample} & (out - ins)) == 0
