import unicodedata
import zlib

import numpy as np
import pytest

from mailrisk.llm import language
from mailrisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MODEL = language.build({"de": 2, "en": 6}, [
    (0, "the", {"en": 50, "de": 1}), (0, "der", {"de": 40}),
    (5, " unse", {"de": 3}), (2, "th", {"en": 30, "de": 2}), (1, "ß", {"de": 9}), (1, "w", {"en": 4})])


def brute_words(text):
    """Runs of letters, each with the marks that follow it, by Unicode category."""
    words, now = [], ""
    for ch in text:
        kind = unicodedata.category(ch)[0]
        if kind == "L" or (kind == "M" and now):
            now += ch
        else:
            words, now = words + [now] * bool(now), ""
    return words + [now] * bool(now)


def brute_predict(model, text):
    """Word first, then the longest order with a known n-gram; plain sums in Python."""
    words = brute_words(text or "")
    if not words or not model.languages:
        return "und", 0.0
    total = [float(x) for x in model.priors]
    for word in (w.lower() for w in words):
        hits = [model.logs[model.words[word]]] if word in model.words else []
        order = 5
        while not hits and order:
            padded = f" {word} "
            parts = [padded[i : i + order] for i in range(len(padded)) if i + order <= len(padded)]
            hits = [model.logs[model.grams[p]] for p in parts if p in model.grams]
            order -= 1
        for i in range(len(total)):
            total[i] += sum(float(h[i]) for h in hits) / max(1, len(hits))
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    return model.languages[best], 1 / sum(np.exp(t - total[best]) for t in total)


def test_backoff_by_hand():
    got = MODEL.evidence(["the", "unser", "thß", "ßw", "xyz"])
    wanted = [
        np.log([1.5, 50.5]) - np.log([42, 51]),
        np.log([3.5, 0.5]) - np.log([3.5, 0.5]),  # the longest order wins
        np.log([2.5, 30.5]) - np.log([2.5, 30.5]),
        (np.log([9.5, 0.5]) + np.log([0.5, 4.5])) / 2 - np.log([10, 5]),
        [0, 0]]
    assert np.allclose(got, wanted) and MODEL.evidence([]).shape == (0, 2)


def test_texts_and_their_languages():
    scorer = language.Scorer(MODEL)
    assert scorer.predict("Der der DER")[0] == "de"
    assert scorer.predict("the THE, the der")[0] == "en"
    assert scorer.predict("漢字") == ("en", 0.75)  # nothing is known of it: the prior
    for text in (None, "", "  123 _-½²\n", "́"):
        assert scorer.predict(text) == ("und", 0.0)


def test_a_model_without_languages():
    assert language.Scorer(language.build({}, [])).predict("word") == ("und", 0.0)


@pytest.mark.parametrize("text", [
    "the der", "ßw " * 7, "x" * 5000, "Der thé THE wß unse unser", "w" * 39 + " " + "w" * 41, "é1the2der", "ŉ ǅ İstanbul the",
])
def test_scores_equal_brute_force(text):
    lang, score = language.Scorer(MODEL).predict(text)
    wanted = brute_predict(MODEL, text)
    assert lang == wanted[0] and score == pytest.approx(wanted[1], abs=2e-6)


def test_kept_words_change_nothing(monkeypatch):
    texts = ["the der w" + chr(97 + i % 26) * (i % 60) for i in range(200)]
    plain = [language.Scorer(MODEL).predict(t) for t in texts]
    monkeypatch.setattr(language, "MAX_SCORED", 7)
    monkeypatch.setattr(language, "WORDS_AT_ONCE", 2)
    scorer = language.Scorer(MODEL)
    assert [scorer.predict(t) for t in texts] == plain
    assert language.Scorer(MODEL).predict_all(texts) == plain


def test_counts_equal_brute_force(spark):
    rows = [(i, f"Alpha beta{'x' * (i % 3)} gamma, ALPHA", "ab"[i % 2]) for i in range(40)]
    rows += [(41, None, "a"), (42, "delta", None), (None, "delta", "a"), (7, rows[7][1], "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_tables(frame, rows=1000)
    learnt = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[1] and r[2]]
    counts: dict = {}
    for _, text, lang in learnt:
        for word in brute_words(text):
            word = word.lower()
            terms = [(0, word)] + [(n, f" {word} "[i : i + n]) for n in range(1, 6) for i in range(len(word) + 3 - n)]
            for term in terms:
                by = counts.setdefault(term, {})
                by[lang] = by.get(lang, 0) + 1
    plain = language.build({lang: sum(r[2] == lang for r in learnt) for lang in "ab"}, ((n, t, by) for (n, t), by in counts.items()))
    assert model.languages == plain.languages and np.allclose(model.priors, plain.priors)
    for mine, other in ((model.words, plain.words), (model.grams, plain.grams)):
        assert mine.keys() == other.keys() and all(np.allclose(model.logs[mine[k]], plain.logs[other[k]]) for k in mine)


def test_held_out_accuracy_and_whole_table(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_language"](spark, SF).collect()}
    rows = documents.select("doc_id", "text", "lang").collect()
    assert got.keys() == {r.doc_id for r in rows}
    model = language.fit_tables(documents)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        lang, score = brute_predict(model, r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=2e-6)
    held = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_the_label_is_no_input(spark):
    rows = [(i, "the word " * 5, "en", "s") for i in range(20)] + [(i, "das wort " * 5, "de", "s") for i in range(20, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit_tables(frame)
    swapped = spark.createDataFrame([(i, t, "en", "s") for i, t, _, _ in rows], frame.schema)
    pick = lambda f: sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(f, model).collect())
    assert pick(frame) == pick(swapped)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.report(empty).count() == 0
    frame = spark.createDataFrame([(1, "the", "x", 2.0), (1, "the", "x", 2.0), (2, None, None, None)], "doc_id long, text string, lang_pred string, score double")
    found = language.identify(frame, MODEL)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted((r.doc_id, r.lang_pred) for r in found.collect()) == [(1, "en"), (1, "en"), (2, "und")]
    assert {r.lang_pred for r in language.identify(frame, language.fit_tables(empty)).collect()} == {"und"}
