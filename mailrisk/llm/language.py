"""Language identification: known words first, shorter and shorter character n-grams for others.

A model holds words and n-grams with their log frequency in each language. A word of a text that
the model knows counts by these frequencies. An unseen word is padded by a space on both sides and
counts by its known n-grams of the longest order of which it has any, on average per n-gram. The
probability of a language is that of the sum over the words of a text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.session import cut_lineage, if_small

#: Letters, with the marks that follow them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same for texts of these characters only, where there are no marks.
LATIN_TEXT, LATIN_WORD = re.compile("[\0-\u024f]*"), re.compile("[A-Za-zªµºÀ-ÖØ-öø-\u024f]+")
ORDERS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
#: Languages whose shares are broadcast.
MAX_LANGUAGES = 10_000
SMOOTHING = 0.5
#: What a worker holds at once: words of one text, and scored words.
WORDS_AT_ONCE, MAX_SCORED = 100_000, 500_000


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, at most WORDS_AT_ONCE at a time."""
    pattern = LATIN_WORD if LATIN_TEXT.fullmatch(text) else WORD
    if len(text) <= WORDS_AT_ONCE:
        yield pattern.findall(text)
    else:
        found = (m.group() for m in pattern.finditer(text))
        while some := list(islice(found, WORDS_AT_ONCE)):
            yield some


def grams(word: str, order: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


@dataclass
class LanguageModel:
    languages: list[str]
    priors: np.ndarray  # log share of the training texts
    words: dict[str, int]  # row of `logs`
    grams: dict[str, int]  # the same, of every order
    logs: np.ndarray  # log frequency of a word or n-gram in each language

    def evidence_rows(self, word: str) -> list[int]:
        """Rows whose mean is the evidence of a lower-case word; none when nothing of it is known."""
        if (row := self.words.get(word)) is not None:
            return [row]
        get, padded = self.grams.get, f" {word} "
        for order in ORDERS:
            known = [row for i in range(len(padded) - order + 1) if (row := get(padded[i : i + order])) is not None]
            if known:
                return known
        return []

    def evidence(self, words: list[str]) -> np.ndarray:
        """Mean log frequencies of each lower-case word in each language; zeros when nothing of it is known."""
        rows = [self.evidence_rows(w) for w in words]
        counts = np.array([len(r) for r in rows], np.int64)
        out = np.zeros((len(words), len(self.languages)))
        known = counts > 0
        if known.any():
            flat = np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum()))
            starts = np.r_[0, np.cumsum(counts[known])[:-1]]
            out[known] = np.add.reduceat(self.logs[flat], starts) / counts[known, None]
        return out


class _Rows(dict):
    """Words to rows, in order; a missing one gets the next."""

    def __missing__(self, word: str) -> int:
        made = self[word] = len(self)
        return made


class Scorer:
    """Scores texts with a model; evidence of words met before is kept up to a bound."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.rows = _Rows()
        self.table = np.empty((0, len(model.languages)))

    def found(self, words: list[str]) -> np.ndarray:
        """Evidence of each word, one row per word."""
        if len(self.rows) > MAX_SCORED:
            self.rows, self.table = _Rows(), self.table[:0]
        before = len(self.table)
        at = list(map(self.rows.__getitem__, words))
        if len(self.rows) > before:
            missing = islice(self.rows, before, None)
            self.table = np.concatenate([self.table, self.model.evidence([w.lower() for w in missing])])
        return self.table[at]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of whole texts, whose words are looked up some at a time."""
        totals, counts = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        words: list[str] = []
        owner: list[tuple[int, int]] = []

        def flush() -> None:
            if words:
                at = np.repeat(*np.array(owner).T)
                found = self.found(words)
                for k in range(totals.shape[1]):
                    totals[:, k] += np.bincount(at, found[:, k], len(texts))
                words.clear()
                owner.clear()

        for i, text in enumerate(texts):
            for some in words_of(text or ""):
                words.extend(some)
                owner.append((i, len(some)))
                counts[i] += len(some)
                if len(words) >= WORDS_AT_ONCE:
                    flush()
        flush()
        return [self._best(total, n) for total, n in zip(totals, counts, strict=True)]

    def _best(self, total: np.ndarray, words: int) -> tuple[str, float]:
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        total = total + self.model.priors
        best = int(total.argmax())
        # Rounded: sums of other batches may differ in their last bits.
        return self.model.languages[best], round(float(1 / np.exp(total - total[best]).sum()), 6)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def training_fold(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def sample(documents: DataFrame, rows: int, max_bytes: int) -> DataFrame:
    """(lang, text): about `rows` training texts of each language, those with the smallest hashes.

    The share of a language's texts that is taken follows from their number, which is counted
    over all documents; no row meets others of its language for it, however frequent that is.
    """
    usable = documents.where(
        training_fold() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    # One row per language that occurs; texts stay where they are unless there are very many.
    shares = if_small(cut_lineage(usable.groupBy("lang").agg((F.lit(float(rows)) / F.count("*")).alias("share"))), MAX_LANGUAGES)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return usable.select("lang", "text", place.alias("place")).join(shares, "lang").where("place < share").select("lang", "text")


def _counted(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        count(counts, batch)
        if counts:
            langs, terms, orders = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(terms, pa.string()), pa.array(orders, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "term", "n", "times"])


def _count_words(counts: Counter, batch: pa.RecordBatch) -> None:
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        for word, times in Counter(w.lower() for some in words_of(text) for w in some).items():
            counts[lang, word, 0] += times


def _count_grams(counts: Counter, batch: pa.RecordBatch) -> None:
    columns = (batch.column(name).to_pylist() for name in ("lang", "term", "times"))
    for lang, word, times in zip(*columns, strict=True):
        for order in ORDERS:
            for gram in grams(word, order):
                counts[lang, gram, order] += times


def fit_tables(documents: DataFrame, rows: int = 1500, max_bytes: int = 32768, max_words: int = 60_000,
               max_grams: int = 40_000) -> LanguageModel:
    """Learns from the documents of the training fold with a language and a text.

    Bounds, all of them parameters: about `rows` texts of at most `max_bytes` bytes of each
    language, and of what these hold the `max_words` most frequent words and the `max_grams` most
    frequent n-grams of each order. Rows with null id, language or text teach nothing; without any
    row left, every text is undetermined.
    """
    taken = sample(documents, rows, max_bytes)
    schema = "lang string, term string, n int, times long"

    def summed(frame: DataFrame, count) -> DataFrame:
        return frame.mapInArrow(lambda batches: _counted(batches, count), schema).groupBy("lang", "term", "n").agg(F.sum("times").alias("times"))

    words = cut_lineage(summed(taken, _count_words))
    languages = taken.groupBy("lang").count().collect()  # one row per language

    def top(counts: DataFrame, limit: int) -> list:
        ranked = counts.groupBy("term", "n").agg(F.sum("times").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "times"))).alias("by"))
        return ranked.orderBy(F.desc("all"), "term").limit(limit).toArrow().to_pylist()

    found = top(words, max_words)
    parts = cut_lineage(summed(words, _count_grams))
    for order in ORDERS:
        found += top(parts.where(F.col("n") == order), max_grams)
    return build({r["lang"]: r["count"] for r in languages}, ((r["n"], r["term"], dict(r["by"])) for r in found))


def build(texts: dict[str, int], counts: Iterable[tuple[int, str, dict[str, int]]]) -> LanguageModel:
    """A model from the texts per language and (order, term, times per language); order 0 is a word."""
    languages = sorted(texts)
    share = np.array([texts[lang] for lang in languages], float)
    place = {lang: i for i, lang in enumerate(languages)}
    by_order: dict[int, list[tuple[str, np.ndarray]]] = defaultdict(list)
    for order, term, times in counts:
        row = np.full(len(languages), SMOOTHING)
        for lang, n in times.items():
            row[place[lang]] += n
        by_order[order].append((term, row))
    words: dict[str, int] = {}
    grams_: dict[str, int] = {}
    logs = [np.zeros((0, len(languages)))]
    for order, rows in by_order.items():
        kept, first = (grams_ if order else words), sum(map(len, logs))
        kept.update((term, first + i) for i, (term, _) in enumerate(rows))
        table = np.array([row for _, row in rows])
        logs.append(np.log(table) - np.log(table.sum(axis=0)))
    priors = np.log(share / share.sum()) if languages else share
    return LanguageModel(languages, priors, words, grams_, np.concatenate(logs))


def identify(documents: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents with `lang_pred` and `score`, its probability; columns of these names are replaced.

    Whole texts are read, nothing but the text is used. A text that is null or has no letter is
    `und` with score 0, as is any text if the model knows no language. A text of which nothing is
    known gets the most frequent language with its share. Of equal languages the first by name is
    taken. Rows are independent: repeated rows are scored alike, and there is no shuffle.
    """
    kept = documents.drop("lang_pred", "score")
    names = kept.columns
    schema = ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in kept.dtypes), "lang_pred string", "score double"])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = scorer.predict_all(batch.column(text_col).to_pylist())
            langs, scores = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents by a model of the training fold."""
    model = fit_tables(documents)
    return identify(documents.select("doc_id", "text"), model).select("doc_id", (~training_fold()).alias("held_out"), "lang_pred", "score")
