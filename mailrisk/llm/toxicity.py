"""Toxicity by a weighted grammar of clauses.

Words become symbols (insult, threat, target, negation, reporting verb, other). Four small
weighted transducers rewrite a clause's symbols one after the other; they are composed into
one machine, whose states are made as clauses need them:

* reporting: what follows a reporting verb in a clause is quoted, and weighs less;
* negation: an insult or threat within a few words after a negation is denied;
* target: an insult or threat in a clause that names a person addressed is aimed;
* scorer: sums the weights of what is left.

A document's score is a logistic function of its clauses: the strongest clause, the sum and
the number of matched ones, and the size of the text. Seeds of the lexicon are fixed; words that occur in toxic
training texts far more often than in others are learnt as insults, with the weight of
their evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.common import labelled_sample

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

SEEDS = {
    INSULT: "idiot moron stupid loser scum trash worthless pathetic disgusting imbecile dumb "
            "dummkopf arschloch idiote connard imbécile estúpido idiota imbécil",
    THREAT: "kill hurt destroy burn beat shoot stab murder töten umbringen tuer frapper matar golpear",
    TARGET: "you your yours yourself u du dich dir ihr euch tu toi te vous tú usted ustedes they them",
    NEGATION: "not no never nobody don't isn't aren't wasn't won't nicht kein keine nie ne pas jamais nunca",
    REPORT: "said says say told tells wrote called calls claimed reported quoted sagte sagt schrieb dit disait dijo dice",
}

WORD_OR_BREAK = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]+")

BREAKS = ".!?;:\n"
#: Lengths of the stems that are learnt beside whole words.
STEMS = (5, 6, 7, 8)

#: How many words after a negation it still denies, and what is left of a quoted or denied weight.
NEGATION_REACH = 3
QUOTED, DENIED, AIMED = 0.5, 0.25, 1.5


class Grammar:
    """The composed transducer. A state is (quoted, words the negation still reaches, target seen)."""

    def __init__(self) -> None:
        self.arcs: dict[tuple[tuple[bool, int, bool], int], tuple[tuple[bool, int, bool], float]] = {}

    def arc(self, state: tuple[bool, int, bool], symbol: int) -> tuple[tuple[bool, int, bool], float]:
        """The next state, and the factor on a weight read on the way; made once per pair."""
        found = self.arcs.get((state, symbol))
        if found is None:
            quoted, reach, aimed = state
            factor = (QUOTED if quoted else 1.0) * (DENIED if reach else 1.0)
            after = (
                quoted or symbol == REPORT,
                NEGATION_REACH if symbol == NEGATION else max(0, reach - 1),
                aimed or symbol == TARGET,
            )
            found = self.arcs[state, symbol] = (after, factor if symbol in (INSULT, THREAT) else 0.0)
        return found

    def clause(self, symbols: list[tuple[int, float]]) -> float:
        """The weight of a clause. A threat needs a target; an insult is stronger with one."""
        state, insults, threats = (False, 0, False), 0.0, 0.0
        for symbol, weight in symbols:
            state, factor = self.arc(state, symbol)
            if symbol == INSULT:
                insults += weight * factor
            elif symbol == THREAT:
                threats += weight * factor
        return insults * (AIMED if state[2] else 1.0) + (threats * AIMED if state[2] else 0.0)


@dataclass
class ToxicityModel:
    lexicon: dict[str, tuple[int, float]]
    bias: float
    coefficients: tuple[float, float, float, float]
    grammar: Grammar = field(default_factory=Grammar, repr=False)

    def __post_init__(self) -> None:
        self.entries: dict[str, tuple[int, float]] = {}

    def entry(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a word; kept for words met before, up to a bound."""
        found = self.entries.get(word)
        if found is None:
            if len(self.entries) > 200_000:
                self.entries.clear()
            found = self.entries[word] = _known(self.lexicon, word) or (OTHER, 0.0)
        return found

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses that the grammar matches."""
        known, found, run, live = self.entries, [], [], False
        for word in WORD_OR_BREAK.findall(text.lower()):
            if word[0] in BREAKS:
                if live:
                    found.append(self.grammar.clause(run))
                run, live = [], False
            else:
                entry = known.get(word) or self.entry(word)
                live = live or entry[0] == INSULT or entry[0] == THREAT
                run.append(entry)
        if live:
            found.append(self.grammar.clause(run))
        return [weight for weight in found if weight > 0]

    def combine(self, clauses: list[float], size: int) -> float:
        return _logistic(self.bias + float(np.dot(self.coefficients, features(clauses, size))))

    def score(self, text: str) -> float:
        return self.combine(self.clauses(text), len(text))


def features(clauses: list[float], size: int) -> np.ndarray:
    """Strongest clause, logs of the summed weight and of the number of matched clauses, and log of the text's size.

    The size counts only beside a match: a long text meets a rare word by chance sooner.
    """
    if not clauses:
        return np.zeros(4)
    return np.array([max(clauses), math.log1p(sum(clauses)), math.log1p(len(clauses)), math.log1p(size) - 7])


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _known(lexicon: dict[str, tuple[int, float]], word: str) -> tuple[int, float] | None:
    """The word's own entry, or that of its longest stem."""
    found = lexicon.get(word)
    if found is None and len(word) >= STEMS[0]:
        for size in reversed(STEMS):
            if len(word) >= size and (found := lexicon.get(word[:size] + "*")):
                break
    return found


def _terms(words: set[str]) -> set[str]:
    """Words, and their stems marked with a star."""
    return words | {w[:size] + "*" for w in words for size in STEMS if len(w) >= size}


def learn_lexicon(sample: list[tuple[str, int]], min_docs: int = 5, min_odds: float = 3.0) -> dict[str, tuple[int, float]]:
    """Seeds, and words or stems that toxic training texts have far more often than others.

    Far more often: in at least `min_docs` toxic texts, with smoothed log odds of at least
    `min_odds`. A stem is a word's start of 5 to 8 letters, so that inflected insults
    which the sample lacks are known as well.
    """
    seen = (Counter(), Counter())
    for text, label in sample:
        seen[label].update(_terms({w for w in WORD_OR_BREAK.findall(text.lower()) if w[0] not in BREAKS}))
    others, toxic = (max(1, sum(1 for _, y in sample if y == k)) for k in (0, 1))
    lexicon = {w: (symbol, 1.0) for symbol, words in SEEDS.items() for w in words.split()}
    for word, n in seen[1].items():
        odds = math.log((n + 0.5) / (toxic + 1)) - math.log((seen[0][word] + 0.5) / (others + 1))
        if n >= min_docs and odds >= min_odds and lexicon.get(word, (INSULT, 0))[0] == INSULT:
            lexicon[word] = (INSULT, max(0.5, min(2.0, odds / 4)))
    return lexicon


def fit(sample: list[tuple[str, int]], steps: int = 400) -> ToxicityModel:
    """A model of labelled texts. Without toxic examples the seeds and default coefficients hold."""
    labels = {y for _, y in sample}
    if labels != {0, 1}:
        model = ToxicityModel(learn_lexicon([]), -3.0, (2.0, 1.0, 0.5, 0.0))
        return model
    model = ToxicityModel(learn_lexicon(sample), 0.0, (0.0, 0.0, 0.0, 0.0))
    x = np.array([features(model.clauses(text), len(text)) for text, _ in sample])
    y = np.array([label for _, label in sample], dtype=float)
    x1, w = np.column_stack([np.ones(len(x)), x]), np.zeros(5)
    ridge = np.array([0.0, 0.5, 0.5, 0.5, 0.5])
    for _ in range(min(steps, 40)):  # Newton's method on the ridge-penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + ridge * w
        hessian = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return ToxicityModel(model.lexicon, float(w[0]), tuple(float(v) for v in w[1:]))


def fit_tables(documents: DataFrame, labels: DataFrame, rows: int = 10000, max_bytes: int = 32768) -> ToxicityModel:
    """Fits on a bounded sample of labelled training rows (see common.labelled_sample)."""
    return fit(labelled_sample(documents, labels, "toxic", rows, max_bytes))


def score(documents: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The documents with `score`, `predicted` and `clauses` (number of matched clauses).

    Null and empty texts have no clause and get the score of the bias alone. Repeated rows
    are each scored. Columns of these three names are replaced; all others stay. Texts
    are scored whole, one row at a time; there is no shuffle.
    """
    kept = documents.drop("score", "predicted", "clauses")
    names = kept.columns
    schema = ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in kept.dtypes), "score double", "predicted int", "clauses int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            matched = [model.clauses(t) for t in texts]
            scores = [model.combine(c, len(t)) for c, t in zip(matched, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32()),
                 pa.array([len(c) for c in matched], pa.int32())],
                names=[*names, "score", "predicted", "clauses"],
            )

    return kept.mapInArrow(run, schema)


def drop_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    own = [c for c in ("score", "predicted", "clauses") if c in documents.columns]
    aside = documents.withColumnsRenamed({c: f"__own_{c}" for c in own})
    kept = score(aside, model, threshold).where(F.col("predicted") == 0).drop("score", "predicted", "clauses")
    return kept.withColumnsRenamed({f"__own_{c}": c for c in own}).select(*documents.columns)
