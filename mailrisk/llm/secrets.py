"""Secret scans: fixed patterns, and formats learnt from labelled credentials by grammar inference.

For each kind of credential a prefix tree of its examples is built. States whose next-symbol
frequencies are statistically compatible (Hoeffding bound, recursively) are merged, which
gives a probabilistic deterministic automaton. Every token of a text that is as long as the
shortest example is a candidate: its likelihood per character under the automaton of each kind is set
against that under a bigram model of the ordinary tokens, long and short ones apart, and a
candidate that does as well as nearly all examples do is reported beside the fixed patterns' spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.session import cut_lineage

#: The patterns of the query's contract, with the shortest match that counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_SHORTEST, ACCESS_SHORTEST, HEX_SHORTEST = 6, 20, 24
KINDS = ("assign", "access", "hex")
#: Any match of ASSIGN holds one of these, in either case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Candidates of the learnt formats: of any kind from LONG characters on, of kinds with shorter examples from theirs on.
LONG, SHORTEST = 20, min(ASSIGN_SHORTEST, ACCESS_SHORTEST, HEX_SHORTEST)
#: Short tokens whose kind a scanner remembers.
TOKENS_KEPT = 1 << 17
#: Different examples that a kind needs for an automaton.
FEWEST = 10
#: An arc that fewer than one in STATES examples take gets no state of its own; beginnings of up to DEPTH characters are counted in one round.
STATES, DEPTH = 2000, 64
#: Counts that a task holds at once, rates that are gathered to be ordered, and ranges that more are counted in.
COUNTS_HELD, GATHERED, PARTS = 1 << 16, 10_000, 4096
#: Characters of different tokens that a task holds between batches.
CHARS_HELD = 1 << 23
#: What the learnt kinds are called in a span, after the kind whose examples they come from.
LEARNT = {kind: f"like_{kind}" for kind in KINDS}
ORDER = {kind: i for i, kind in enumerate((*KINDS, *LEARNT.values()))}

Span = tuple[int, int, str]  # start, end (code points, exclusive), kind


# --- fixed patterns -----------------------------------------------------------------


def base_spans(text: str) -> list[tuple[Span, str]]:
    """Spans of the fixed patterns, by start and kind, each with the credential it holds."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [((m.start(), m.end(), "assign"), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_SHORTEST]
    if "AKIA" in text:
        found += [((m.start(), m.end(), "access"), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_SHORTEST]
    # A run of 24 or more is one match either way, since a match takes the whole run.
    found += [((m.start(), m.end(), "hex"), m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0][0], ORDER[x[0][2]]))


def covers(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that spans, ordered by start, cover; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def candidates(text: str, pattern: re.Pattern, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, token, touches) of the tokens that are not wholly covered; touches: partly covered."""
    at = 0
    for match in pattern.finditer(text):
        start, end = match.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        touches = at < len(covered) and covered[at][0] < end
        if not (touches and covered[at][0] <= start and end <= covered[at][1]):
            yield start, end, match.group(), touches


def tokens_of(shortest: int, longest: int | None = None) -> re.Pattern:
    """Whole runs of the characters that credentials have, of so many characters."""
    symbol = "[A-Za-z0-9+/_.=-]"
    if longest is None:
        return re.compile(f"(?<!{symbol}){symbol}{{{shortest},}}")
    return re.compile(f"(?<!{symbol}){symbol}{{{shortest},{longest}}}(?!{symbol})")


def has_words_of(shortest: int, text: str) -> bool:
    """Whether there can be such a token: quicker than the pattern where there are few."""
    return any(len(word) >= shortest for word in text.split())


# --- grammar inference ----------------------------------------------------------------


@dataclass
class Automaton:
    """States with arcs symbol -> (next, probability), and the probability to end. State 0 begins."""

    arcs: list[dict[str, tuple[int, float]]]
    ends: list[float]
    #: What a symbol that a state has no arc for costs; the state is kept.
    unseen: float

    def log_likelihood(self, token: str, whole: bool = True) -> float:
        """Of the token, or without `whole` of any token that begins so."""
        state, total = 0, 0.0
        for symbol in token:
            state, probability = self.arcs[state].get(symbol, (state, self.unseen))
            total += math.log(probability)
        return total + math.log(max(self.ends[state], self.unseen)) if whole else total


class _Tree:
    """A frequency prefix tree, and the merging of its states. What follows an open state is not known."""

    def __init__(self, examples: Iterable[str] = ()) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.open: set[int] = set()
        for example in examples:
            at = 0
            for symbol in example:
                self.flow[at][symbol] = self.flow[at].get(symbol, 0) + 1
                following = self.arcs[at].get(symbol)
                if following is None:
                    following = self.arcs[at][symbol] = self.added()
                at = following
            self.ends[at] += 1

    def added(self) -> int:
        """A new state."""
        self.arcs.append({})
        self.flow.append({})
        self.ends.append(0)
        return len(self.arcs) - 1

    def total(self, state: int) -> int:
        return self.ends[state] + sum(self.flow[state].values())

    def compatible(self, one: int, other: int, alpha: float) -> bool:
        """Equal frequencies as far as the counts can tell, here and in all states that follow both."""
        todo = [(one, other)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for symbol in self.flow[a].keys() | self.flow[b].keys():
                if abs(self.flow[a].get(symbol, 0) / n - self.flow[b].get(symbol, 0) / m) > bound:
                    return False
                if symbol in self.arcs[a] and symbol in self.arcs[b]:
                    following = self.arcs[a][symbol], self.arcs[b][symbol]
                    if following[0] != following[1]:
                        todo.append(following)
        return True

    def fold(self, into: int, state: int) -> None:
        """Adds the subtree of a state, which is still a tree, to another state."""
        todo = [(into, state)]
        while todo:
            a, b = todo.pop()
            if b not in self.open:
                self.open.discard(a)
            self.ends[a] += self.ends[b]
            for symbol, n in self.flow[b].items():
                self.flow[a][symbol] = self.flow[a].get(symbol, 0) + n
                if symbol in self.arcs[a]:
                    todo.append((self.arcs[a][symbol], self.arcs[b][symbol]))
                else:
                    self.arcs[a][symbol] = self.arcs[b][symbol]


def _grow(tree: _Tree, kept: list[int], alpha: float, least: int = 1) -> None:
    """Merges states of the tree, from the kept ones outwards, into those, or keeps them too.

    Arcs to open states and those that fewer than `least` examples take stay as they are.
    """
    fringe = [(k, s) for k in kept for s in sorted(tree.arcs[k]) if tree.arcs[k][s] not in kept]
    while fringe:
        # The busiest state next: what it is merged with is known best.
        fringe.sort(key=lambda x: (tree.flow[x[0]].get(x[1], 0), x[1]))
        parent, symbol = fringe.pop()
        state = tree.arcs[parent][symbol]
        if state in kept or state in tree.open or tree.flow[parent][symbol] < least:
            continue
        same = next((k for k in kept if tree.compatible(k, state, alpha)), None)
        if same is None:
            kept.append(state)
            fringe += [(state, s) for s in sorted(tree.arcs[state])]
        else:
            tree.arcs[parent][symbol] = same
            tree.fold(same, state)
            waiting = set(fringe)
            fringe += [(k, s) for k in kept for s in sorted(tree.arcs[k]) if tree.arcs[k][s] not in kept and (k, s) not in waiting]


def _automaton(arcs: list[dict[str, int]], flow: list[dict[str, int]], ends: list[int], examples: int) -> Automaton:
    """Probabilities from how many of the examples take each arc, and end in each state."""
    symbols = max(2, len({s for taken in flow for s in taken}))
    made, finals = [], []
    for following, taken, end in zip(arcs, flow, ends, strict=True):
        # Half a count for each symbol that the kind uses, so that one more example would not be a surprise.
        total = end + sum(taken.values()) + 0.5 * symbols
        made.append({s: (following[s], (n + 0.5) / total) for s, n in taken.items()})
        finals.append(end / total)
    length = sum(sum(taken.values()) for taken in flow) / max(1, examples)
    return Automaton(made, finals, 0.5 / (length * 100 + symbols))


def infer(examples: list[str], alpha: float = 0.05) -> Automaton:
    """Merges states of the prefix tree, from the start outwards, into the states already kept."""
    tree, kept = _Tree(examples), [0]
    _grow(tree, kept, alpha)
    number = {state: i for i, state in enumerate(kept)}
    arcs = [{s: number[t] for s, t in tree.arcs[k].items()} for k in kept]
    return _automaton(arcs, [tree.flow[k] for k in kept], [tree.ends[k] for k in kept], len(examples))


# --- the same over a table --------------------------------------------------------------

Arcs = list[dict[str, int]]


def _walks(values: DataFrame, machines: dict[str, Arcs], least: dict[str, int]) -> dict[str, _Tree]:
    """Trees of all values(kind, value): the kept states first, counted, and below each arc that is still missing what follows it.

    A value walks through the kept states of its kind until an arc is missing. How many take each arc or end
    is counted, and behind a missing arc each beginning of the rest. Beginnings that fewer than `least`
    values have in common, and those of over DEPTH characters, are open states. With one added up row per beginning, the driver
    gets at most DEPTH times STATES of a kind.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arcs, state = machines[kind], 0
                for at, symbol in enumerate(value):
                    found[kind, state, "", "", symbol] += 1
                    if symbol not in arcs[state]:
                        for end in range(at + 1, min(at + 1 + DEPTH, len(value) + 1)):
                            found[kind, state, symbol, value[at + 1 : end], value[end : end + 1]] += 1
                        break
                    state = arcs[state][symbol]
                else:
                    found[kind, state, "", "", ""] += 1
                if len(found) > COUNTS_HELD:
                    yield _count_rows(found)
                    found.clear()
        yield _count_rows(found)

    taken = values.mapInArrow(run, "kind string, state int, missing string, begins string, next string, n long")
    place = ["kind", "state", "missing", "begins"]
    states = taken.groupBy(*place, "next").agg(F.sum("n").alias("n")).groupBy(*place).agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("next", "n")).alias("taken"))  # one entry per symbol
    enough = reduce(lambda one, other: one | other, [(F.col("kind") == kind) & (F.col("n") >= n) for kind, n in least.items()])
    trees = {}
    for kind, arcs in machines.items():
        tree = trees[kind] = _Tree()
        for _ in arcs[1:]:
            tree.added()
        for state, following in enumerate(arcs):
            tree.arcs[state] = dict(following)
    at = {}
    # As Arrow: the rows of a whole tree are many, and take ten times as much as objects.
    rows = states.where((F.col("missing") == "") | enough).toArrow()
    kinds, froms, missings, starts = (rows[c].to_pylist() for c in place)
    # Shorter beginnings first, so that the state before is there.
    for i in sorted(range(len(kinds)), key=lambda i: (missings[i] != "", len(starts[i]))):
        kind, state, missing, begins = kinds[i], froms[i], missings[i], starts[i]
        following = [(x["next"], x["n"]) for x in rows["taken"][i].as_py()]
        tree = trees[kind]
        here = at[kind, state, missing, begins] if missing else state
        tree.open.discard(here)
        for symbol, n in sorted(following):
            if not symbol:
                tree.ends[here] = n
                continue
            tree.flow[here][symbol] = n
            if symbol not in tree.arcs[here]:
                new = tree.arcs[here][symbol] = tree.added()
                tree.open.add(new)
                at[kind, state, missing or symbol, begins + symbol if missing else ""] = new
    return trees


def _count_rows(found: Counter) -> pa.RecordBatch:
    names = ["kind", "state", "missing", "begins", "next", "n"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*((*place, n) for place, n in found.items()), strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def infer_tables(values: DataFrame, counts: dict[str, int], alpha: float = 0.05) -> dict[str, Automaton]:
    """`infer` for each kind of all values(kind, value), which are `counts` of each kind.

    Every round all values walk through the states found so far, and the states behind are merged by what the counts of
    all values tell, until no missing arc is taken by one in STATES of the values. Rarer ones lead back to the start, where
    so few counts would be merged. At last all values walk again and give every probability. Up to STATES values of up to
    DEPTH characters, one round sees everything, as `infer` does.
    """
    least = {kind: -(-n // STATES) for kind, n in counts.items()}
    machines: dict[str, Arcs] = {kind: [{}] for kind in counts}
    growing = set(counts)
    while growing:
        some = values.where(F.col("kind").isin(*sorted(growing)))
        for kind, tree in _walks(some, {k: machines[k] for k in growing}, {k: least[k] for k in growing}).items():
            kept = list(range(len(machines[kind])))
            _grow(tree, kept, alpha, least[kind])
            number = {state: i for i, state in enumerate(kept)}
            grown = [{s: number[t] for s, t in tree.arcs[k].items() if t in number} for k in kept]
            if grown == machines[kind]:
                growing.discard(kind)
            machines[kind] = grown
    return _counted(values, machines, counts)


def _counted(values: DataFrame, machines: dict[str, Arcs], counts: dict[str, int]) -> dict[str, Automaton]:
    """The automata, with probabilities from all values. An arc that is missing leads to the start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arcs, state = machines[kind], 0
                for symbol in value:
                    found[kind, state, "", "", symbol] += 1
                    state = arcs[state].get(symbol, 0)
                found[kind, state, "", "", ""] += 1
        yield _count_rows(found)  # one row per state and symbol

    if not machines:
        return {}
    taken = values.where(F.col("kind").isin(*machines)).mapInArrow(
        run, "kind string, state int, missing string, begins string, next string, n long")
    flow = {kind: [{} for _ in arcs] for kind, arcs in machines.items()}
    ends = {kind: [0] * len(arcs) for kind, arcs in machines.items()}
    for r in taken.groupBy("kind", "state", "next").agg(F.sum("n").alias("n")).orderBy("kind", "state", "next").collect():
        if r.next:
            flow[r.kind][r.state][r.next] = r.n
        else:
            ends[r.kind][r.state] = r.n
    return {
        kind: _automaton([{s: arcs[state].get(s, 0) for s in taken} for state, taken in enumerate(flow[kind])], flow[kind], ends[kind], counts[kind])
        for kind, arcs in machines.items()
    }


def nth(rates: DataFrame, n: int) -> float:
    """The n-th smallest, from 0, of all of rates(rate): ranges are counted and the right one is cut again until it is small."""
    while True:
        size = rates.agg(F.count("*").alias("rows"), F.min("rate").alias("low"), F.max("rate").alias("high")).first()
        if size["low"] == size["high"]:
            return size["low"]
        if size["rows"] <= GATHERED:
            return sorted(r.rate for r in rates.select("rate").collect())[n]
        width = (size["high"] - size["low"]) / PARTS
        part = F.least(F.floor((F.col("rate") - size["low"]) / width), F.lit(PARTS - 1))
        for r in rates.groupBy(part.alias("part")).count().orderBy("part").collect():
            if n < r["count"]:
                break
            n -= r["count"]
        rates = rates.where(part == r["part"])


@dataclass
class Background:
    """Bigrams of character classes and characters of ordinary long tokens."""

    pairs: dict[str, float]
    firsts: dict[str, float]
    unseen: float

    def log_likelihood(self, token: str) -> float:
        unseen, pairs = self.unseen, self.pairs
        total = math.log(self.firsts.get(token[:1], unseen))
        return total + sum(math.log(pairs.get(token[i : i + 2], unseen)) for i in range(len(token) - 1))


def bigrams(tokens: Iterable[str]) -> Counter:
    """How often each two characters follow each other, and each character begins."""
    found: Counter = Counter()
    for token in tokens:
        found[token[:1]] += 1
        for i in range(len(token) - 1):
            found[token[i : i + 2]] += 1
    return found


def background(found: dict[str, int]) -> Background:
    """From `bigrams` of all tokens."""
    firsts = {c: n for c, n in found.items() if len(c) == 1}
    pairs = {p: n for p, n in found.items() if len(p) == 2}
    befores: Counter = Counter()
    for pair, n in pairs.items():
        befores[pair[0]] += n
    return Background(
        {p: (n + 0.5) / (befores[p[0]] + 33) for p, n in pairs.items()},
        {c: (n + 0.5) / (sum(firsts.values()) + 33) for c, n in firsts.items()}, 1 / 66,
    )


# --- the scanner -------------------------------------------------------------------


@dataclass
class SecretModel:
    automata: dict[str, Automaton]
    #: Of long tokens, and of shorter ones.
    ordinary: dict[bool, Background]
    #: By kind and whether the token is long. Without a threshold, tokens of that length are not of the kind.
    thresholds: dict[tuple[str, bool], float]
    #: Characters of the shortest candidates.
    shortest: dict[str, int]

    def __post_init__(self) -> None:
        self.least = min(self.shortest.values(), default=LONG)
        self.pattern = tokens_of(self.least)
        self.short_kinds: dict[str, str | None] = {}

    def rate(self, kind: str, token: str) -> float:
        """Log likelihood per character of the kind's format against ordinary tokens, of whatever length."""
        common = self.ordinary[len(token) >= LONG]
        return (self.automata[kind].log_likelihood(token, whole=False) - common.log_likelihood(token)) / len(token)

    def rates(self, kind: str, token: str) -> Iterator[tuple[tuple[str, str], float]]:
        """What thresholds are set by: rates of a labelled credential, or of a short ordinary token (kind '') under each kind."""
        if kind in self.automata:
            yield (kind, "long" if len(token) >= LONG else "short"), self.rate(kind, token)
        elif not kind and len(token) < LONG:
            for other in self.automata:
                if self.shortest[other] <= len(token):
                    yield (other, "usual"), self.rate(other, token)

    def learnt_kind(self, token: str) -> str | None:
        if len(token) >= LONG:
            return self._learnt_kind(token, True)
        if token not in self.short_kinds:
            if len(self.short_kinds) >= TOKENS_KEPT:
                self.short_kinds.clear()
            self.short_kinds[token] = self._learnt_kind(token, False)
        return self.short_kinds[token]

    def _learnt_kind(self, token: str, long: bool) -> str | None:
        kinds = [k for k in self.automata if (k, long) in self.thresholds and len(token) >= self.shortest[k]]
        best = max(((self.rate(k, token) - self.thresholds[k, long], k) for k in kinds), default=(-1.0, ""))
        return best[1] if best[0] >= 0 else None

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans; both by start, then kind.

        A candidate inside base spans is not reported again; one that sticks out of them is scored as a whole.
        """
        base = [span for span, _ in base_spans(text)]
        if not self.automata or not has_words_of(self.least, text):
            return base, base
        added = []
        for start, end, token, _ in candidates(text, self.pattern, covers(base)):
            kind = self.learnt_kind(token)
            if kind:
                added.append((start, end, LEARNT[kind]))
        return base, sorted([*base, *added], key=lambda s: (s[0], ORDER[s[2]])) if added else base


def fit(examples: list[tuple[str, str]], ordinary: list[str], floor: float = 0.5) -> SecretModel:
    """A model of labelled credentials (kind, value) and of ordinary tokens.

    Kinds with fewer than ten different examples are left to the fixed patterns. The threshold
    of a kind is four fifths of what 95 % of its examples reach (a token of the same format but another
    length reaches a little less), at least `floor` nats per character. A kind with examples of fewer than LONG
    characters has a threshold of its own for such tokens, at least what all but one in a
    thousand of the short ordinary tokens stay below.
    """
    common = {long: background(bigrams(t for t in ordinary if (len(t) >= LONG) == long)) for long in (True, False)}
    automata, shortest = {}, {}
    for kind in KINDS:
        values = sorted({v for k, v in examples if k == kind})
        if len(values) >= FEWEST:
            automata[kind] = infer(values)
            shortest[kind] = _shortest(min(map(len, values)))
    model = SecretModel(automata, common, {}, shortest)
    rates: dict[tuple[str, str], list[float]] = {}
    for kind, value in [*examples, *(("", t) for t in ordinary)]:
        for place, rate in model.rates(kind, value):
            rates.setdefault(place, []).append(rate)
    _set_thresholds(model, {place: len(found) for place, found in rates.items()}, lambda place, n: sorted(rates[place])[n], floor)
    return model


class Smallest:
    """The `bound` different values with the smallest hash of those added, the hash being that of F.xxhash64."""

    def __init__(self, bound: int) -> None:
        self.bound, self.held = bound, {}

    def add(self, value: str) -> None:
        if value not in self.held:
            made = xxhash.xxh64_intdigest(value.encode(), 42)
            self.held[value] = made - (1 << 64) if made >> 63 else made
            if len(self.held) > 4 * self.bound + 1000:
                self.held = {v: self.held[v] for v in self.values()}

    def values(self) -> list[str]:
        return sorted(self.held, key=lambda v: (self.held[v], v.encode()))[: self.bound]


def _shortest(length: int) -> int:
    return max(SHORTEST, min(LONG, length))


def _set_thresholds(model: SecretModel, sizes: dict[tuple[str, str], int], rate_at: Callable[[tuple[str, str], int], float], floor: float) -> None:
    """By how many rates there are of each place of `SecretModel.rates`, and what their n-th smallest is."""
    for kind in model.automata:
        # Without long examples, longer tokens of the format are measured by the short ones.
        for long, name in ((True, "long" if (kind, "long") in sizes else "short"), (False, "short")):
            if (kind, name) not in sizes:
                continue
            threshold = max(floor, 0.8 * rate_at((kind, name), sizes[kind, name] // 20))
            usual = sizes.get((kind, "usual"))
            if not long and usual:
                threshold = max(threshold, math.nextafter(rate_at((kind, "usual"), usual - 1 - usual // 1000), math.inf))
            model.thresholds[kind, long] = threshold


def _labelled_tokens(documents: DataFrame, label: bool, shortest: int, longest: int | None = None) -> DataFrame:
    """(kind, value): the different labelled credentials, if asked for, and ordinary tokens of these lengths (kind '')."""
    pattern = tokens_of(shortest, longest)

    def rows(held: set[tuple[str, str]]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[str, str]] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                base = base_spans(text or "")
                if label:
                    held.update((span[2], value) for span, value in base)
                if has_words_of(shortest, text or ""):
                    found = candidates(text or "", pattern, covers([span for span, _ in base]))
                    held.update(("", token) for _, _, token, touches in found if not touches)
            if len(held) > TOKENS_KEPT or sum(len(value) for _, value in held) > CHARS_HELD:
                yield rows(held)
                held.clear()
        yield rows(held)

    return cut_lineage(documents.select("text").mapInArrow(run, "kind string, value string").distinct())


def _bigrams_of(tokens: DataFrame) -> dict[bool, Background]:
    """Backgrounds of all long and all short tokens(value); the driver gets a row per two characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            values = batch.column(0).to_pylist()
            for long, held in found.items():
                held.update(bigrams(v for v in values if (len(v) >= LONG) == long))
        rows = [(long, pair, n) for long, held in found.items() for pair, n in held.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        types = [pa.bool_(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["long", "pair", "n"])

    added = tokens.select("value").mapInArrow(run, "long boolean, pair string, n long").groupBy("long", "pair").agg(F.sum("n").alias("n"))
    rows = added.collect()
    return {long: background({r.pair: r.n for r in rows if r.long == long}) for long in (True, False)}


def _rates(tokens: DataFrame, model: SecretModel) -> DataFrame:
    """(kind, name, rate): `SecretModel.rates` of all tokens(kind, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*place, rate) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for place, rate in model.rates(*row)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            types = [pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "name", "rate"])

    return tokens.mapInArrow(run, "kind string, name string, rate double")


def fit_tables(documents: DataFrame, floor: float = 0.5) -> SecretModel:
    """`fit` on all different credentials that the fixed patterns label in all documents, and on all different other tokens.

    Other tokens are the long ones and, if there are short credentials, those as long as the shortest. Only counts reach the driver:
    of automaton arcs (`infer_tables`), of two characters, of ranges of rates (`nth`).
    """
    tokens = _labelled_tokens(documents, True, LONG)
    sizes = {r.kind: r for r in tokens.where("kind <> ''").groupBy("kind").agg(
        F.count("*").alias("n"), F.min(F.length("value")).alias("least")).collect()}
    short = min((r.least for r in sizes.values()), default=LONG)
    if short < LONG:
        # Ordinary tokens of these lengths are many, and looked for only where credentials have them.
        tokens = tokens.unionAll(_labelled_tokens(documents, False, short, LONG - 1))
    taught = {kind: sizes[kind] for kind in KINDS if kind in sizes and sizes[kind].n >= FEWEST}
    automata = infer_tables(tokens.where("kind <> ''"), {kind: r.n for kind, r in taught.items()})
    model = SecretModel(automata, _bigrams_of(tokens.where("kind = ''")), {}, {kind: _shortest(r.least) for kind, r in taught.items()})
    if not automata:
        return model
    rates = cut_lineage(_rates(tokens, model))
    found = {(r.kind, r.name): r["count"] for r in rates.groupBy("kind", "name").count().collect()}
    _set_thresholds(
        model, found, lambda place, n: nth(rates.where((F.col("kind") == place[0]) & (F.col("name") == place[1])), n), floor)
    return model


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span], mask: str) -> str:
    """The text with every stretch that spans cover replaced by one mask."""
    parts, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(documents: DataFrame, model: SecretModel) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each whole text.

    Null and empty texts have no spans; the hash is then that of the empty string. Repeated rows
    are each scanned; other columns are not read. There is no shuffle.
    """
    source = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = model.spans(text or "")
                counts = [sum(1 for s in base if s[2] == kind) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(documents: DataFrame, model: SecretModel, mask: str = "<secret>") -> DataFrame:
    """The documents with every found secret masked in `text`, and `n_chars` (if there) counted anew.

    All rows and columns stay; a null text stays null. There is no shuffle.
    """
    names = documents.columns
    place = names.index("text")
    schema = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, model.spans(t)[1], mask) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    masked = documents.mapInArrow(run, schema)
    if "n_chars" in names:
        kind = dict(documents.dtypes)["n_chars"]
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*names)
    return masked
