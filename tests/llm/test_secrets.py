"""Secret scans: the fixed patterns against a plain search, inferred formats, redaction."""

import hashlib
import math
import random
import re

from mailrisk.llm import secrets

RNG = random.Random(11)


def hexes(n, size=40):
    return ["".join(RNG.choice("0123456789abcdef") for _ in range(size)) for _ in range(n)]


def slow_base(text):
    found = []
    value = r"""[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"""
    for m in re.finditer(f"({value})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, m.end()))
    for k, (pattern, size) in enumerate(((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)), 1):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= size]
    return [f"{('assign', 'access', 'hex')[k]}:{i}:{j}" for i, k, j in sorted(found)]


TEXTS = [
    "", "plain words", 'token = "' + "ab12" * 10 + '" end', "PassWord:hunter2hunter2 x", "secret=token: abcdefgh", "api_key='a.b-c/d+e=='",
    "ÄÖ apikey = 123456 " + "f" * 30, "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "Z", "xAKIAAKIA" + "Q" * 16, "secret: abc", "token=AKIA" + "B" * 20,
    "ſecret = abcdefgh toKen = abcdefgh", "f" * 23, "f" * 24 + "g" + "0" * 50, "token" + " " * 500 + "=" + " " * 500 + "abcdef",
]


def test_base_spans():
    for text in TEXTS:
        assert [f"{k}:{i}:{j}" for (i, j, k), _ in secrets.base_spans(text)] == slow_base(text), text
    for _ in range(3000):
        text = "".join(RNG.choice(["token", "secret", "api_key", "=", ":", " ", '"', "AKIA", "AB12", "0af3", "x", "é"]) for _ in range(30))
        assert [f"{k}:{i}:{j}" for (i, j, k), _ in secrets.base_spans(text)] == slow_base(text), text


def test_inference_merges_to_the_format():
    machine = secrets.infer(hexes(300))
    assert len(machine.arcs) < 60, "the prefix tree has thousands of states"
    held_out = [machine.log_likelihood(h) / 40 for h in hexes(50)]
    assert min(held_out) > -math.log(16) - 0.5
    assert machine.log_likelihood("thereinghationestore" * 2) / 40 < min(held_out) - 1


def test_inference_keeps_states_that_differ():
    """Of ab* and cd* the states after a and c must not be merged."""
    examples = ["a" + "b" * RNG.randint(1, 9) for _ in range(300)] + ["c" + "d" * RNG.randint(1, 9) for _ in range(300)]
    machine = secrets.infer(examples)
    assert machine.log_likelihood("abbbb") > machine.log_likelihood("abdbd") + 5
    assert machine.log_likelihood("cdddd") > machine.log_likelihood("cbbbb") + 5


WORDS = ["Oneaoutionheertionen", "einstlichenkeitgeachx", "losasmentementementeco", "lichlicherchheitachdeq"] * 30


def test_learnt_spans_beside_base_ones():
    model = secrets.fit([("hex", h) for h in hexes(200)], WORDS)
    bare = hexes(1, 22)[0] + "a"  # too short for the fixed pattern
    text = f"see {bare} and einstlichenkeitgeachx and token = {hexes(1)[0]} end"
    base, spans = model.spans(text)
    assert [k for _, _, k in base] == ["assign", "hex"]
    assert set(base) < set(spans) and (4, 4 + len(bare), "like_hex") in spans and len(spans) == 3
    assert secrets.fit([], []).spans(text)[1] == base


def test_redaction_masks_overlapping_spans_once():
    assert secrets.redacted("abcdefgh", [(1, 4, "assign"), (2, 5, "hex"), (6, 7, "hex")], "*") == "a*f*h"
    assert secrets.redacted("abc", [], "*") == "abc"


def test_rows(spark):
    rows = [(1, None, 3, "a"), (1, "", 0, "a"), (None, TEXTS[2], 9, "b"), (None, TEXTS[2], 9, "b"), (4, "w " * 300000 + TEXTS[2], 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    model = secrets.fit_tables(docs)
    got = secrets.scan(docs, model).collect()
    assert sorted(r.n_assign for r in got) == [0, 0, 1, 1, 1]
    assert {r.base_sha256 for r in got if not r.n_assign} == {hashlib.sha256(b"").hexdigest()}
    kept = secrets.redact(docs, model)
    assert kept.columns == docs.columns and kept.count() == 5
    for r in kept.collect():
        assert r.text is None and r.n_chars == 3 or "token" not in r.text and r.n_chars == len(r.text)
    empty = docs.limit(0)
    assert secrets.scan(empty, secrets.fit_tables(empty)).count() == 0 == secrets.redact(empty, model).count()


def test_labels_of_all_documents_and_kinds_count(spark):
    """A kind in one of 2500 documents, and one of 12 values beside 6000 of a frequent kind, both get an automaton."""
    rare = ["AKIA" + "".join(RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(20)) for _ in range(12)]
    texts = ["plain words"] * 30000 + [f"key {v} here" for v in rare] + ["see " + " ".join(hexes(60)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = secrets.fit_tables(docs)
    assert set(model.automata) == {"access", "hex"}


def test_the_smallest_of_all_are_among_those_of_the_parts(spark):
    values = [f"v{i}é" for i in range(20000)]
    kept, halves = secrets.Smallest(50), [secrets.Smallest(50) for _ in range(2)]
    for i, v in enumerate(values):
        kept.add(v)
        halves[i % 2].add(v)
    table = spark.createDataFrame([(v,) for v in values], "value string")
    ordered = table.selectExpr("value", "xxhash64(value) AS h").orderBy("h", "value").limit(50).collect()
    assert kept.values() == [r.value for r in ordered]
    assert set(kept.values()) <= {v for h in halves for v in h.values()}


def formatted(n):
    return ["KX9-" + hexes(1, 12)[0] + "-" + "".join(RNG.choice("ABCDEFGHJKLM") for _ in range(RNG.randint(6, 9))) for _ in range(n)]


def test_all_credentials_and_tokens_are_counted(spark, monkeypatch):
    """Over a table the model is that of all 3000 credentials of a kind and all 9000 other tokens."""
    values, others = formatted(3000), [f"wort{i:x}undnochmehrworte{i}" for i in range(5000)] + [f"kurz{i:x}" for i in range(4000)]
    texts = [f"token = {v} " + " ".join(others[3 * i : 3 * i + 3]) for i, v in enumerate(values)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    short = min(map(len, values))
    monkeypatch.setattr(secrets, "STATES", 4000)
    monkeypatch.setattr(secrets, "GATHERED", 50)  # so that the n-th smallest is looked for in ranges
    got, want = secrets.fit_tables(docs), secrets.fit([("assign", v) for v in values], [t for t in others if len(t) >= min(short, 20)])
    assert got.automata == want.automata and got.ordinary == want.ordinary
    assert got.thresholds == want.thresholds and got.shortest == want.shortest


def test_rounds_find_the_format_and_count_all(spark, monkeypatch):
    """With few states at a time the format is found in rounds, and its probabilities are those of all values."""
    monkeypatch.setattr(secrets, "STATES", 40)
    monkeypatch.setattr(secrets, "DEPTH", 3)
    values = sorted(set(formatted(3000)))
    table = spark.createDataFrame([("assign", v) for v in values], "kind string, value string").repartition(4)
    machine = secrets.infer_tables(table, {"assign": len(values)})["assign"]
    assert [sorted(a) for a in machine.arcs[:1]] == [["K"]] and len(machine.arcs) < 60
    first = machine.arcs[0]["K"][1]
    assert abs(first - (len(values) + 0.5) / (len(values) + 0.5 * len(set("".join(values))))) < 1e-9
    whole = secrets.infer(values)
    for value in formatted(50):
        assert machine.log_likelihood(value) > whole.log_likelihood(value) - 6
        assert machine.log_likelihood(value) > machine.log_likelihood(value[::-1]) + 20


def test_the_nth_smallest(spark, monkeypatch):
    monkeypatch.setattr(secrets, "GATHERED", 3)
    monkeypatch.setattr(secrets, "PARTS", 4)
    rates = [RNG.gauss(0, 1) for _ in range(300)] + [0.25] * 100
    table = spark.createDataFrame([(r,) for r in rates], "rate double")
    assert [secrets.nth(table, n) for n in (0, 7, 199, 250, 399)] == [sorted(rates)[n] for n in (0, 7, 199, 250, 399)]


SYMBOLS = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def short_tokens(n, size=12):
    return ["-".join("".join(RNG.choice(SYMBOLS) for _ in range(4)) for _ in range(size // 4)) for _ in range(n)]


SHORT_WORDS = ["heertionen", "einstlichen", "losasme", "lichlich", "teachers", "ordinary", "language", "between", "because"]


def test_short_credentials_are_learnt_and_found(spark):
    """Values of 14 characters after a keyword teach the format; bare ones are found, ordinary words are not."""
    texts = [f"token = {v} and " + " ".join(RNG.choices(SHORT_WORDS, k=20)) for v in short_tokens(300)]
    model = secrets.fit_tables(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert model.shortest == {"assign": 14}
    bare = short_tokens(40)
    base, spans = model.spans("see " + " because ".join(bare) + " einstlichenkeit lichlichlichli")
    assert not base and len(spans) >= 36 and {k for _, _, k in spans} == {"like_assign"} and all(j - i == 14 for i, j, _ in spans)
    six = secrets.fit([("assign", v[:6]) for v in short_tokens(300)], SHORT_WORDS * 30)
    assert six.shortest == {"assign": 6} and not six.spans("teachers ordinary language between short")[1]


def test_a_credential_round_a_fixed_span_is_whole():
    """The rest of a longer credential round a hex run is reported and masked."""
    make = lambda: "KX9-" + hexes(1, 24)[0] + "-" + "".join(RNG.choice(SYMBOLS) for _ in range(12))
    model = secrets.fit([("assign", make()) for _ in range(300)], WORDS)
    value = make()
    text = f"see {value} end"
    base, spans = model.spans(text)
    assert [k for _, _, k in base] == ["hex"] and (4, 4 + len(value), "like_assign") in spans
    assert secrets.redacted(text, spans, "*") == "see * end"
    assert model.spans(f"token = {value}")[1] == model.spans(f"token = {value}")[0], "inside a base span"


def test_query(spark):
    from mailrisk.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op7_secrets"](spark, folder).collect()
    assert len(rows) == len(texts) and sum(r.n_hex for r in rows) > 0
    for r in rows:
        base = slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(r.spans.split(",") if r.spans else [])
