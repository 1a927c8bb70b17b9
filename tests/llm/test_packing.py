"""Packing: ids against the tokenizer library, plans that hold every document, gapless sequences."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mailrisk.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = packing.word_ids(PATH)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own_ids(text):
    return np.frombuffer(WORDS.encode([text.encode()])[0], "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert own_ids(text) == library_ids(text)


def test_special_texts():
    rng = random.Random(3)
    words = ["don't", "we'll.", "<|endoftext|>", "a<|startoftext|>b,", "İstanbul", "ΣΑΣ.", "Ω", "K", "é", "한글", "x1y2", "%%%", "end.)", "'s", "naïve!!", "ß",
             "日本語", "\x1c", "\x85", "\xa0x", "THE.", "|", "ﬁ", "ǅ", "a" * 300]
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", ""]) for _ in range(rng.randint(0, 12)))
        assert own_ids(text) == library_ids(text), text


def test_bounds_have_no_effect(monkeypatch):
    monkeypatch.setattr(packing, "MAX_WORDS_KEPT", 3)
    small = packing.WordIds(PATH)
    for text in ("one two three four five", "six. seven, eight! one", "", "İ x"):
        assert np.frombuffer(small.encode([text.encode()])[0], "<u4").tolist() == library_ids(text)


def check_plan(counts, capacity):
    groups = packing.plan(counts, capacity)
    held = Counter()
    for pattern, times in groups:
        assert sum(pattern) <= capacity and times > 0
        for n in pattern:
            held[n] += times
    assert held == Counter({n: c for n, c in counts.items() if c})
    return sum(times for _, times in groups)


def test_plans():
    assert check_plan({}, 4096) == 0
    assert check_plan({4096: 7}, 4096) == 7
    assert check_plan({1: 4096 * 3 + 1}, 4096) == 4
    assert check_plan({3000: 5, 1096: 5}, 4096) == 5
    assert check_plan({2049: 10}, 4096) == 10
    assert check_plan({2000: 4, 2096: 4, 96: 1}, 4096) in (4, 5)


def test_plans_are_close_to_the_bound_at_any_size():
    rng = random.Random(9)
    lengths = [min(4096, max(1, int(rng.lognormvariate(6.3, 0.9)))) for _ in range(4000)]
    for times in (1, 50):
        counts = {n: c * times for n, c in Counter(lengths).items()}
        bound = -(-sum(n * c for n, c in counts.items()) // 4096)
        assert check_plan(counts, 4096) <= bound * 1.002 + 1


def test_plans_at_random():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([5, 16, 64])
        counts = {rng.randint(1, capacity): rng.randint(0, 40) for _ in range(rng.randint(1, 8))}
        used = check_plan(counts, capacity)
        first_fit = sum(-(-c // (capacity // n)) for n, c in counts.items())
        assert used <= first_fit + 1


def check_packed(rows, capacity):
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "same text", 7), (None, "same text", 7), (3, "long words here " * 3000, 8), (4, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    cut = packing.token_pieces(docs, PATH, with_ids=True)
    packed = packing.pack(cut, group_rows=1)
    got = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    assert check_packed(got, 4096) == 3  # 9001 tokens and a few
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = [*library_ids(text), 1]
        assert r.ids == ids[r.start : r.start + 4096] and r.start == 4096 * r.piece and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(str(i) for i, _, _ in rows)
    assert sum(len(r.ids) for r in packing.assemble(packed).collect()) == sum(r.length for r in got)
    assert packing.pack(packing.token_pieces(docs.limit(0), PATH)).count() == 0


def test_query_against_the_library(spark):
    from mailrisk.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = [*library_ids(r.text or ""), 1]
        for k in range(0, len(ids), 4096):
            some = ids[k : k + 4096]
            want[r.doc_id, k // 4096] = (k, len(some), zlib.crc32(np.array(some, "<u4").tobytes()))
    rows = QUERIES["op9_packing"](spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bound = -(-sum(w[1] for w in want.values()) // 4096)
    assert check_packed(rows, 4096) <= bound * 1.02 + 1
