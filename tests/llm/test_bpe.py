"""Byte-level BPE against the tokenizer library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from mailrisk.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CODEC = bpe.codec(PATH, PATTERN)
DECODER = bpe.decoder(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.transducer.ranks, special_tokens={})

SPECIAL = ["", " ", "\n\n \t", "don't we'll 'S", "a" * 5000, "\x1c\x85 x", "日本語テキスト", "\U0001f468‍\U0001f469‍\U0001f467", "é﻿",
           "<|endoftext|>", "x1y22z333", "=" * 700 + "-" * 300, "\0\x7f\x80\xa0"]


@pytest.mark.parametrize("text", SPECIAL)
def test_special_texts(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text)
    assert DECODER.decode(CODEC.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_joined_tokens_and_syllables():
    rng, tokens = random.Random(5), list(CODEC.transducer.ranks)
    for _ in range(4000):
        text = b"".join(rng.choice(tokens) for _ in range(3)).decode("utf-8", "replace")
        word = "".join(rng.choice("th er an re tion ing é ß ng s".split()) for _ in range(5))
        assert CODEC.encode(text + word).tolist() == LIBRARY.encode_ordinary(text + word)


def test_states_are_forgotten_without_effect(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 10)
    monkeypatch.setattr(bpe, "MAX_HELD", 40)
    small, rng = bpe.Codec(PATH, PATTERN), random.Random(2)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdeghinorst") for _ in range(rng.choice([3, 9, 200]))) for _ in range(5))
        assert small.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_pieces_of_tokens_that_merging_does_not_give():
    """A token whose parts do not merge to it is used for a whole piece only."""
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3}
    library = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    machine = bpe.Transducer(ranks)
    for text in ("abc", "abca", "cabc", "ab"):
        assert machine.encode(text.encode()) == library.encode_ordinary(text)


def test_streaming_decode_hands_on_whole_characters():
    text = "aé日\U0001f600z" * 3
    singles = [CODEC.transducer.ranks[bytes([b])] for b in text.encode()]
    chunks = list(DECODER.stream(singles))
    assert "".join(c.decode() for c in chunks) == text and len(chunks) == len(text)
    broken = [CODEC.transducer.ranks[bytes([b])] for b in b"\xe2\x82a\xff\xc3\xa9\xe2"]
    assert b"".join(DECODER.stream(broken)) == b"\xe2\x82a\xff\xc3\xa9\xe2"


def test_utf8_machine_accepts_what_utf8_is():
    machine, rng = bpe.Utf8(), random.Random(1)
    for _ in range(30000):
        data = bytes(rng.choice([0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF3, 0xF4, 0xF5]) for _ in range(rng.randint(1, 4)))
        try:
            valid = data.decode() is not None
        except UnicodeDecodeError:
            valid = False
        assert (machine.run(0, data) == 0) == valid, data


def test_rows(spark):
    rows = [(1, None, "k"), (1, "", "k"), (None, "same", "x"), (None, "same", "x"), (2, "long " * 20000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(frame, PATH, PATTERN)
    assert encoded.columns == ["doc_id", "text", "ids"]
    back = bpe.decode(encoded, PATH).collect()
    assert sorted(r.decoded.decode() for r in back) == sorted(t or "" for _, t, _ in rows)
    assert bpe.round_trip(frame.limit(0), PATH, PATTERN).count() == 0 == bpe.encode(frame.limit(0), PATH, PATTERN).count()


def test_query_against_the_library(spark):
    from mailrisk.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_byte_bpe"](spark, folder).collect()}
    assert got == want
