import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, decoders

from mailrisk.llm import alignment

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "a ", " a", "a  b   ", "\n", "\t\tx\r\n", "<|endoftext|> and </s> <s>", "▁", "x▁y", "<0x41>", "it's 'sx ''s", "é ß ſ œ",
    "漢字 かな 🙂🙂 x", "é ﬁ ² ­​  y", "\x00 nul", "a" * 300, "1234567890 12 3", "http://a.b/" + "c" * 90 + " d",
]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a.encode_special_tokens = True
    return a, b


def plain_tokens(libraries, text):
    """(id, bytes) of both sides by the libraries' own decoders; none where they do not give the text back."""
    a, b = libraries
    if not text:
        return [], []
    back = {c: i for i, c in enumerate_letters()}
    side_a = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    side_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        side_b.append((i, bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode()))
    if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (side_a, side_b)):
        return [], []
    return side_a, side_b


def enumerate_letters():
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in printable]
    return [(b, chr(b)) for b in printable] + [(b, chr(256 + i)) for i, b in enumerate(rest)]


def spans(side):
    at, out = 0, []
    for i, token in side:
        out.append((i, at, at + len(token)))
        at += len(token)
    return out


def plain_alignment(libraries, text):
    """Groups and links by comparing byte ranges of all pairs."""
    a, b = (spans(s) for s in plain_tokens(libraries, text))
    common = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, start = [], 0
    for end in common:
        groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
        start = end
    links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
    return len(a), len(b), groups, links


def plain_report(libraries, rows):
    made = [(doc_id, *plain_alignment(libraries, text)) for doc_id, text in rows]
    counts: dict = {}
    for *_, links in made:
        for link in set(links):
            counts[link] = counts.get(link, 0) + 1
    top: dict = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return [(doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc_id, n_a, n_b, groups, links in made]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_groups_equal_the_libraries(libraries):
    both = alignment.aligner(PATH_A, PATH_B)
    assert both.a.fast and both.a.plain and both.b.plain
    rng = random.Random(3)
    alphabet = "ab  eé\n\t'sß.,!1٣漢🙂 -_"
    latin = "ab   eé\n\n'tsß.,!1²½ -_ºµ"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for letters in (alphabet, latin) for _ in range(1500)]
    for _ in range(2):  # the second time from kept units
        for text, got in zip(texts, both.align_all(texts), strict=True):
            n_a, n_b, groups, links = plain_alignment(libraries, text)
            assert got[:4] == (n_a, n_b, len(groups), ";".join(groups)), text
            assert sorted(divmod(x, 32_000) for x in memoryview(got.links).cast("q")) == sorted(links), text


def test_units_are_the_text():
    for text in (" a", "  ", " a ", " a  b \n c\n", " \n \n x  \n", "  a b"):
        units = alignment.UNIT.findall(text)
        assert "".join(units) == text and all(u[0] == " " for u in units)
    assert alignment.UNIT.findall(" a b\nc  d \n") == [" a", " b\nc", "  d \n"]


def test_letters_are_those_of_the_library():
    decode = decoders.ByteLevel().decode
    letters = alignment.byte_letters()
    assert sorted(letters.values()) == list(range(256))
    assert all(decode([c]) == chr(b) for c, b in letters.items() if b < 128)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(*(st.sets(st.integers(1, n)).map(lambda cut, n=n: sorted(cut | {n})) for _ in "ab"))))
def test_groups_and_links_of_any_cuts(ends):
    made = alignment.slices(*ends)
    common = sorted(set(ends[0]) & set(ends[1]))
    assert [(ends[0][i - 1], ends[1][j - 1]) for i, j in made] == [(end, end) for end in common]
    links = [link for start, end in zip([(0, 0), *made], made) for link in alignment.overlaps(*ends, *start, *end)]  # noqa: B905
    a, b = ([(s, e) for s, e in zip([0, *side], side)] for side in ends)  # noqa: B905
    assert links == [(i, j) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if s < f and t < e]


def test_report_equals_brute_force(spark, libraries):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(None, "no id here"), (3, "a "), (50, "the the the"), (51, "the cat")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.report(frame, PATH_A, PATH_B)) == sorted(plain_report(libraries, rows), key=str)


def test_documents_of_the_table_equal_brute_force(spark, libraries):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where(
        "length(text) < 1500")  # the brute force compares all pairs of tokens
    rows = [tuple(r) for r in documents.collect()]
    assert rows_of(alignment.report(documents, PATH_A, PATH_B)) == sorted(plain_report(libraries, rows), key=str)


def test_blocks_change_nothing(spark, libraries):
    rows = [(i % 5, f"text number {i} with the same words {'x' * i}") for i in range(30)] + [(9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made = alignment.align(frame, PATH_A, PATH_B).selectExpr("monotonically_increasing_id() AS row", "doc_id", "links").persist()
    counts = alignment.link_counts(made)
    n_b = 32_000
    assert len(list(alignment.count_blocks(counts, n_b, 10))) > 3
    one = rows_of(alignment.weigh(made, counts, n_b, ["row", "doc_id"]))
    assert rows_of(alignment.weigh(made, counts, n_b, ["row", "doc_id"], block_pairs=10)) == one
    wanted = [(r[0], r[5], r[6]) for r in plain_report(libraries, rows)]
    assert sorted((r[1:] for r in one), key=str) == sorted(wanted, key=str)
    made.unpersist()


def test_other_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "some words", "kept", 7)], "id int, body string, groups string, links int")
    made = alignment.align(frame, PATH_A, PATH_B, "body")
    assert made.columns == ["id", "body", "n_a", "n_b", "n_groups", "groups", "links"]
    assert made.first().n_groups == 2
    assert alignment.align(frame.limit(0), PATH_A, PATH_B, "body").count() == 0
    assert alignment.report(spark.createDataFrame([], "doc_id long, text string"), PATH_A, PATH_B).count() == 0
    alone = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in alignment.report(alone, PATH_A, PATH_B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
