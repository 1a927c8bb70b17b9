"""The pipeline against a plain version of every stage, each on the stage before it."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mailrisk import session
from mailrisk.llm import secrets, toxicity
from .test_near_copies import plain_stay

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of the input and after every stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            out.append(docs.collect())
    return [*out, docs.collect()]


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "secrets", "packing"]


def test_toxicity(spark, stages):
    model = toxicity.fit_tables(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert sorted(stages[1]) == sorted(r for r in stages[0] if model.score(r.text) < 0.3)
    assert 0.8 * len(stages[0]) < len(stages[1]) < len(stages[0])


def test_near_duplicates(stages):
    """The smallest id of each group of five-word Jaccard 0.8 or more stays, by all pairs of exact sets."""
    stay = set(plain_stay({r.doc_id: r.text for r in stages[1]}))
    assert sorted(stages[2]) == sorted(r for r in stages[1] if r.doc_id in stay)
    assert len(stay) < len(stages[1])


def test_repeated_passages(stages):
    words = {r.doc_id: r.text.encode().split() for r in stages[2]}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    after = {r.doc_id: r for r in stages[3]}
    assert sorted(after) == sorted(words)
    for r in stages[2]:
        gone = set()
        for k in range(len(words[r.doc_id]) - 49):
            if first[tuple(words[r.doc_id][k : k + 50])] < r.doc_id:
                gone |= set(range(k, k + 50))
        kept = b" ".join(w for k, w in enumerate(words[r.doc_id]) if k not in gone).decode()
        assert after[r.doc_id].text == (kept if gone else r.text)
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_secrets(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert sorted(before) == sorted(r.doc_id for r in stages[4])
    for r in stages[4]:
        base = [span for span, _ in secrets.base_spans(before[r.doc_id].text)]
        if not base:
            assert "<secret>" in r.text or r == before[r.doc_id]
        else:
            assert not secrets.base_spans(r.text) and "<secret>" in r.text


def test_packing(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, used = {(r.doc_id, r.piece): r for r in stages[5]}, {}
    for r in stages[4]:
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            got = rows.pop((r.doc_id, k // 4096))
            assert got.ids_crc32 == zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())
            used.setdefault(got.sequence_id, []).append((got.offset, got.length))
    assert not rows
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_stages_with_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (3, "the same words here", "en", "s", 19),
            (3, "the same words here", "en", "s", 19), (4, "word " * 60000, "en", "s", 300000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for start in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            if name != "packing":
                docs = spark.createDataFrame(docs.collect(), docs.schema)
        found = docs.collect()
        if start.count():
            assert {r.doc_id for r in found} == {1, None, 3, 4}  # the null and the empty text are one group
        else:
            assert found == []


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    key = lambda r: (r.doc_id, r.piece, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, stages[5]))


def test_a_stage_leaves_only_what_its_result_reads(spark):
    """Tables of a stage that its result does not read are gone when it returns, and those of all earlier blocks stay."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    folder = session.work_folder(spark).removeprefix("file://")
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeated_passages):
        earlier = session.cut_lineage(spark.range(3))
        before = set(os.listdir(folder))
        result = stage(spark, docs, FOLDER)
        left = [f for f in os.listdir(folder) if f not in before]
        assert len(left) == 1 and os.path.exists(f"{folder}/{left[0]}/_SUCCESS")
        assert 0 < result.count() <= 60 and earlier.count() == 3


def test_passing_tables(spark):
    folder = session.work_folder(spark).removeprefix("file://")
    with pytest.raises(ZeroDivisionError), session.passing_tables(spark) as lasting:
        with session.passing_tables(spark) as inner:
            passing = session.cut_lineage(spark.range(5))
            middle = inner(passing.where("id > 1"))
        assert middle.count() == 3 and not os.path.exists(passing.inputFiles()[0].removeprefix("file://"))
        last = lasting(middle.where("id > 2"))
        before = set(os.listdir(folder))
        1 / 0  # noqa: B018
    assert last.count() == 2 and len(before - set(os.listdir(folder))) == 1
