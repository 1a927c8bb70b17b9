"""SimHash: complete keys, fingerprints and components against brute force."""

from itertools import combinations

import numpy as np
import pytest
import xxhash

from mailrisk.llm import components, simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """Smallest id reachable by steps of at most three bits, by search from every id in order."""
    owner = {}
    for start in sorted(fps):
        todo = [start] if start not in owner else []
        while todo:
            at = todo.pop()
            if at not in owner:
                owner[at] = start
                todo += [o for o in fps if o not in owner and (fps[o] ^ fps[at]).bit_count() <= 3]
    return owner


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    index = simhash.codeword_index(words)
    assert np.bincount(index).tolist() == [2048] * 4096


def test_keys_meet_for_every_pattern_of_three_errors():
    rng = np.random.default_rng(3)
    patterns = np.array([sum(1 << int(b) for b in c) for n in (1, 2, 3) for c in combinations(range(64), n)], dtype=np.uint64)
    for base in [0, (1 << 64) - 1, *(int(x) for x in rng.integers(0, 1 << 63, 6))]:
        _, own = simhash.golay_keys(np.array([base], dtype=np.uint64))
        row, key = simhash.golay_keys(np.uint64(base) ^ patterns)
        assert len(np.unique(row[np.isin(key, own)])) == len(patterns)


def test_few_keys():
    row, _ = simhash.golay_keys(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert len(row) / 5000 < 42


@pytest.mark.parametrize("text", ["", "   ", "One", "a b", "A b C", "x y z " * 50, "Ünï ÀB c d e f", "a\tb\nc\x0bd\x0ce\rf"])
def test_fingerprint(text):
    for c in "\t\n\x0b\x0c\r":
        assert c.encode().isspace()
    plain = text
    for c in "\t\n\x0b\x0c\r":
        plain = plain.replace(c, " ")
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(plain)


def test_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 64)
    assert simhash.fingerprint(text.encode()) == whole == slow_fingerprint(text)


def _cluster_fps(n=260, seed=5):
    rng = np.random.default_rng(seed)
    fps, base = [], rng.integers(0, 1 << 63, 12)
    for i in range(n):
        word = int(base[i % 12])
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            word ^= 1 << int(bit)
        fps.append(word)
    return fps


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_give_the_components(spark, limit):
    """The lower limit sends nearly all through the neighbour balls."""
    fps = sorted(set(_cluster_fps()))
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    found = {r.node: r.root for r in components.stars(simhash.links(frame, limit)).collect()}
    signed = {int(np.uint64(x).view(np.int64)): x for x in fps}
    want = slow_components(signed)
    assert {x: found.get(x, x) for x in signed} == want
    assert len(set(want.values())) < len(want)


def test_components_of_long_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 180)] + [(7, 7), (2, 1)]
    found = {r.node: r.root for r in components.stars(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 180)}}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


BASE = " ".join(f"word{i}" for i in range(400))
ROWS = [
    (5, BASE), (3, BASE), (3, BASE), (9, BASE + " tail"), (4, "other text of a few words"), (6, None), (2, ""),
    (None, "no id at all here"), (None, BASE), (8, "Other TEXT of a few words"),
]


def test_near_duplicates(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, component_id string, fp int")
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(), "component_id").collect()
    fps = [slow_fingerprint(t or "") for _, t in ROWS]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for (i, _), f in zip(ROWS, fps))
    groups = slow_components(dict(enumerate(fps)))
    for r in got:
        member = [k for k, (i, _) in enumerate(ROWS) if i == r.doc_id and f"{fps[k]:016x}" == r.fingerprint][0]
        ids = [ROWS[k][0] for k in groups if groups[k] == groups[member] and ROWS[k][0] is not None]
        assert r.component_id == (min(ids) if ids else None)


def test_deduplicate_keeps_columns_and_one_row_per_group(spark):
    docs = spark.createDataFrame([(i, t, str(i)) for i, t in ROWS], "doc_id long, text string, root string")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "None"]
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from mailrisk.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: slow_fingerprint(" ".join(r.text.split())) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op1_simhash"](spark, folder).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == docs
    assert {r.doc_id: r.component_id for r in got} == slow_components(docs)
