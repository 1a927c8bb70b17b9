"""Near copies against all pairs of exact shingle sets."""

import random

import corpus_pipeline
from mailrisk.llm import near_copies, simhash

RNG = random.Random(5)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_sets(texts):
    out = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def plain_stay(texts):
    """The smallest id of each component of pairs with Jaccard 0.8 or more."""
    sets, gone, stay = plain_sets(texts), set(), []
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    for start in sorted(sets):
        if start in gone:
            continue
        stay.append(start)
        todo = [start]
        while todo:
            at = todo.pop()
            gone.add(at)
            todo += [o for o in sets if o not in gone and near(sets[o], sets[at])]
    return stay


def made_texts():
    """Families of texts, each changed from an earlier one of its family in some words, on both sides of 0.8."""
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for family in range(25):
        members = [[RNG.choice(vocabulary) for _ in range(RNG.randint(60, 400))]]
        for _ in range(RNG.choice([1, 2, 12])):
            words = list(RNG.choice(members))
            for _ in range(round(len(words) * RNG.choice([0.01, 0.02, 0.025, 0.04]))):
                words[RNG.randrange(len(words))] = RNG.choice(vocabulary)
            members.append(words)
        for words in members:
            texts[len(texts)] = " ".join(words)
    return texts


def test_sets_and_similarity():
    sets = [near_copies.shingles(t) for t in (b"", b"a b", b"A  B", b"b a", b"a b c d e", b"a b c d e f", b"a b c d e a b c d e")]
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1, 2, 5 + 1 - 1]
    assert near_copies.similar(sets[1], sets[2]) and not near_copies.similar(sets[1], sets[3])
    four, five = near_copies.shingles(b"a b c d e f g h"), near_copies.shingles(b"a b c d e f g h i")
    assert near_copies.similar(four, five), "4 of 5 is 0.8"
    assert not near_copies.similar(four, near_copies.shingles(b"a b c d e f g h i j"))


def test_the_stage_finds_all_near_copies(spark):
    texts = made_texts() | {9000: None, 9001: "", 9002: "one word", 9003: "One WORD"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == plain_stay(texts)


def test_the_stage_on_the_folder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == set(plain_stay({r.doc_id: r.text for r in docs.collect()}))
    assert {1, 6} <= got and not {145, 177} & got, "near copies of 6 and 1 whose SimHashes differ in 7 and 11 bits"


def test_simhashes_give_the_first_pairs(spark, monkeypatch):
    """All pairs of near SimHashes are in components of the pairs that are compared first, and what is similar of them is linked."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = {}
    for i in range(60):
        words = list(base) if i % 2 else [f"v{rng.randrange(10**6)}" for _ in range(400)]
        words[rng.randrange(400)] = f"x{i}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    fps = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    near = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 3]
    assert len(near) > 10
    seen, compared = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: seen.append(pairs) or compared(pairs, sets))
    assert sorted(r.doc_id for r in near_copies.deduplicate(docs).collect()) == plain_stay(texts)
    node = {r.doc_id: r.node for r in near_copies.sketches(docs).collect()}
    label = {n: n for n in node.values()}
    pairs = [(r.a, r.b) for r in seen[0].collect()]
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert all(label[node[i]] == label[node[j]] for i, j in near)


def test_a_large_family_makes_few_pairs():
    """Members of one component make no pairs in the third round."""
    import numpy as np

    key, node = np.repeat([1, 2], 1000), np.tile(np.arange(1000), 2)
    one = near_copies._cross_pairs(np.stack([key, node, key * 0 + 50, key * 0]))
    assert sum(b.num_rows for b in one) == 0
    two = near_copies._cross_pairs(np.stack([key, node, key * 0 + 50, (node == 7).astype(np.int64)]))
    assert sum(b.num_rows for b in two) == 2 * 999


def crowd(n):
    """Texts round one passage: most of each is the passage, few are near copies of another."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(120)]
    texts = {}
    for i in range(n):
        words = list(passage)
        for _ in range(rng.choice([1, 2, 4, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words + [f"e{rng.randrange(10**6)}" for _ in range(rng.choice([0, 5, 20]))])
    return texts


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 128)
    texts = crowd(700)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    stay = plain_stay(texts)
    assert 20 < len(stay) < 650
    assert sorted(r.doc_id for r in near_copies.deduplicate(docs).collect()) == stay


def test_blocks_alone_link_what_is_similar(spark, monkeypatch):
    """Without the rounds before, from buckets that hold everything: blocks find all components and give few links."""
    monkeypatch.setattr(near_copies, "BLOCK", 64)
    texts = crowd(300)
    sets = {i: near_copies.shingles(t.encode()) for i, t in texts.items()}
    frame = spark.createDataFrame([(i, h.view("int64").tolist()) for i, h in sets.items()], "node long, hashes array<long>")
    placed = frame.selectExpr("0L AS key", "0 AS band", "node", "node AS root", "300L AS n")
    links = [(r.a, r.b) for r in near_copies._crowded_links(placed, frame).collect()]
    assert all(near_copies.similar(sets[a], sets[b]) for a, b in links)
    label = list(range(300))
    for _ in range(300):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted({*label}) == plain_stay(texts)
    assert len(links) < 15 * 300, "15 pairs of blocks, each a forest"


def test_one_of_each_keeps_ties_repeats_and_nulls(spark):
    rows = [(3, "a b", 1), (3, "a b", 1), (3, "A b", 1), (4, "a  b", 1), (None, "a b", 1), (None, "z", 2), (None, "z", 2), (5, None, 3), (6, "", 3)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near_copies.deduplicate(docs).collect()), key=str)
    assert [i for i, _ in got] == [3, 5, None] and got[0][1] in ("a b", "A b") and got[2] == (None, "z")
