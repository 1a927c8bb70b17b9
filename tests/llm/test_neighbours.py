"""Nearest neighbours: recall against brute force, exact scores, crowds of equal vectors, bad rows."""

import numpy as np
import pytest

from mailrisk.llm import neighbours


def brute(vectors, queries, k=5):
    """{query id: [(vec_id, score)]} over distinct ids."""
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        scores = neighbours.cosines(np.array(vectors[q], np.float64), matrix)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(ids[i], scores[i]) for i in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_scan_abandons_few_true_neighbours():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 64))
    data = (centre[rng.integers(0, 30, 6000)] + 0.6 * rng.normal(size=(6000, 64))).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    columns = [np.ascontiguousarray(data[:, at : at + 16]) for at in range(0, 64, 16)]
    hits = read = 0
    for i in range(0, 6000, 100):
        near = neighbours.scan(data[i], columns, 6)
        true = np.argsort(np.square(data - data[i]).sum(axis=1))[:6]
        hits += len(set(true.tolist()) & set(near.tolist()))
        read += len(near)
    assert hits / (60 * 6) > 0.97 and read < 60 * 20


FRAME = "vec_id long, embedding array<float>, label int, v string, ids int"


def test_small_table_gives_all_candidates_exactly(spark):
    rows = [(i, [float(i + 1), 1.0, float(i % 3)], 0, "x", 1) for i in range(4)]
    frame = spark.createDataFrame(rows, FRAME)
    want = brute({r[0]: r[1] for r in rows}, [0, 1, 2, 3])
    got = found(neighbours.search(frame, frame))
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    assert all(s == w for q in got for (_, s), (_, w) in zip(got[q], want[q], strict=True))


def test_bad_rows_take_no_part(spark):
    good = [(10, [1.0, 0.0], 0, "", 1), (11, [0.0, 2.0], 0, "", 1), (12, [1.0, 1.0], 0, "", 1)]
    bad = [(1, None, 0, "", 1), (2, [0.0, 0.0], 0, "", 1), (3, [1.0, None], 0, "", 1), (4, [float("nan"), 1.0], 0, "", 1),
           (5, [float("inf"), 1.0], 0, "", 1), (None, [1.0, 0.5], 0, "", 1), (6, [1.0, 2.0, 3.0], 0, "", 1), (7, [], 0, "", 1)]
    frame = spark.createDataFrame([*good, *bad, good[0]], FRAME)
    got = found(neighbours.search(frame, frame))
    assert {q: [v for v, _ in x] for q, x in got.items()} == {10: [12, 11], 11: [12, 10], 12: [10, 11]}
    assert neighbours.search(frame.where("embedding is null"), frame).count() == 0
    assert neighbours.search(frame.limit(0), frame.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]


def test_crowd_of_equal_vectors(spark):
    """A third of the rows share one vector: their neighbours are each other's smallest ids."""
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = {i: hot if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist() for i in range(900)}
    frame = spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows.items()], FRAME).repartition(7)
    got = found(neighbours.search(frame, frame.where("vec_id % 50 = 0"), block_rows=20))
    want = brute(rows, [i for i in rows if i % 50 == 0])
    assert sorted(got) == sorted(want) and all(len(x) == 5 for x in got.values())
    for q in got:
        if q % 3 == 0:
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]] == [i for i in (0, 3, 6, 9, 12, 15) if i != q][:5]


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_ties_go_to_the_smaller_ids(spark, block_rows):
    """Parallel vectors are different vectors of equal score; 40 of them over several blocks, in any order of rows."""
    direction = [1.0, 2.0, -0.5, 4.0]
    rows = {0: direction} | {i: [x * 2.0**i for x in direction] for i in range(1, 41)} | {i: [1.0, -1.0, float(i % 7), 0.5] for i in range(41, 90)}
    order = np.random.default_rng(8).permutation(list(rows)).tolist()
    frame = spark.createDataFrame([(i, rows[i], 0, "", 0) for i in order], FRAME.replace("float", "double")).repartition(5)
    got = found(neighbours.search(frame, frame.where("vec_id in (0, 3, 40, 60)"), block_rows=block_rows))
    want = brute(rows, [0, 3, 40])
    assert got[0] == want[0] and [v for v, _ in got[0]] == [1, 2, 3, 4, 5]
    assert got[3] == want[3] and [v for v, _ in got[3]] == [0, 1, 2, 4, 5]
    assert got[40] == want[40] and [v for v, _ in got[60]][:5] == [v for v, _ in brute(rows, [60])[60]]


def test_doubles_of_any_size(spark):
    rows = {1: [1e-60, 0.0], 2: [1e200, 1e200], 3: [0.0, 1e-200], 4: [3e150, 1.0], 5: [0.1 + 1e-12, 0.1]}
    frame = spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows.items()], FRAME.replace("float", "double"))
    got = found(neighbours.search(frame, frame))
    assert got == brute(rows, list(rows)) and all(len(x) == 4 for x in got.values())
    assert got[2][0][0] == 5 and got[1][0] == (4, 1.0) and got[3][0] == (2, np.sqrt(0.5))


def test_scaling_changes_no_bit():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 17)), rng.normal(size=17)
    plain = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))
    assert np.array_equal(neighbours.cosines(b, a), plain)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, scale):
    from mailrisk.llm.queries import QUERIES

    folder = f"/root/testdata/{scale}"
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = found(QUERIES["op2_neighbours"](spark, folder))
    want = brute(vectors, [i for i in vectors if i % 50 == 0])
    assert sorted(got) == sorted(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, near in got.items():
        for v, score in near:
            assert score == neighbours.cosines(np.array(vectors[q]), np.array([vectors[v]]))[0]
