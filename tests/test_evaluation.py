import random

import pytest
from pyspark.sql import functions as F

from mailrisk.operators import evaluation
from mailrisk.schemas import SIGNALS
from mailrisk.sources import config


def test_roc_and_auc_against_pairs(spark):
    random.seed(8)
    rows = [(str(i), random.choice("ab"), random.choice([0.0, 0.25, 0.5, 0.500000001, 1.0, random.random(), None])) for i in range(150)]
    labels = {str(i): int(random.random() < 0.4) for i in range(140)}
    scored = spark.createDataFrame(rows, "message_id string, g string, score double")
    truth = spark.createDataFrame(list(labels.items()), "message_id string, label int")
    points = evaluation.roc_points(scored, truth, "g")
    areas = {r["g"]: (r["scored"], r["auc"]) for r in evaluation.auc(points, "g").collect()}
    best = {r["g"]: r for r in evaluation.choose_threshold(points, "g", 5, 1).collect()}
    for g in "ab":
        known = [(s, labels[m]) for m, k, s in rows if k == g and s is not None and m in labels]
        pos, neg = [s for s, l in known if l], [s for s, l in known if not l]
        pairs = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert areas[g] == (len(known), pytest.approx(pairs / (len(pos) * len(neg)), abs=1e-9))
        cost = lambda t: 5 * sum(n >= t for n in neg) + sum(p < t for p in pos)
        want = min(((cost(t), -t) for t, _ in known))
        assert (best[g]["cost"], -best[g]["threshold"]) == want


def test_signal_metrics(spark):
    row = lambda m, name, score, error=None: (m, 1, name, score, "low", "e", {}, error)
    signals = spark.createDataFrame([
        row("t1", "x", 0.5), row("t1", "x", 0.9), row("c1", "x", 0.5), row("t2", "x", 0.0, "no data"), row("zero", "x", 0.0),
        row("c1", "y", 0.0, "no data"), row("unlabelled", "x", 0.9),
    ], SIGNALS)
    labels = spark.createDataFrame([("t1", 1), ("t2", 1), ("t3", 1), ("c1", 0), ("zero", 0)], "message_id string, label int")
    grid = spark.createDataFrame([(m, 1, True) for m in ("t1", "t2", "t3", "c1", "zero", "unlabelled")], "message_id string, layer int, completed boolean")
    got = {r["name"]: r for r in evaluation.signal_metrics(signals, labels, grid).collect()}
    x = got["x"]
    assert (x["tp"], x["fp"], x["fn"], x["abstained"], x["incomplete"]) == (1, 1, 1, 1, 0)
    assert (x["precision"], x["recall"], x["f1"]) == (0.5, 0.5, 0.5)
    assert (got["y"]["precision"], got["y"]["recall"], got["y"]["fn"]) == (None, 0.0, 3)
    # A threat whose layer did not run was not missed, and one that was never assessed is not counted.
    partial = grid.where("message_id <> 't2'").withColumn("completed", F.col("message_id") != "t3")
    x = {r["name"]: r for r in evaluation.signal_metrics(signals, labels, partial).collect()}["x"]
    assert (x["tp"], x["fn"], x["abstained"], x["incomplete"], x["recall"]) == (1, 0, 0, 1, 1.0)


def test_auc_of_billions(spark):
    n = 3_000_000_000
    points = spark.createDataFrame([("g", n, 0, n, 0, n, n), ("g", 0, n, n, n, n, n)], "by string, pos long, neg long, tp long, fp long, positives long, negatives long")
    assert evaluation.auc(points, "by").first()["auc"] == 1.0


def test_ablation_and_refit(spark):
    random.seed(9)
    rows, truth = [], []
    for i in range(120):
        threat = i % 2
        truth.append((str(i), threat))
        values = (0.8 * threat + 0.2 * random.random(), random.random(), None if i % 10 == 0 else random.random(), 0.3)
        rows += [(str(i), k + 1, v is not None, v) for k, v in enumerate(values)]
    scores = spark.createDataFrame(rows, "message_id string, layer int, completed boolean, score double")
    labels = spark.createDataFrame(truth, "message_id string, label int")
    got = {r["dropped"]: r for r in evaluation.ablation(scores, config.weights_table(spark), labels).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[0]["marginal"] == 0.0
    assert got[1]["marginal"] == max(r["marginal"] for r in got.values()) > 0.1
    fitted = {r["layer"]: r["weight"] for r in evaluation.fit_composite(scores, labels).collect()}
    assert sum(fitted.values()) == pytest.approx(1.0) and max(fitted, key=fitted.get) == 1


def test_holdout_is_stable(spark):
    frame = spark.range(5000).selectExpr("cast(id as string) as message_id")
    first = {r[0] for r in evaluation.holdout(frame, 0.2).where("heldout").collect()}
    again = {r[0] for r in evaluation.holdout(frame.repartition(7), 0.2).where("heldout").select("message_id").collect()}
    assert first == again and 850 < len(first) < 1150
