"""Signal contract, grid, budgets, scoring: an incomplete layer is never clean."""

import itertools

import pytest
from pyspark.sql import functions as F

from mailrisk.operators import results, scoring
from mailrisk.schemas import LAYER_RESULTS, SIGNALS
from mailrisk.sources import config


def signal(message="m", layer=1, name="n", score=0.5, severity="low", evidence="e", error=None):
    return (message, layer, name, score, severity, evidence, {}, error)


def frame(spark, rows):
    return spark.createDataFrame(rows, SIGNALS)


def test_contract(spark):
    bad = {
        "score is outside 0-1": [signal(score=-0.1), signal(score=1.1)],
        "score is not finite": [signal(score=float("nan")), signal(score=float("inf")), signal(score=float("-inf"))],
        "score is missing": [signal(score=None)],
        "name is blank": [signal(name=" "), signal(name=None)],
        "evidence is blank": [signal(evidence=""), signal(evidence=" \t")],
        "layer is not one of 1-4": [signal(layer=5), signal(layer=None)],
        "severity is not a level": [signal(severity="severe")],
        "message_id is blank": [signal(message="")],
    }
    good = [signal(score=0.0), signal(score=1.0, error="abstained"), signal(layer=4, severity="high")]
    rows = good + [s for group in bad.values() for s in group]
    signals, quarantine = results.collect_signals(frame(spark, rows[:2]), frame(spark, rows[2:]))
    assert signals.count() == len(good)
    counted = {r["rule"]: r["count"] for r in quarantine.groupBy("rule").count().collect()}
    assert counted == {rule: len(group) for rule, group in bad.items()}
    assert {r[0] for r in signals.select(results.qualified_name()).collect()} == {"L1/n", "L4/n"}


def runs_of(spark, rows):
    return spark.createDataFrame(rows, LAYER_RESULTS)


def test_grid_has_four_rows_per_message(spark):
    messages = spark.createDataFrame([("a",), ("b",)], "message_id string")
    runs = runs_of(spark, [
        ("a", 1, True, None, 10), ("a", 2, False, "boom", 20), ("a", 3, None, None, None),
        ("a", 4, False, "first try", 5), ("a", 4, True, None, 7), ("stranger", 1, True, None, 1),
    ])
    got = {(r["message_id"], r["layer"]): (r["completed"], r["error"], r["duration_ms"])
           for r in results.layer_grid(messages, runs).collect()}
    none = results.NO_RESULT
    assert got == {
        ("a", 1): (True, None, 10), ("a", 2): (False, "boom", 20), ("a", 3): (False, none, 0), ("a", 4): (True, None, 7),
        **{("b", k): (False, none, 0) for k in (1, 2, 3, 4)},
    }


def test_budgets(spark):
    grid = runs_of(spark, [
        ("a", 1, True, None, 8000), ("a", 2, True, None, 3), ("a", 3, True, None, 10001), ("a", 4, False, "boom", 9000),
        ("b", 1, True, None, 21000), ("b", 2, True, None, 1), ("b", 3, True, None, 1), ("b", 4, False, "boom", 1),
    ])
    got = lambda **kw: {(r["message_id"], r["layer"]): (r["completed"], r["error"], r["duration_ms"])
                        for r in results.apply_budgets(grid, **kw).collect()}
    plain = got()
    assert plain["a", 1] == (True, None, 8000) and plain["a", 2] == (True, None, 3)
    assert plain["a", 3] == (False, "timeout after 10s", 10000) and plain["a", 4] == (False, "timeout after 6s", 6000)
    assert plain["b", 1] == (False, "timeout after 8s", 8000) and plain["b", 4] == (False, "boom", 1)
    raised = got(budgets={1: 25.0})
    assert raised["a", 1] == (True, None, 8000)
    assert {raised["b", k] for k in (1, 2, 3, 4)} == {(False, "pipeline exceeded its 20s total budget", 20000)}
    assert got(budgets={1: 25.0}, total=None)["b", 1] == (True, None, 21000)
    assert got(budgets={3: 0.5})["a", 3] == (False, "timeout after 0.5s", 500)
    kept = results.surviving_signals(frame(spark, [signal("a", 2), signal("a", 3)]), results.apply_budgets(grid))
    assert [r["layer"] for r in kept.collect()] == [2]


def test_layer_result_rules(spark):
    runs = runs_of(spark, [
        ("a", 1, True, "left", 1), ("a", 2, False, " ", 1), ("a", 3, False, "x", -1), ("a", 4, True, None, 0), ("b", 9, None, None, 0),
    ])
    found = results.check_layer_results(runs, frame(spark, [signal("a", 3), signal("a", 4)]))
    assert sorted((r["message_id"], r["layer"], r["rule"]) for r in found.collect()) == [
        ("a", 1, "completed with an error"), ("a", 2, "incomplete without a reason"), ("a", 3, "duration is negative"),
        ("a", 3, "incomplete with signals"), ("b", 9, "completed is missing"), ("b", 9, "layer is not one of 1-4"),
    ]


def test_missing_layers_give_their_weight_away(spark):
    """Every choice of completed layers, against the weighted mean by hand."""
    weights, strength = {1: 0.3, 2: 0.3, 3: 0.2, 4: 0.2}, {1: 0.9, 2: 0.0, 3: 0.4, 4: 0.7}
    choices = [c for n in range(5) for c in itertools.combinations(weights, n)]
    grid, signals, want = [], [], {}
    for chosen in choices:
        name = "m" + "".join(map(str, chosen))
        grid += [(name, k, k in chosen, None if k in chosen else "down", 0) for k in weights]
        signals += [signal(name, k, score=strength[k]) for k in chosen if k != 2]
        mass = sum(weights[k] for k in chosen)
        want[name] = (round(sum(weights[k] * strength[k] for k in chosen) / mass, 9) if chosen else None, list(chosen))
    grid = runs_of(spark, grid)
    made = scoring.assess(
        grid, frame(spark, signals), config.weights_table(spark), config.thresholds_table(spark),
        F.lit("2024-01-01").cast("timestamp"),
    )
    rows = {r["message_id"]: r for r in made.collect()}
    for name, (score, chosen) in want.items():
        assert rows[name]["layers_completed"] == chosen
        assert rows[name]["score"] == (None if score is None else pytest.approx(score, abs=1e-9))
    assert rows["m"]["level"] is None and rows["m"]["summary"] == "not completed: L1, L2, L3, L4"
    assert rows["m1234"]["summary"] == "all layers completed"
    # A forced L2 outage does not pull the score towards clean.
    assert rows["m134"]["score"] > rows["m1234"]["score"]


def test_abstention_is_not_a_zero(spark):
    grid = runs_of(spark, [("a", 1, True, None, 0), ("b", 1, True, None, 0), ("c", 1, True, None, 0), ("d", 1, False, "x", 0)])
    signals = frame(spark, [signal("a", error="no data", score=0.0), signal("b", error="no data", score=0.0),
                            signal("b", name="o", score=0.2), signal("d", score=1.0)])
    got = {r["message_id"]: r["score"] for r in scoring.layer_scores(grid, signals).collect()}
    assert got == {"a": None, "b": 0.2, "c": 0.0, "d": None}


def test_bands_and_actions(spark):
    scored = spark.createDataFrame([("default", s) for s in (0.0, 0.349999999, 0.35, 0.65, 1.0, None)], "profile string, score double")
    levelled = scoring.band_level(scored, config.thresholds_table(spark))
    got = {r["score"]: r["action"] for r in scoring.apply_policy(levelled, config.policy_table(spark)).collect()}
    assert got == {0.0: "deliver", 0.349999999: "deliver", 0.35: "warn", 0.65: "block", 1.0: "block", None: None}


def test_evidence_table(spark):
    grid = runs_of(spark, [("a", 1, True, None, 0), ("a", 2, False, "timeout after 15s", 0), ("a", 3, True, None, 0), ("a", 4, True, None, 0)])
    signals = frame(spark, [signal("a", 1, "x", 0.8), signal("a", 1, "y", 0.4), signal("a", 2, "late", 1.0),
                            signal("a", 4, "z", 0.0, error="no feed")])
    rows = results.evidence_table(grid, signals, config.weights_table(spark)).orderBy("layer", "name").collect()
    got = [(r["layer"], r["name"], r["status"], r["evidence"], None if r["contribution"] is None else round(r["contribution"], 6)) for r in rows]
    assert got == [
        (1, "x", "fired", "e", 0.48), (1, "y", "fired", "e", 0.0), (2, None, "not completed", "timeout after 15s", None),
        (3, None, "no findings", None, None), (4, "z", "abstained", "e", None),
    ]


def test_contributions_add_up_with_repeated_names(spark):
    grid = runs_of(spark, [("a", k, True, None, 0) for k in (1, 2, 3, 4)])
    signals = frame(spark, [signal("a", 2, "qr", 0.6), signal("a", 2, "qr", 0.5), signal("a", 2, "qr", 0.6), signal("a", 1, "x", 0.2)])
    weights = config.weights_table(spark)
    rows = results.evidence_table(grid, signals, weights).collect()
    assert sorted(r["contribution"] for r in rows if r["layer"] == 2) == [0.0, 0.0, pytest.approx(0.18)]
    whole = scoring.composite_score(scoring.layer_scores(grid, signals), weights).first()["score"]
    assert sum(r["contribution"] or 0 for r in rows) == pytest.approx(whole)


def test_quarantine_makes_the_layer_incomplete(spark):
    grid = runs_of(spark, [(m, k, k != 4, None if k != 4 else "down", 0) for m in ("a", "b") for k in (1, 2, 3, 4)])
    rows = frame(spark, [signal("a", 3, "p", float("nan")), signal("a", 1, "x", 0.5), signal(" ", 2, "x", 0.5), signal("b", 1, "y", 0.4), signal("b", 4, "z", 2.0)])
    ran = rows.withColumn("ran", F.when(F.col("name") == "y", 2).otherwise(F.col("layer")))
    good, bad = results.collect_signals(ran)
    assert [r["name"] for r in good.collect()] == ["x"] and bad.where("rule = 'layer is not the one that ran'").count() == 1
    states = {(r["message_id"], r["layer"]): (r["completed"], r["error"]) for r in results.reject_layers(grid, bad).collect()}
    assert states["a", 3] == (False, "quarantined signal: score is not finite") and states["a", 1] == (True, None)
    assert states["a", 2] == (False, "quarantined signal: message_id is blank") and not states["b", 2][0]
    assert states["b", 4] == (False, "down") and states["b", 1] == (True, None) and len(states) == 8
