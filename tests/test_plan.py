"""The whole plan: one failing layer sinks nothing and is never clean."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mailrisk import session
from mailrisk.operators import scoring
from mailrisk.plans import assess_mail as plan
from mailrisk.plans.evaluate import write_report
from mailrisk.schemas import SIGNALS
from mailrisk.sources import config

RAW = {
    "threat": b"""Message-ID: <same@example.com>
From: My Bank <a@evil.com>
Received: from x by mx; Sat, 2 Mar 2024 10:00:00 +0100
Reply-To: b@other.org
Authentication-Results: mx; spf=fail; dkim=fail; dmarc=fail
Content-Type: text/html

<a href="https://short.example.com/1">My Ba&#8203;nk login</a> <a href="https://bad.example.org/x">x</a>
""",
    "clean": b"""Message-ID: <same@example.com>
From: Ann <a@work.com>
Authentication-Results: mx; spf=pass; dkim=pass; dmarc=pass

Minutes of the meeting.
""",
    "unread": None,
}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(k, bytearray(v) if v else None) for k, v in RAW.items()], "source_id string, content binary")


@pytest.fixture(scope="module")
def records(spark):
    table = spark.createDataFrame
    return plan.Records(
        suffixes=table([("com", "normal"), ("org", "normal")], "suffix string, kind string"),
        brands=table([("My Bank", "bank.com")], "token string, domain string"),
        hops=table([("https://short.example.com/1", "https://h2/"), ("https://h2/", "https://h3/"), ("https://h3/", "https://gate/")], "src string, dst string"),
        pages=table([("https://gate/", "<div class=g-recaptcha>")], "url string, html string"),
        registrations=table([("evil.com", datetime(2024, 2, 27), datetime(2024, 3, 1))], "domain string, created_at timestamp, fetched_at timestamp"),
        feeds=table([("f", "https://bad.example.org/x", datetime(2024, 3, 1)), ("f", "https://short.example.com/1", datetime(2024, 2, 1))], "feed string, url string, fetched_at timestamp"),
        feed_status=table([("f", datetime(2024, 3, 1), True)], "feed string, snapshot_at timestamp, usable boolean"),
        dns=table([("bad.example.org", "203.0.113.9")], "host string, ip string"),
        networks=table([(203 << 24, (204 << 24) - 1, "AS1")], "lo long, hi long, owner string"),
    )


def run(spark, raw, layers, **kw):
    moment = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    return plan.assess_mail(raw, layers, config.weights_table(spark), config.thresholds_table(spark), moment, **kw)


def test_all_layers(spark, raw, records, tmp_path):
    codes = spark.createDataFrame([("clean", "https://bad.example.org/x")], "message_id string, url string")
    done = run(spark, raw, plan.standard_layers(records), qr_decodes=codes)
    fired = {}
    for r in done.signals.where("error IS NULL").collect():
        fired.setdefault(r["message_id"], set()).add(r["name"])
    assert fired["threat"] == {
        "auth_fail", "replyto_mismatch", "domain_age_lt_7d", "display_name_impersonation", "domain_mismatch_brand", "redirect_depth",
        "captcha_gate", "zero_width", "url_ioc", "domain_ioc", "hosting_flag",
    }
    # A URL read from an image enters the other URL signals again.
    assert fired["clean"] == {"qr_url", "url_ioc", "domain_ioc", "hosting_flag"}
    rows = {r["source_id"]: r for r in done.assessments.collect()}
    assert set(rows) == {"threat", "clean"} and {r["message_id"] for r in rows.values()} == {"<same@example.com>"}
    assert rows["threat"]["level"] == "high" and rows["threat"]["layers_completed"] == [1, 2, 3, 4]
    assert [tuple(r) for r in done.rejects.collect()] == [("unread", "parse", "content is missing")]
    assert done.quarantine.count() == 0

    labels = spark.createDataFrame([("threat", 1), ("clean", 0)], "message_id string, label int")
    names = write_report(done.signals, done.grid, labels, config.weights_table(spark), config.thresholds_table(spark), str(tmp_path))
    back = {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in names}
    assert back["ablation"] == 5 and back["fitted_weights"] == 4 and back["confusion"] == 2


def test_failures_stay_in_their_layer(spark, raw):
    def breaks_at_once(mail):
        raise ValueError("no model")

    def breaks_in_the_job(mail):
        return mail.messages.select(
            "message_id", F.lit(3).alias("layer"), F.lit("n").alias("name"), F.raise_error(F.lit("bad row")).cast("double").alias("score"),
            F.lit("low").alias("severity"), F.lit("e").alias("evidence"), F.create_map().cast("map<string,string>").alias("metadata"),
            F.lit(None).cast("string").alias("error"),
        )

    layers = {1: lambda mail: spark.createDataFrame([("threat", 1, "n", 0.9, "high", "e", {}, None)], SIGNALS),
              2: breaks_at_once, 3: breaks_in_the_job, 4: lambda mail: None}
    done = run(spark, raw, layers)
    errors = {(r["message_id"], r["layer"]): r["error"] for r in done.grid.collect()}
    for message in ("threat", "clean"):
        assert errors[message, 1] is None and errors[message, 2] == "ValueError: no model"
        assert errors[message, 4] == "TypeError: layer returned no signals table"
        assert errors[message, 3] is not None
    rows = {r["source_id"]: (r["score"], r["layers_completed"]) for r in done.assessments.collect()}
    assert rows == {"threat": (0.9, [1]), "clean": (0.0, [1])}


def test_unusable_feed_makes_layer_four_incomplete(spark, raw, records):
    from dataclasses import replace

    stale = replace(records, feed_status=spark.createDataFrame([("f", None, True), ("g", None, False)], "feed string, snapshot_at timestamp, usable boolean"))
    done = run(spark, raw, {4: plan.standard_layers(stale)[4]})
    states = {r["layer"]: (r["completed"], r["error"]) for r in done.grid.where("message_id = 'threat'").collect()}
    assert states[4] == (False, "LayerUnavailable: no usable snapshot: g")
    assert not any(done for done, _ in states.values())
    assert {r["score"] for r in done.assessments.collect()} == {None}


def states_of(done, message="clean"):
    return {r["layer"]: (r["completed"], r["error"]) for r in done.grid.where(F.col("message_id") == message).collect()}


def test_what_is_not_recorded_is_not_clean(spark, raw, records):
    from dataclasses import replace

    for changed, reason in (
        ({"feed_status": None}, "LayerUnavailable: the state of the feeds is not recorded"),
        ({"feeds": None}, "LayerUnavailable: no feeds are recorded"),
        ({"feed_status": records.feed_status.limit(0)}, "LayerUnavailable: no feed is expected"),
    ):
        done = run(spark, raw, {4: plan.standard_layers(replace(records, **changed))[4]})
        assert states_of(done)[4] == (False, reason)
        assert {r["score"] for r in done.assessments.collect()} == {None}


def test_quarantine_and_textless_errors_and_limits(spark, raw):
    def one(layer, score):
        return lambda mail: spark.createDataFrame([("clean", layer, "n", score, "low", "e", {}, None)], SIGNALS)

    def silent(mail):
        raise TimeoutError

    done = run(spark, raw, {1: one(1, 0.2), 2: silent, 3: one(3, float("nan")), 4: one(1, 0.9)})
    assert states_of(done) == {
        1: (True, None), 2: (False, "TimeoutError"), 3: (False, "quarantined signal: score is not finite"),
        4: (False, "quarantined signal: layer is not the one that ran"),
    }
    scores = {r["source_id"]: (r["score"], r["layers_completed"]) for r in done.assessments.collect()}
    assert scores == {"clean": (0.2, [1]), "threat": (0.0, [1, 3, 4])}
    assert all(r["duration_ms"] > 0 for r in done.grid.where("layer = 1").collect())

    late = run(spark, raw, {1: one(1, 0.2), 2: one(2, 0.4)}, limits={1: 0.0})
    assert states_of(late)[1] == (False, "timeout after 0s") and states_of(late)[2] == (True, None)
    assert {r["source_id"]: r["score"] for r in late.assessments.collect()} == {"clean": 0.4, "threat": 0.0}


def test_mistakes_in_a_layer_end_the_plan(spark, raw):
    with pytest.raises(AnalysisException):
        run(spark, raw, {1: lambda mail: mail.messages.select("no_such_column")})
    missing = run(spark, raw, {1: lambda mail: spark.read.parquet("/no/such/table")})
    assert not states_of(missing)[1][0] and states_of(missing)[1][1].startswith("AnalysisException")


def test_refused_markup_and_short_texts_abstain(spark, records):
    broken = b"Message-ID: <b>\nFrom: Ann <a@work.com>\nContent-Type: text/html\n\n<p>hi</p><![odd thing"
    frame = spark.createDataFrame([("broken", bytearray(broken))], "source_id string, content binary")
    done = run(spark, frame, plan.standard_layers(records))
    silent = {(r["layer"], r["name"]) for r in done.signals.where("error LIKE 'markup could not be read%'").collect()}
    assert silent == {(2, "links_unread"), (3, "text_unread"), (4, "intel_unread")}
    scores = scoring.layer_scores(done.grid, done.signals).where("layer > 1").collect()
    assert {r["score"] for r in scores} == {None} and all(r["completed"] for r in scores)


def test_a_hostile_message_is_cut_alone(spark, records):
    """Markup and parts without end: each such message stops at the deadline, the others are judged as ever."""
    page = b"Message-ID: <p>\nFrom: Ann <a@work.com>\nContent-Type: text/html\n\n" + b"<b>x</b>" * 600_000
    nest = b"From: Ann <a@work.com>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n" + b"--b\nContent-Type: text/plain\n\nhi\n" * 120_000
    calm = b"Message-ID: <%d>\nFrom: Ann <a@work.com>\nContent-Type: text/html\n\n<p>hi</p>"
    rows = [("page", bytearray(page)), ("nest", bytearray(nest))] + [(f"c{i}", bytearray(calm % i)) for i in range(4)]
    frame = spark.createDataFrame(rows, "source_id string, content binary").repartition(1)
    done = run(spark, frame, plan.standard_layers(records), deadline_s=0.75)
    assert [tuple(r) for r in done.rejects.collect()] == [("nest", "parse", "timeout after 0.75s")]
    assert {k: v for k, v in states_of(done, "page").items() if k > 1} == dict.fromkeys((2, 3, 4), (False, "timeout after 0.75s"))
    assert states_of(done, "page")[1] == (True, None)
    took = {(r["message_id"], r["layer"]): r["duration_ms"] for r in done.grid.collect()}
    for layer in (2, 3, 4):
        others = [took[f"c{i}", layer] for i in range(4)]
        assert took["page", layer] - max(others) >= 500, "its own time counts for it alone"
        assert all(states_of(done, f"c{i}")[layer] == (True, None) for i in range(4))
    assert done.signals.where("message_id = 'page' AND layer > 1").count() == 0


def test_no_deadline_changes_nothing(spark, raw, records):
    free, held = (run(spark, raw, plan.standard_layers(records), deadline_s=d) for d in (None, 60.0))
    rows = lambda done: sorted(map(str, done.assessments.drop("scored_at").collect()))
    assert rows(free) == rows(held)


def test_work_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "work_folder", lambda _: str(tmp_path / "work"))
    session.cut_lineage(spark.range(3))
    assert (tmp_path / "work").is_dir()
    session.drop_work(spark)
    assert not (tmp_path / "work").exists()
