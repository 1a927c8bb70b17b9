import base64
import random

from pyspark.sql import functions as F

from mailrisk.sources import assessments, config, mailbox


def strict(raw):
    """What a strict decoder of URL-safe base64 makes of a payload."""
    try:
        data = raw.encode("ascii")
        return base64.b64decode(data + b"=" * (-len(data) % 4), altchars=b"-_", validate=True)
    except ValueError:
        return None


def test_decode_raw_is_strict(spark):
    random.seed(3)
    payloads = ["SGk", "SGk=", "SGk==", "SGk===", "SG", "SG=", "SG==", "SG===", "S", "SGVs", "SGVs=", "SGVs====",
                "-_-_", "+/+/", "SGVs bG8", "SGVsbG8\n", "\nSGVs", "!!!", "sné", "=", "==", "SG=k", "SGk=SGk="]
    payloads += ["".join(random.choice("AQgw-_+/=") for _ in range(random.randint(1, 9))) for _ in range(400)]
    payloads = sorted(set(payloads))
    export = spark.createDataFrame([(p, p) for p in payloads] + [("null", None), ("blank", "")], "source_id string, raw string")
    good, rejects = mailbox.decode_raw(export)
    decoded = {r["source_id"]: bytes(r["content"]) for r in good.collect()}
    refused = {r["source_id"]: (r["stage"], r["reason"]) for r in rejects.collect()}
    for p in payloads:
        want = strict(p)
        assert decoded.get(p) == want, p
        assert (p in refused) == (want is None), p
    assert refused["null"] == refused["blank"] == ("transport", "no raw payload")
    assert refused["!!!"] == ("transport", "not valid base64url")


def test_listing_keeps_order_and_repeats(spark):
    listing = spark.createDataFrame(
        [(3, "a", True), (1, "b", True), (2, None, True), (4, "a", True), (5, "c", False), (6, "", True)],
        "pos long, id string, unread boolean",
    )
    ids = lambda *a: [r["id"] for r in mailbox.select_message_ids(listing, *a).collect()]
    assert ids("unread") == ["b", "a", "a"]
    assert ids(F.col("unread"), 2) == ["b", "a"]
    assert ids("unread", 0) == [] and ids("unread", -1) == []


def test_message_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(b"Subject: a\n\nx")
    (tmp_path / "in" / "b.txt").write_bytes(b"not mail")
    rows = mailbox.read_message_files(spark, str(tmp_path / "in")).collect()
    assert [(r["source_id"].rsplit("/", 1)[1], bytes(r["content"])) for r in rows] == [("a.eml", b"Subject: a\n\nx")]


def test_weights_file(spark, tmp_path):
    path = tmp_path / "w.yaml"
    path.write_text("# c\nlayers:\n  l1: 0.5 # x\n  l4: 0.5\n\nthresholds:\n  deliver: 0.2\n  block: 0.9\n")
    weights, thresholds = config.load_weights(spark, str(path), "p")
    assert sorted(map(tuple, weights.collect())) == [("p", 1, 0.5), ("p", 4, 0.5)]
    assert [tuple(r) for r in thresholds.collect()] == [("p", 0.2, 0.9)]


def test_store_gives_the_latest(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("a", 0.1, "low", "2024-01-01"), ("a", 0.9, "high", "2024-01-03"), ("b", None, None, "2024-01-02")]
    made = spark.createDataFrame(rows, "message_id string, score double, level string, at string").select(
        "message_id", "score", "level", F.to_timestamp("at").alias("scored_at")
    )
    assessments.write_assessments(made, path)
    back = spark.read.schema(made.schema).parquet(path)
    latest = assessments.latest_assessments(back).collect()
    assert [(r["message_id"], r["score"], r["level"]) for r in latest] == [("a", 0.9, "high"), ("b", None, None)]
    assert assessments.latest_assessments(back, 1).count() == 1
    assert '"level":"high"' in assessments.as_json(assessments.latest_assessments(back, 1)).first()["json"]
