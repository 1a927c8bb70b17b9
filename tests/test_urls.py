"""URL extraction, classification and registrable domains."""

import pytest
from pyspark.sql import functions as F

from mailrisk.functions import exprs
from mailrisk.operators import domains, messages, observations

#: What stands at the end of an address in running text, and what is left of it.
ENDS = {
    "": "", ".": "", "...": "", ",!": "", ")": "", "a)": "a", "(a)": "(a)", "(a)).": "(a)", "(a),)": "(a)", "a(b": "a(b", "(a(b))": "(a(b))",
    "(a(b)))": "(a(b))", "a.)b": "a.)b", "a,b,": "a,b", "(a.)": "(a.)", "(a.)).": "(a.)", "))": "", "a!)!": "a", "()": "()", "(": "(", "(()": "(()", "a).b)": "a).b",
}


def test_trim(spark):
    frame = spark.createDataFrame([(k, f"http://x/{k}") for k in ENDS], "k string, u string")
    for row in frame.select("k", exprs.trim_url(F.col("u")).alias("t")).collect():
        assert row["t"] == f"http://x/{ENDS[row['k']]}", row["k"]


@pytest.mark.parametrize(("text", "urls"), [
    ("tide tables: https://sea.example.net/t?d=1&h=2; bring them", ["https://sea.example.net/t?d=1&h=2"]),
    ("(https://sea.example.net/a) [HTTPS://SEA.example.net/B]", ["https://sea.example.net/a", "HTTPS://SEA.example.net/B"]),
    ("'http://sea.example.net/q' and <http://sea.example.net/r>", ["http://sea.example.net/q", "http://sea.example.net/r"]),
    ("http://sea.example.net/Port_(town)!", ["http://sea.example.net/Port_(town)"]),
    ("http://sea.example.net/x\u00a0y\nhttp://sea.example.net/z", ["http://sea.example.net/x", "http://sea.example.net/z"]),
    ("sea.example.net and ftp://sea.example.net are no web addresses", []),
    ("", []),
])
def test_text_urls(spark, text, urls):
    row = spark.createDataFrame([(text,)], "t string").select(exprs.text_url_array(F.col("t")).alias("u")).first()
    assert row["u"] == urls


def test_observations_keep_first_of_each_source(spark):
    markup = """<img src="https://e.com/i"><a href="https://e.com/same">First</a>
      <form action="https://e.com/same"></form><a href=" https://e.com/same ">Second</a>
      <a href="https://e.com/b">First</a><a href="mailto:a@e.com">m</a><a href="/rel">r</a><img src="cid:x">"""
    raw = f"Message-ID: <m>\nContent-Type: text/html\n\n{markup} https://e.com/same https://e.com/same".encode()
    frame = spark.createDataFrame([("m", bytearray(raw))], "source_id string, content binary")
    found = observations.url_observations(messages.normalize_messages(frame)).orderBy("pos").collect()
    assert [(r["source"], r["url"], r["anchor_text"]) for r in found] == [
        ("img_src", "https://e.com/i", None),
        ("anchor_href", "https://e.com/same", "First"),
        ("form_action", "https://e.com/same", None),
        ("anchor_href", "https://e.com/b", "First"),
        ("plain_text", "https://e.com/same", None),
    ]


def test_href_classes(spark):
    cases = {
        " HTTPS://a ": "http", "http:x": "other_scheme", "mailto:a": "mailto", "TEL:1": "tel", "cid:1": "cid",
        "data:,": "data", "JavaScript:x": "javascript", "#top": "fragment", "//host/x": "relative", "a/b": "relative",
        "\t": "empty", "ftp://x": "other_scheme",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "h string")
    for row in frame.select("h", observations.classify_href(F.col("h")).alias("k")).collect():
        assert row["k"] == cases[row["h"]], row["h"]


def test_hosts(spark):
    cases = {
        "https://User:pw@Host.Example.com:8080/x?y": "host.example.com",
        "http://a.example.com.#f": "a.example.com",
        "https://good.example.com\\@evil.example.org/": "good.example.com",
        "http://[2001:db8::1]:80/": "[2001:db8::1]",
        "http://a|b.example/?q=|": "a|b.example",
        "mailto:x@y.example": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "u string")
    for row in frame.select("u", exprs.url_host(F.col("u")).alias("h")).collect():
        assert row["h"] == cases[row["u"]], row["u"]


def test_registrable_domains(spark):
    rules = spark.createDataFrame(
        [("com", "normal"), ("uk", "normal"), ("co.uk", "normal"), ("ck", "wildcard"), ("www.ck", "exception")],
        "suffix string, kind string",
    )
    cases = {
        "a.b.example.com": "example.com", "example.com": "example.com", "com": None, "x.example.co.uk": "example.co.uk",
        "co.uk": None, "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "b.ck": None, "www.ck": "www.ck", "x.www.ck": "www.ck",
        "no.rule.test": "rule.test", "localhost": None, "192.0.2.7": "192.0.2.7",
    }
    hosts = spark.createDataFrame([(k,) for k in cases] + [(None,)], "host string")
    far = domains.registrable_domain(hosts, "host", rules, "d", max_broadcast=0)
    assert {r["host"]: r["d"] for r in far.collect()} == {**cases, None: None}
    found = domains.registrable_domain(hosts, "host", rules, "d")
    assert {r["host"]: r["d"] for r in found.collect()} == {**cases, None: None}
    assert "Exchange hashpartitioning(host" not in found._jdf.queryExecution().executedPlan().toString()
