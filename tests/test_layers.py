"""Detectors on small hand-written rows."""

import base64
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailrisk.functions import exprs
from mailrisk.operators import body, headers, intel, links

SUFFIXES = [("com", "normal"), ("org", "normal"), ("uk", "normal"), ("co.uk", "normal")]


@pytest.fixture(scope="module")
def suffixes(spark):
    return spark.createDataFrame(SUFFIXES, "suffix string, kind string")


def by_message(signals):
    return {r["message_id"]: r for r in signals.collect()}


def test_auth_reads_the_topmost_header(spark):
    cases = {
        "pass": ["mx; spf=pass a; dkim=pass; dmarc=pass"],
        "dmarc": ["mx; spf=pass; dkim=pass header.d=x; dmarc=FAIL (p=none)"],
        "two": ["mx; spf=softfail; dkim=fail; dmarc=none"],
        "one": ["mx; spf=fail"],
        "resigned": ["mx; dkim=fail header.d=list.org; spf=pass; dkim=pass header.d=x.com"], "twice": ["mx; dkim=neutral; dkim=fail; spf=pass; dmarc=pass"],
        "forged_below": ["mx; spf=pass", "evil; spf=fail"],
        "silent": ["mx; none"], "absent": None,
    }
    rows = [(k, {"authentication-results": v} if v else {}) for k, v in cases.items()]
    got = by_message(headers.auth_signals(spark.createDataFrame(rows, "message_id string, headers map<string,array<string>>")))
    assert {k: (r["score"], r["error"]) for k, r in got.items()} == {
        "dmarc": (1.0, None), "two": (0.8, None), "one": (0.5, None),
        "silent": (0.0, "no authentication results"), "absent": (0.0, "no authentication results"),
    }
    assert got["two"]["evidence"] == "failed: spf, dkim"


def test_replyto(spark, suffixes):
    rows = [("same", "a@mail.x.co.uk", "b@x.co.uk"), ("other", "a@x.co.uk", "b@y.co.uk"), ("none", "a@x.com", None), ("nosender", "", "b@y.com")]
    got = by_message(headers.replyto_signals(spark.createDataFrame(rows, "message_id string, from_addr string, reply_to string"), suffixes))
    assert set(got) == {"other"} and got["other"]["metadata"] == {"from_domain": "x.co.uk", "reply_domain": "y.co.uk"}


def test_impersonation(spark, suffixes):
    brands = spark.createDataFrame([("bank", "bank.com"), ("bank", "bank.co.uk"), ("post", "post.org")], "token string, domain string")
    rows = [("own", "Bank Service", "a@mail.bank.co.uk"), ("pose", "The BANK, Post", "a@evil.com"), ("word", "Bankers", "a@evil.com"), ("nosender", "Post", "")]
    frame = spark.createDataFrame(rows, "message_id string, from_display string, from_addr string")
    got = by_message(headers.impersonation_signals(frame, brands, suffixes))
    assert {k: r["metadata"]["brands"] for k, r in got.items()} == {"pose": "bank, post", "nosender": "post"}
    near, far = (headers.named_brands(frame, "from_display", brands, most) for most in (10, 0))
    pairs = lambda df: sorted((r["message_id"], r["token"], sorted(r["domains"])) for r in df.collect())
    assert pairs(near) == pairs(far) and len(pairs(near)) == 4


def test_brands_of_any_number_of_words(spark, suffixes):
    names = ["post", "Bank of New York Mellon", "The Most Honourable Society of Letter Carriers and Clerks"]
    brands = spark.createDataFrame([(n, "own.com") for n in names], "token string, domain string")
    rows = [("five", "BANK of New York\u200b Mellon, support", "a@evil.com"), ("nine", f"{names[2]} | post", "a@evil.com"),
            ("own", names[1], "a@own.com"), ("part", "Bank of New York", "a@evil.com"), ("none", "", "a@evil.com")]
    frame = spark.createDataFrame(rows, "message_id string, from_display string, from_addr string")
    got = by_message(headers.impersonation_signals(frame, brands, suffixes))
    assert {k: r["metadata"]["brands"] for k, r in got.items()} == {"five": names[1].lower(), "nine": f"post, {names[2].lower()}"}
    assert headers.named_brands(frame, "from_display", brands.limit(0)).count() == 0
    links_ = spark.createDataFrame([("m", f"Log in to {names[1]}", "https://evil.com/")], "message_id string, anchor_text string, url string")
    assert [r["token"] for r in headers.named_brands(links_, "anchor_text", brands).collect()] == [names[1].lower()]


def test_domain_age_abstains_on_the_unknown(spark):
    now = datetime(2024, 1, 31)
    d = lambda n: now - timedelta(days=n)
    records = spark.createDataFrame(
        [("new.com", d(5), d(1)), ("old.com", d(500), d(1)), ("neg.com", None, d(1)), ("stale.com", d(20), d(8))],
        "domain string, created_at timestamp, fetched_at timestamp",
    )
    rows = [(n, n + ".com" if n != "blank" else None, now) for n in ("new", "old", "neg", "stale", "unheard", "blank")]
    got = by_message(headers.domain_age_signals(spark.createDataFrame(rows, "message_id string, from_domain string, received_at timestamp"), records))
    assert {k: r["error"] for k, r in got.items()} == {
        "new": None, "neg": "registration unknown", "stale": "no registration record",
        "unheard": "no registration record", "blank": "no sender domain",
    }


def test_base64_addresses(spark):
    code = lambda s, pad=True: base64.urlsafe_b64encode(s.encode()).decode().rstrip("" if pad else "=")
    cases = {
        "query": "https://x.example/?e=" + code("victim@corp.example.com"),
        "bare": "https://x.example/#" + code("victim@corp.example.com", False),
        "escaped": "https://x.example/?a=1&e=" + code("vi@corp.example.com").replace("=", "%3D"),
        "tracking": "https://x.example/?utm=" + code("campaign-2024-01") + "&id=" + code("12345678@"),
        "dots": "https://x.example/?e=" + code("victim@corp..example.com"),
        "long": "https://x.example/?e=" + code("v@" + "a." * 20000 + "!"),
        "binary": "https://x.example/?b=" + base64.urlsafe_b64encode(bytes(range(200, 230))).decode(),
        "path": "https://x.example/" + code("victim@corp.example.com"),
        "plain": "https://x.example/?e=victim@corp.example.com",
    }
    got = by_message(links.base64_email_signals(spark.createDataFrame(list(cases.items()), "message_id string, url string")))
    assert set(got) == {"query", "bare", "escaped"}


def test_redirects_stop_at_loops_and_caps(spark):
    hops = [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("p", "q"), ("q", "p"), ("self", "self"), ("x", "y"), ("y", "z"), ("z", "y")]
    hops += [("fork", "b"), ("fork", "a")]
    table = spark.createDataFrame(hops, "src string, dst string")
    starts = ["c0", "c5", "p", "self", "x", "direct", "fork"]
    seen = spark.createDataFrame([("m", s) for s in starts], "message_id string, url string")
    for cap in (8, 3, 1):
        got = {r["url"]: r for r in links.resolve_redirects(seen, table, cap).collect()}
        follow = {}
        for src, dst in sorted(hops, reverse=True):
            follow[src] = dst
        for start in starts:
            chain, at = [], start
            while len(chain) < cap and at in follow and follow[at] not in [start, *chain]:
                at = follow[at]
                chain.append(at)
            assert got[start]["redirect_chain"] == chain, (start, cap)
            assert got[start]["final_url"] == at and got[start]["redirect_depth"] == len(chain)
    fired = by_message(links.redirect_signals(links.resolve_redirects(seen, table)))
    assert fired["m"]["metadata"]["depth"] == "8" and fired["m"]["score"] == 1.0


def test_redirects_are_those_of_the_time(spark):
    random.seed(12)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    names = [f"u{i}" for i in range(12)]
    hops = [(random.choice(names), random.choice(names), day(random.randint(0, 9))) for _ in range(60)]
    hops += [(None, "u1", day(1)), ("u1", None, day(9)), ("u2", "u3", None)]
    seen = [(f"m{i}", random.choice(["u0", "u1", "u2", "out"]), random.choice([None, day(-1), day(3), day(5), day(20)])) for i in range(60)] + [("none", None, day(3))]
    table = spark.createDataFrame(hops, "src string, dst string, seen_at timestamp")
    frame = spark.createDataFrame(seen, "message_id string, url string, received_at timestamp")
    for cap in (8, 2):
        got = {r["message_id"]: r for r in links.resolve_redirects_as_of(frame, table, max_hops=cap).collect()}
        assert len(got) == len(seen)
        for message, url, at in seen:
            chain, here = [], url
            while len(chain) < cap and here is not None:
                known = [(t, d) for s, d, t in hops if s == here and d and t and (at is None or t <= at)]
                newest = max((t for t, _ in known), default=None)
                step = min((d for t, d in known if t == newest), default=None)
                if step is None or step in [url, *chain]:
                    break
                chain.append(step)
                here = step
            assert got[message]["redirect_chain"] == chain, (message, cap)
            assert got[message]["redirect_depth"] == len(chain) and got[message]["final_url"] == here
    assert links.resolve_redirects_as_of(frame.limit(0), table).count() == 0
    assert links.resolve_redirects_as_of(frame, table.limit(0)).where("redirect_depth > 0").count() == 0


def test_captcha_and_qr(spark):
    pages = spark.createDataFrame([
        ("https://t/", '<div class="cf-turnstile"></div>'), ("https://h/", "<iframe src='https://js.hCaptcha.com/1/api.js'>"),
        ("https://clean/", "<p>captcha is a word</p>"),
    ], "url string, html string")
    seen = spark.createDataFrame([("a", "https://t/"), ("a", "https://h/"), ("b", "https://clean/"), ("c", "https://gone/")], "message_id string, final_url string")
    got = by_message(links.captcha_signals(seen, pages))
    assert set(got) == {"a"} and got["a"]["metadata"]["pages"] == "2"
    codes = spark.createDataFrame([("a", "https://q/", "qr_code"), ("b", "https://q/", "plain_text")], "message_id string, url string, source string")
    assert set(by_message(links.qr_signals(codes))) == {"a"}


def test_zero_width(spark):
    rows = [("subject", "a\u200bb", ""), ("body", "", "x\u2060y\ufeffz\u200c\u200d"), ("clean", "soft\u00adhyphen", "plain")]
    got = by_message(body.zero_width_signals(spark.createDataFrame(rows, "message_id string, subject string, body_text string")))
    assert {k: r["metadata"]["count"] for k, r in got.items()} == {"subject": "1", "body": "4"}


def test_long_runs_take_linear_time(spark):
    """A megabyte of dots, of spaces and of brackets: each is read once."""
    n = 1_000_000
    texts = spark.createDataFrame([("dots", "." * n + "x"), ("spaces", " " * n + "x. y"), ("brackets", "http://x/" + ")" * n + "y")], "message_id string, body_text string")
    parts = texts.select("message_id", F.size(F.split("body_text", body.SENTENCE_END)).alias("n"))
    assert {r["message_id"]: r["n"] for r in parts.collect()} == {"dots": 1, "spaces": 2, "brackets": 1}
    ends = texts.select(F.length(F.array_join(exprs.text_url_array(F.col("body_text")), "")).alias("n"), F.length(exprs.strip(F.col("body_text"))).alias("m"))
    assert {(r["n"], r["m"]) for r in ends.collect()} == {(0, n + 1), (0, 4), (n + 10, n + 10)}


def test_token_limit_cuts_across_sentences(spark):
    texts = spark.createDataFrame([("m", "one two three. four five!\n\nsix seven eight nine"), ("empty", ""), ("null", None)], "message_id string, body_text string")
    lm = body.fit_ngram_lm(texts, "body_text")
    shape = lambda n: {(r["sentence"], r["tokens"]) for r in body.sentence_scores(texts, lm, max_tokens=n).collect()}
    whole = shape(None)
    assert {t for _, t in whole} == {3, 2, 4} and len(whole) == 3
    near = {tuple(r) for r in body.sentence_scores(texts, lm).collect()}
    far = {tuple(r) for r in body.sentence_scores(texts, lm, broadcast_words=0).collect()}
    assert {r[:3] for r in near} == {r[:3] for r in far} and sum(r[3] for r in near) == pytest.approx(sum(r[3] for r in far))
    assert sum(t for _, t in shape(4)) == 4 and sum(t for _, t in shape(6)) == 6 and shape(100) == whole
    unseen = spark.createDataFrame([("u", "never heard")], "message_id string, body_text string")
    row = body.sentence_scores(unseen, lm).first()
    assert row["nll"] == pytest.approx(2.8903717578961645)  # ln(18): nine words seen once each
    silent = body.text_shape(body.sentence_scores(texts, lm), texts)
    short = by_message(body.perplexity_signals(silent))
    assert set(short) == {"m", "empty", "null"} and {r["error"] for r in short.values()} == {"body too short"}


def test_urgency_learns(spark):
    urgent = ["act now your account expires", "urgent verify immediately", "final warning act now"]
    calm = ["notes from the weekly meeting", "lunch on friday maybe", "the report is attached for review"]
    rows = [(str(i), t, label) for i in range(4) for label, group in ((1, urgent), (0, calm)) for t in group]
    train = spark.createDataFrame(rows, "message_id string, text string, label int")
    model = body.fit_urgency(train, features=1 << 10, max_iter=10)
    scored = body.score_urgency(model, spark.createDataFrame([("u", "act now, urgent", 1), ("c", "weekly lunch notes", 0)], "message_id string, text string, label int"))
    assert body.heldout_accuracy(scored) == 1.0
    assert set(by_message(body.urgency_signals(scored))) == {"u"}


def test_fusion_leaves_out_abstentions(spark):
    random.seed(4)
    rows = [(str(i), float(i % 2), random.random(), 5 + random.random(), random.random(), i % 2) for i in range(40)]
    rows.append(("gap", 1.0, 0.5, None, 0.5, 1))
    frame = spark.createDataFrame(rows, "message_id string, zero_width double, urgency double, perplexity double, burstiness double, label int")
    model, coefficients = body.fit_fusion(frame)
    assert [r["feature"] for r in coefficients.collect()] == [*body.FUSION_FEATURES, "intercept"]
    got = by_message(body.fusion_signals(model, frame))
    assert got["gap"]["error"] == "no value for perplexity"
    assert all(int(k) % 2 == 1 for k in got if k != "gap") and len(got) == 21


def test_indicators(spark, suffixes):
    feeds = intel.union_feeds(
        spark.createDataFrame([("one", "https://bad.example.com/x")], "feed string, url string"),
        spark.createDataFrame([("two", "https://bad.example.com/x"), ("two", "https://other.org/")], "feed string, url string"),
    )
    seen = spark.createDataFrame([("a", "https://bad.example.com/x"), ("b", "https://www.example.com/"), ("c", "https://fine.org/")], "message_id string, url string")
    url = by_message(intel.url_ioc_signals(seen, feeds))
    assert set(url) == {"a"} and url["a"]["evidence"] == "https://bad.example.com/x is listed by one, two"
    assert set(by_message(intel.domain_ioc_signals(seen, feeds, suffixes))) == {"a", "b"}


def test_hosting_names_owners_of_the_first_address_only(spark, monkeypatch):
    """Owners are asked for one address of each listed host, not for every address."""
    asked = []
    named = intel.hosting_matches
    monkeypatch.setattr(intel, "hosting_matches", lambda dns, networks: (asked.append(dns.count()), named(dns, networks))[1])
    dns = spark.createDataFrame([("H.example", f"10.0.0.{i}") for i in range(50)] + [("g.example", "10.0.0.7"), ("far.example", "11.0.0.1"), ("g.example", None)], "host string, ip string")
    networks = spark.createDataFrame([(10 << 24, (10 << 24) + 255, "B"), ((10 << 24) + 3, (10 << 24) + 90, "A")], "lo long, hi long, owner string")
    seen = spark.createDataFrame([("m1", "https://h.example/x"), ("m1", "https://g.example/"), ("m2", "https://far.example/"), ("m3", "https://h.example/y")], "message_id string, url string")
    got = {r["message_id"]: (r["metadata"]["host"], r["metadata"]["ip"], r["metadata"]["hosts"], r["evidence"]) for r in intel.hosting_signals(seen, dns, networks).collect()}
    assert got == {
        "m1": ("g.example", "10.0.0.7", "2", "g.example resolves to 10.0.0.7 of A, B"),
        "m3": ("h.example", "10.0.0.0", "1", "h.example resolves to 10.0.0.0 of B"),
    }
    assert asked == [2]


@pytest.mark.parametrize("order", [1, 2])
def test_frequent_words_of_a_large_model_are_not_shuffled(spark, monkeypatch, order):
    """Only occurrences of words beyond the frequent ones are joined by word; scores stay the same."""
    rows = [(f"m{i}", f"the report of the week is here. the word{i} of the day! the end") for i in range(30)] + [("m30", None), ("m31", "")]
    messages = spark.createDataFrame(rows, "message_id string, body_text string")
    lm = body.fit_ngram_lm(messages, "body_text", order=order)
    scored = lambda n: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in body.sentence_scores(messages, lm, broadcast_words=n, order=order).collect())
    want = scored(1000)
    joined, plain = [], body.lookup_join
    monkeypatch.setattr(body, "lookup_join", lambda left, *rest: (joined.append(left.count()), plain(left, *rest))[1])
    assert len(want) == 90 and scored(20) == want
    assert joined[0] <= 60, "all of 420 words are joined otherwise"
    assert scored(0) == want


def test_vectors_are_made_a_few_texts_at_a_time(spark):
    import pyarrow as pa

    from mailrisk.functions import grams

    texts = ["x" * 50000] * 20 + [None, "", "y" * 10**6, "z"]
    made = list(grams.parts(pa.record_batch({"n": list(range(24)), "t": texts}), 1))
    assert [v for part in made for v in part["n"].to_pylist()] == list(range(24)) and len(made) > 4
    assert all(part.num_rows == 1 or sum(len(t or "") for t in part["t"].to_pylist()) <= grams.TEXT_AT_ONCE for part in made)
    assert list(grams.parts(pa.record_batch({"t": pa.array([], pa.string())}), 0)) == []


def test_entries_of_vectors(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a"), (3, None), (4, "something else")], "doc_id long, text string")
    found = body.urgency_features(docs, features=1 << 10)
    want = {r["doc_id"]: sum(v > 0 for v in r["features"].toArray()) for r in found.collect()}
    assert {r["doc_id"]: r["entries"] for r in body.count_entries(found, "doc_id").collect()} == want and want[4] > want[3] == 0


def test_records_are_made_a_few_rows_at_a_time():
    import pyarrow as pa

    from mailrisk.functions.deadline import ROWS_AT_ONCE, records

    values = pa.array([str(i) if i % 7 else None for i in range(5 * ROWS_AT_ONCE + 3)])
    kind = pa.struct([("x", pa.string())])
    make = lambda v: None if v.as_py() is None else {"x": v.as_py()}
    assert records(values, make, kind).to_pylist() == [make(v) for v in values]
    assert len(records(values[:0], make, kind)) == 0


def test_sentences_are_scored_where_their_text_is(spark):
    """Sums of sentences are not shuffled unless a key repeats; messages of one key, or without a key, are one."""
    rows = [("m1", "one two. three"), ("m2", "two! . one two"), ("m3", None)]
    messages = spark.createDataFrame(rows, "message_id string, body_text string")
    lm = body.fit_ngram_lm(messages, "body_text")
    scored = body.sentence_scores(messages, lm)
    assert "Exchange hashpartitioning" not in scored._jdf.queryExecution().executedPlan().toString()
    nll = {r["token"]: r["nll"] for r in lm.collect()}
    assert {(r[0], r[1]): (r[2], round(r[3], 9)) for r in scored.collect()} == {
        ("m1", 0): (2, round((nll["one"] + nll["two"]) / 2, 9)), ("m1", 1): (1, round(nll["three"], 9)),
        ("m2", 0): (1, round(nll["two"], 9)), ("m2", 2): (2, round((nll["one"] + nll["two"]) / 2, 9))}
    twice = messages.unionByName(spark.createDataFrame([("m1", "new"), (None, "one"), (None, "two three")], messages.schema))
    for words in (0, 2, 100):
        got = {(r[0], r[1]): (r[2], round(r[3], 9)) for r in body.sentence_scores(twice, lm, broadcast_words=words).collect()}
        assert len(got) == 5 and got["m1", 0] == (3, round((nll["one"] + nll["two"] + nll[None]) / 3, 9))
        assert got[None, 0] == (3, round((nll["one"] + nll["two"] + nll["three"]) / 3, 9))
