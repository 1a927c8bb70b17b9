"""Message normalisation on hand-written bytes."""

import hashlib

import pytest

from mailrisk.functions.html import scan_html
from mailrisk.functions.mime import decode_mail
from mailrisk.operators import messages, observations

def letter(*headers, body="", sep="\n"):
    """Bytes of a message from header lines and a body."""
    return (sep.join([*headers, "", body])).encode("utf-8", "surrogateescape")


def section(mark, *children, end=True):
    """A multipart body of already written children."""
    return "".join(f"--{mark}\n{c}\n" for c in children) + (f"--{mark}--\n" if end else "")


HARBOUR = "Harbour office <desk@harbour.example.net>"
TIDES = "Content-Type: text/plain\n\nHigh water at nine."
TIDES_PAGE = 'Content-Type: text/html\n\n<p>High water <a href="https://tides.example.net/9">at nine</a></p>'
CHART = 'Content-Type: application/octet-stream; name="chart.bin"\nContent-Transfer-Encoding: base64\n\nAAECAwQFBgcICQ==\n'
STAMP = "Content-Type: image/gif\nContent-ID: <stamp@harbour>\nContent-Transfer-Encoding: base64\n\nR0lGODlh\n"

MAIL = {
    "berth": letter(
        "Received: from gate (gate.harbour.example.net)\n\tby quay.example.net;\n\tMon, 4 Mar 2024 08:15:30 +0100",
        "Received: from cabin by gate (gate.harbour.example.net)", f"From: {HARBOUR}", "To: pilot@quay.example.net",
        "Message-ID: <berth.7@harbour.example.net>", "Subject: Berth 7", 'Content-Type: text/plain; charset="iso-8859-1"',
        body="Free until noon, plan at http://quay.example.net/berths?n=7 as usual.\n"),
    "page": letter(
        f"From: {HARBOUR}", "Subject: Fees", "Message-ID: <fees@harbour.example.net>", "Content-Type: text/html; charset=utf-8",
        body="<h1>Fees &lt;2024&gt;</h1><script>pay()</script><p>See <a href='https://fees.example.net/list'>the <i>list</i></a></p><style>h1 {}</style>"),
    "coded": letter(
        "Message-ID: <c>", "From: =?iso-8859-1?Q?J=FCrgen_K=E4se?= <jk@dairy.example.net>", "To: =?utf-8?q?R=C3=A9my?= <remy@shop.example.net>",
        "Reply-To: <orders@cheese.example.net>", "Subject: =?utf-8?q?Preis=C3=A4nderung?= im =?utf-8?b?TcOkcno=?=", body="Neue Preise.\n"),
    "crew": letter(
        "Message-ID: <crew>", "To: mate@ship.example.net,", " Cook <cook@ship.example.net>", "Cc: owner@ship.example.net",
        "To: boy@ship.example.net, mate@ship.example.net", "From: captain@ship.example.net", body="All aboard.\n"),
    "tree": letter(
        "Message-ID: <tree>", f"From: {HARBOUR}", "MIME-Version: 1.0", "Content-Type: multipart/related; boundary=outer", body="preamble\n" + section(
            "outer", "Content-Type: multipart/alternative; boundary=inner\n\n" + section("inner", TIDES_PAGE, TIDES),
            STAMP, CHART.replace("\n\n", "\nContent-Disposition: attachment\n\n", 1))),
    "torn": letter(
        "Message-ID: <torn>", f"From: {HARBOUR}", "Content-Type: multipart/alternative", body="The rest was lost at sea: http://sea.example.net/\n"),
    "cargo": letter(
        "Message-ID: <cargo>", "Content-Type: multipart/mixed; boundary=hold",
        body=section("hold", 'Content-Type: text/plain\nContent-Disposition: attachment; filename="list.txt"\n\none box\n')),
    "no_id": letter("Subject: unnumbered", "From: x@ship.example.net", body="Body"),
    "blank_id": letter("From: x@ship.example.net", "Message-ID:", body="Body"),
    "blank_from": letter("Message-ID: <f1>", "From: ", "To: y@ship.example.net", body="Body"),
    "odd_from": letter("Message-ID: <f2>", "Subject: still here", "From: <<at the quay>>", body="Body"),
    "bare": letter("Message-ID: <bare>", "From: x@ship.example.net"),
    "unknown_charset": "Content-Type: text/plain; charset=x-morse\nContent-Transfer-Encoding: 8bit\n\nsalaé".encode(),
    "noise": bytes(range(200, 256)) + b" no header here",
    "empty": b"",
}


@pytest.fixture(scope="module")
def mail(spark):
    raw = spark.createDataFrame([(k, bytearray(v)) for k, v in MAIL.items()], "source_id string, content binary")
    return {r["source_id"]: r for r in messages.normalize_messages(raw, keep_raw=True).collect()}


def test_fields(mail):
    row = mail["berth"]
    assert (row["message_id"], row["subject"]) == ("<berth.7@harbour.example.net>", "Berth 7")
    assert (row["from_display"], row["from_addr"], row["to_addrs"]) == ("Harbour office", "desk@harbour.example.net", ["pilot@quay.example.net"])
    assert row["body_text"] == "Free until noon, plan at http://quay.example.net/berths?n=7 as usual.\n"
    assert (row["body_html"], row["reply_to"], row["attachments"], row["html_error"]) == (None, None, [], None)
    assert bytes(row["raw"]) == MAIL["berth"]


def test_headers_keep_order_and_fold(mail):
    top, below = mail["berth"]["received_chain"]
    assert top.split() == "from gate (gate.harbour.example.net) by quay.example.net; Mon, 4 Mar 2024 08:15:30 +0100".split()
    assert below == "from cabin by gate (gate.harbour.example.net)" and mail["berth"]["headers"]["received"] == [top, below]
    assert mail["berth"]["headers"]["from"] == [HARBOUR]


def test_page_gives_text_without_script(mail):
    row = mail["page"]
    assert row["body_text"] == "Fees <2024>\nSee\nthe\nlist" and row["body_html"].startswith("<h1>")
    assert [(l["href"], l["anchor_text"]) for l in row["links"]] == [("https://fees.example.net/list", "thelist")]


def test_coded_headers(mail):
    row = mail["coded"]
    assert (row["subject"], row["from_display"], row["from_addr"]) == ("Preisänderung im März", "Jürgen Käse", "jk@dairy.example.net")
    assert (row["to_addrs"], row["reply_to"]) == (["remy@shop.example.net"], "orders@cheese.example.net")


def test_recipients_in_order_once(mail):
    assert mail["crew"]["to_addrs"] == [f"{who}@ship.example.net" for who in ("mate", "cook", "boy")]
    assert mail["crew"]["headers"]["cc"] == ["owner@ship.example.net"]


def test_tree_of_parts(mail):
    row = mail["tree"]
    assert row["body_text"].strip() == "High water at nine." and "tides.example.net" in row["body_html"]
    found = [(a["filename"], a["content_type"], a["size_bytes"], a["content_id"]) for a in row["attachments"]]
    assert found == [("", "image/gif", 6, "stamp@harbour"), ("chart.bin", "application/octet-stream", 10, None)]


def test_damage(mail):
    assert mail["torn"]["body_text"].startswith("The rest was lost")
    assert mail["cargo"]["body_text"] == "" and [a["filename"] for a in mail["cargo"]["attachments"]] == ["list.txt"]
    assert mail["unknown_charset"]["body_text"] == "salaé"


def test_ids_fall_back_to_a_hash(mail):
    for name in ("no_id", "blank_id", "noise", "empty"):
        assert mail[name]["message_id"] == "sha256:" + hashlib.sha256(MAIL[name]).hexdigest()


def test_no_sender_is_invented(mail):
    for name in ("blank_from", "odd_from", "noise", "empty", "cargo"):
        assert (mail[name]["from_addr"], mail[name]["from_display"]) == ("", ""), name
    assert mail["odd_from"]["subject"] == "still here" and "from" not in mail["cargo"]["headers"]
    assert (mail["bare"]["body_text"], mail["bare"]["links"]) == ("", [])


def test_same_bytes_give_the_same_record():
    for raw in MAIL.values():
        assert decode_mail(raw) == decode_mail(raw)


def test_missing_content_is_a_parse_reject(spark):
    raw = spark.createDataFrame([("a", None), ("b", bytearray(b"x: y\n\n"))], "source_id string, content binary")
    decoded = messages.decode_messages(raw)
    assert [tuple(r) for r in messages.parse_rejects(decoded).collect()] == [("a", "parse", "content is missing")]
    assert messages.normalize_messages(raw).count() == 1


def test_decode_runs_once_in_the_plan(spark):
    raw = spark.createDataFrame([("b", bytearray(b"x: y\n\n"))], "source_id string, content binary")
    mail = messages.normalize_messages(raw)
    for frame in (mail, observations.url_observations(mail)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("_mail_record(") == 1 and plan.count("_html_scan(") == 1
        assert "Exchange" not in plan


@pytest.mark.parametrize(("markup", "text", "anchors"), [
    ("<p>a<!-- c -->b</p>", "a\nb", []),
    ("<a href=1>one<a href=2>two</a>three</a>", "one\ntwo\nthree", ["onetwothree", "two"]),
    ("<a href=1>open <b>bold</i></b> text", "open\nbold\ntext", ["openboldtext"]),
    ("<a href=1> </a><a>none</a><a href>x</a>", "none\nx", [None, "x"]),
    ("x &lt;y&gt; &#65;&#x42; &bogus; z", "x <y> AB &bogus z", []),
    ("<br/>a<br>b</br><template>t</template><ruby>r<rt>s</rt></ruby>", "a\nb\nr", []),
    ("<p>a</p><script>if (x < 1) {</script>b<style>", "a\nb", []),
    ("", "", []),
])
def test_html_scan(markup, text, anchors):
    found = scan_html(markup)
    assert found["text"] == text
    assert [l["anchor_text"] for l in found["links"] if l["source"] == "anchor_href"] == anchors


def test_refused_markup_keeps_what_was_read():
    found = scan_html('<p>before <a href="https://bad.example.org/login">go</a><![odd thing')
    assert found["text"] == "before\ngo" and [l["href"] for l in found["links"]] == ["https://bad.example.org/login"]
    assert found["error"] and scan_html("<p>fine")["error"] is None


def test_plain_header_values_are_what_the_library_decodes():
    """Where a header's text is read without the library, the library says the same; a unique address is such a one."""
    import random

    from mailrisk.functions import mime

    rng = random.Random(4)
    bits = ["a", "b-1", "Ann Lee", '"Ann Lee"', "user7@mail.x.co.uk", "<u.v@h.org>", ",", " ", "  ", ", ", "\r\n ", "\n\t", "=?utf-8?q?x?=", "=?", "é", "(c)", ";", ":",
            "<", ">", '"', "a@b", "<a@b>", "..", ".", "x.", "\t", "Undisclosed", "@", "_", "-", "--", "1"]
    values = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(6000)]
    values += ['"Sender x" <user1@mail.x.co.uk>', 'a1@x.org, "Second" <b@x.org>', "<1@x.example.com>", "from a.example.com\n by b.example.org", " lead", "trail ", "Second <b@x.org>,c@x.org"]
    read = 0
    for name in ("from", "to", "cc", "bcc", "reply-to", "message-id", "subject", "received", "authentication-results"):
        for value in values:
            found = mime._plain_value(name, value)
            if found is not None:
                read += 1
                assert mime._one_line(found) == mime._one_line(mime._POLICY.header_fetch_parse(name, value)), (name, value)
    assert read > 3000
    assert mime._plain_value("from", '"Sender x" <user1@mail.x.co.uk>') == "Sender x <user1@mail.x.co.uk>"
    assert mime._plain_value("to", 'a1@x.org, "Second" <b@x.org>') == "a1@x.org, Second <b@x.org>"
    assert mime._plain_value("content-type", "text/plain") is None
