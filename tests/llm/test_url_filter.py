"""URL filter: rules, boundaries of terms, odd rows, and the query against its SQL."""

import os

import duckdb
import pytest

from mailrisk.llm import url_filter
from mailrisk.llm.queries import ORACLE, QUERIES

#: url, host, path, rule, verdict
CASES = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme porn", "", "", None, "block"),
    ("https://Example.COM/en/1", "example.com", "/en/1", "com/en/", "block"),
    ("https://example.com/en/77?x=porn", "example.com", "/en/77", "example.com/en/7", "allow"),
    ("https://a.b.example.com/en/7", "a.b.example.com", "/en/7", "example.com/en/7", "allow"),
    ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("http://x.example.net/de/8", "x.example.net", "/de/8", "example.net/de/8", "block"),
    ("http://x.example.net/de/7?porn", "x.example.net", "/de/7", "net/de/", "allow"),
    ("http://org/es/", "org", "/es/", "org/es/", "block"),
    ("http://org", "org", "", None, "allow"),
    ("x://h?p#f/en/", "h", "", None, "allow"),
    ("x://h#a://b/c", "h", "", None, "allow"),
    ("http://a.de/casino", "a.de", "/casino", None, "allow"),
    ("http://a.de/casino/casino", "a.de", "/casino/casino", None, "allow"),
    ("http://a.de/casino-POKER", "a.de", "/casino-POKER", None, "block"),
    ("http://a.de/casinopoker", "a.de", "/casinopoker", None, "allow"),
    ("http://xxx.de/", "xxx.de", "/", None, "block"),
    ("http://xxxl.de/1xxx/", "xxxl.de", "/1xxx/", None, "allow"),
    ("http://ä.de/äxxxä", "ä.de", "/äxxxä", None, "block"),
    ("http://a.de/" + "y" * 100000 + "?win_free", "a.de", "/" + "y" * 100000, None, "block"),
]


def test_cases(spark):
    rows = [(i, c[0], "a", "b", 1) for i, c in enumerate(CASES)]
    pages = spark.createDataFrame([*rows, rows[3]], "page_id long, url string, host string, verdict string, strict_hits int")
    got = sorted(url_filter.filter_urls(pages).collect(), key=lambda r: r.page_id)
    assert len(got) == len(CASES) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == CASES[r.page_id][1:], CASES[r.page_id][0][:80]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    answer = {r[0]: r[1:] for r in db.execute(url_filter.sql()).fetchall()}
    assert answer == {r.page_id: tuple(r)[1:] for r in got}


def test_no_terms_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://xxx.com/en/")], "page_id long, url string")
    row = url_filter.filter_urls(pages, rules=(), vocabulary=url_filter.Vocabulary((), ())).first()
    assert (row.rule, row.verdict) == (None, "allow")


@pytest.mark.parametrize("name", ["op5_url_filter", "op4_substring"])
def test_query_agrees_with_sql(spark, name):
    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("pages", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(folder, table)}.parquet'")
    frame = QUERIES[name](spark, folder)
    answer = db.execute(ORACLE[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(str, answer.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())
