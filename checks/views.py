"""Inputs derived from the driver tables, once for Spark and once as SQL text.

The driver tables hold no mail. Each view maps whole tables to the shape an
operator takes, by arithmetic on their columns, so that both engines build
the same rows and the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.functions import exprs


# The driver tables have fixed schemas, so no job is spent on reading footers.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table; `spread` deals it to all cores when the file has too few splits.

    The driver writes one row group per file, which one task would read and decode
    alone; whole texts and markup are spread. A table with a file or more for every
    core is read as it is.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    frame = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and len(frame.inputFiles()) < cores:
        return frame.repartition(cores)
    return frame


def with_views(*names: str) -> str:
    """WITH clause for these views and the views they need, in order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted) + "\n"


SQL: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


# --- recorded layer runs and signals, from events ------------------------------

def k_value():
    """The number in an event's properties."""
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def layer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events are the four layers of a message; `error` events did not complete."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.expr("cast(event_id div 4 as string)").alias("message_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("layer"),
        (~failed).alias("completed"),
        F.when(failed, F.concat(F.lit("failed for user "), F.col("user_id"))).alias("error"),
        (k_value() * 250).cast("bigint").alias("duration_ms"),
    )


SQL["layer_runs"] = """
SELECT CAST(event_id // 4 AS VARCHAR) AS message_id, CAST(event_id % 4 + 1 AS INTEGER) AS layer,
       event_type <> 'error' AS completed,
       CASE WHEN event_type = 'error' THEN 'failed for user ' || user_id END AS error,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 250 AS duration_ms
FROM events"""


def recorded_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views find nothing, signups abstain, other events fire; a high k fires once more."""
    events = table(spark, sf_dir, "events")
    base = events.select(
        F.expr("cast(event_id div 4 as string)").alias("message_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("layer"),
        "event_type", "value", k_value().alias("k"),
    )
    abstains = F.col("event_type") == "signup"
    score = F.when(abstains, 0.0).otherwise(F.least(F.lit(1.0), F.col("value") / 100))
    by_type = base.where(F.col("event_type") != "view").select(
        "message_id", "layer", F.col("event_type").alias("name"), score.alias("score"),
        F.when(abstains, F.lit("no record")).alias("error"),
    )
    by_k = base.where(F.col("k") >= 70).select(
        "message_id", "layer", F.lit("burst").alias("name"), (F.col("k") / 100).alias("score"),
        F.lit(None).cast("string").alias("error"),
    )
    severity = F.when(F.col("score") >= 0.65, "high").when(F.col("score") >= 0.35, "medium").otherwise("low")
    return by_type.unionByName(by_k).select(
        "message_id", "layer", "name", "score", severity.alias("severity"),
        F.concat(F.col("name"), F.lit(" in layer "), F.col("layer")).alias("evidence"),
        F.create_map().cast("map<string,string>").alias("metadata"), "error",
    )


SQL["recorded_signals"] = """
SELECT message_id, layer, name, score,
       CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS severity,
       name || ' in layer ' || layer AS evidence, error
FROM (
  SELECT CAST(event_id // 4 AS VARCHAR) AS message_id, CAST(event_id % 4 + 1 AS INTEGER) AS layer,
         event_type AS name,
         CASE WHEN event_type = 'signup' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, value / 100) END AS score,
         CASE WHEN event_type = 'signup' THEN 'no record' END AS error
  FROM events WHERE event_type <> 'view'
  UNION ALL
  SELECT CAST(event_id // 4 AS VARCHAR), CAST(event_id % 4 + 1 AS INTEGER), 'burst',
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 100::DOUBLE, NULL
  FROM events WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 70
)"""


def run_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth message id has no recorded run at all for its last layers."""
    return table(spark, sf_dir, "events").select(
        F.expr("cast(event_id div 3 as string)").alias("message_id")
    ).distinct()


SQL["run_messages"] = "SELECT DISTINCT CAST(event_id // 3 AS VARCHAR) AS message_id FROM events"


def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("message_id"), F.col("toxic").alias("label")
    )


SQL["run_labels"] = "SELECT CAST(doc_id AS VARCHAR) AS message_id, toxic AS label FROM labels"

# Completeness grid: a row for every message and layer.
SQL["grid"] = """
SELECT m.message_id, l.layer, coalesce(r.completed, false) AS completed,
       CASE WHEN r.message_id IS NULL THEN 'layer returned no result'
            WHEN NOT r.completed THEN r.error END AS error,
       coalesce(r.duration_ms, 0) AS duration_ms
FROM run_messages m CROSS JOIN (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS layer) l
LEFT JOIN layer_runs r ON r.message_id = m.message_id AND r.layer = l.layer"""
NEEDS["grid"] = ("run_messages", "layer_runs")

SQL["scores"] = """
SELECT g.message_id, g.layer, g.completed,
       CASE WHEN NOT g.completed THEN NULL WHEN s.produced IS NULL THEN 0.0 ELSE s.score END AS score
FROM grid g LEFT JOIN (
  SELECT message_id, layer, count(*) AS produced, max(score) FILTER (error IS NULL) AS score
  FROM recorded_signals GROUP BY ALL) s ON s.message_id = g.message_id AND s.layer = g.layer"""
NEEDS["scores"] = ("grid", "recorded_signals")

SQL["weights"] = """
SELECT * FROM (VALUES ('default', 1, 0.3::DOUBLE), ('default', 2, 0.3), ('default', 3, 0.2), ('default', 4, 0.2))
AS w(profile, layer, weight)"""

SQL["composite"] = """
SELECT w.profile, s.message_id,
       round(sum(w.weight * s.score) FILTER (s.score IS NOT NULL) / sum(w.weight) FILTER (s.score IS NOT NULL), 9) AS score,
       coalesce(list_sort(list(s.layer) FILTER (s.completed)), []) AS layers_completed
FROM scores s JOIN weights w ON w.layer = s.layer GROUP BY w.profile, s.message_id"""
NEEDS["composite"] = ("scores", "weights")

SQL["levelled"] = """
SELECT message_id, score, layers_completed,
       CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.35 THEN 'medium' WHEN score IS NOT NULL THEN 'low' END AS level
FROM composite"""
NEEDS["levelled"] = ("composite",)


# --- raw mail, from documents ------------------------------------------------

HTML_TEXT = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"


def raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per document, of four kinds by id.

    0 plain text; 1 plain text with a base64 attachment; 2 HTML only; 3 plain text and
    HTML with an inline image. Every fifth has no Message-ID, every third a Reply-To.
    """
    docs = table(spark, sf_dir, "documents", spread=True)
    return docs.selectExpr(
        "doc_id", "cast(doc_id as string) as source_id",
        f"""encode(concat(
          if(doc_id % 5 = 0, '', concat('Message-ID: <', doc_id, '@', source, '.example.com>\\n')),
          'From: "Sender ', source, '" <user', doc_id, '@mail.', source, '.example.co.uk>\\n',
          'Received: from a.example.com\\n by b.example.org\\nReceived: from c.example.com\\n',
          if(doc_id % 3 = 0, concat('Reply-To: reply', doc_id, '@', if(doc_id % 2 = 0, concat('x.', source, '.example.co.uk'), 'other.example.org'), '\\n'), ''),
          'To: a', doc_id, '@example.org, "Second" <b@example.org>\\nTo: b@example.org\\nCc: c@example.org\\n',
          'Subject:   Report ', lang, '  ', doc_id, '\\n',
          if(doc_id % 7 = 0, '', concat('Authentication-Results: mx.example.org; spf=', if(doc_id % 4 = 1, 'fail', 'pass'),
             ' smtp.mailfrom=x; dkim=', if(doc_id % 6 = 1, 'fail', 'pass'), '; dmarc=', if(doc_id % 9 = 2, 'fail', 'pass'), '\\n')),
          'MIME-Version: 1.0\\n',
          CASE doc_id % 4
            WHEN 0 THEN concat('Content-Type: text/plain; charset="utf-8"\\nContent-Transfer-Encoding: 8bit\\n\\n', text)
            WHEN 1 THEN concat('Content-Type: multipart/mixed; boundary="=outer="\\n\\n--=outer=\\n',
              'Content-Type: text/plain; charset="utf-8"\\nContent-Transfer-Encoding: 8bit\\n\\n', text, '\\n--=outer=\\n',
              'Content-Type: application/pdf; name="r.pdf"\\nContent-Disposition: attachment; filename="report ', doc_id, '.pdf"\\n',
              'Content-Transfer-Encoding: base64\\n\\n', base64(encode(text, 'utf-8')), '\\n--=outer=--\\n')
            WHEN 2 THEN concat('Content-Type: text/html; charset="utf-8"\\nContent-Transfer-Encoding: 8bit\\n\\n',
              '<html><body><p>Dear reader</p><a href="https://www.', source, '.example.com/view/', doc_id, '"> View <b>report</b></a>',
              '<script>var hidden = 1;</script><p>', {HTML_TEXT}, '</p></body></html>')
            ELSE concat('Content-Type: multipart/related; boundary="=outer="\\n\\n--=outer=\\n',
              'Content-Type: multipart/alternative; boundary="=inner="\\n\\n--=inner=\\n',
              'Content-Type: text/plain; charset="utf-8"\\nContent-Transfer-Encoding: 8bit\\n\\n', text, '\\n--=inner=\\n',
              'Content-Type: text/html; charset="utf-8"\\n\\n<p>html of ', doc_id, '</p>\\n--=inner=--\\n--=outer=\\n',
              'Content-Type: image/png\\nContent-ID: <logo', doc_id, '>\\nContent-Disposition: inline; filename="logo.png"\\n',
              'Content-Transfer-Encoding: base64\\n\\niVBORw0KGgo=\\n--=outer=--\\n')
          END), 'utf-8') as content""",
    ).drop("doc_id")


# What normalisation has to give back, straight from the documents.
SQL["mail_expected"] = """
SELECT doc_id, CAST(doc_id AS VARCHAR) AS source_id, doc_id % 4 AS kind, text, lang, source,
       'user' || doc_id || '@mail.' || source || '.example.co.uk' AS from_addr,
       CASE WHEN doc_id % 3 <> 0 THEN NULL
            WHEN doc_id % 2 = 0 THEN 'reply' || doc_id || '@x.' || source || '.example.co.uk'
            ELSE 'reply' || doc_id || '@other.example.org' END AS reply_to,
       CASE WHEN doc_id % 4 = 2
            THEN 'Dear reader' || chr(10) || 'View' || chr(10) || 'report' || chr(10) || trim(text, ' ' || chr(10) || chr(9))
            ELSE text END AS body_text
FROM documents"""


# --- URLs, from pages ---------------------------------------------------------


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose around each page URL: punctuation, unbalanced and balanced parentheses."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("message_id"),
        F.expr("concat('see ', url, '). Then (', url, ', HTTP://X.example/?!; www.bare.example ', url, '_(a)). ')").alias("body_text"),
    )


def page_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per page: its HTML with absolute links added, and the prose as text."""
    pages = table(spark, sf_dir, "pages", spread=True)
    href = "replace(url, '&', '&amp;')"
    return pages.selectExpr(
        "cast(page_id as string) as source_id",
        f"""encode(concat('Message-ID: <', page_id, '@pages.example.com>\\nSubject: page\\nMIME-Version: 1.0\\n',
          'Content-Type: multipart/alternative; boundary="=b="\\n\\n--=b=\\n',
          'Content-Type: text/plain; charset="utf-8"\\nContent-Transfer-Encoding: 8bit\\n\\n',
          'see ', url, '). Then (', url, ', ', url, '_(a)). ', '\\n--=b=\\n',
          'Content-Type: text/html; charset="utf-8"\\nContent-Transfer-Encoding: 8bit\\n\\n', html,
          '<a href="', {href}, '"> Visit <b>page ', page_id, '</b> </a><a href="', {href}, '">again</a>',
          '<img src="', {href}, '"><form action=" ', {href}, ' "></form><a href="mailto:x@y.example">m</a>',
          '\\n--=b=--\\n'), 'utf-8') as content""",
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of a message: three pages each."""
    return table(spark, sf_dir, "pages").select(
        F.expr("cast(page_id div 3 as string)").alias("message_id"),
        "url",
        F.lit("plain_text").alias("source"),
        F.lit(None).cast("string").alias("anchor_text"),
        (F.col("page_id") % 3).cast("int").alias("pos"),
    )


SQL["page_links"] = "SELECT CAST(page_id // 3 AS VARCHAR) AS message_id, url FROM pages"


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page redirects to the page of a third of its id; the first two to each other."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    target = F.expr("if(page_id = 0, 1, page_id div 3)")
    dst = pages.select(F.col("page_id").alias("target"), F.col("url").alias("dst"))
    return pages.withColumn("target", target).join(dst, "target").select(F.col("url").alias("src"), "dst")


SQL["hops"] = """
SELECT a.url AS src, b.url AS dst FROM pages a
JOIN pages b ON b.page_id = CASE WHEN a.page_id = 0 THEN 1 ELSE a.page_id // 3 END"""

SQL["resolved"] = """
SELECT DISTINCT url, list_slice(walk, 2, len(walk)) AS chain FROM (
  SELECT url, arg_max(walk, len(walk)) AS walk FROM walks GROUP BY url)"""


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url")
    bad = pages.where(F.col("url").rlike("cheap-pills|adult")).select(F.lit("feed_a").alias("feed"), "url")
    ads = pages.where(F.col("url").rlike("casino|adult|ads-track|free-bets")).select(
        F.lit("feed_b").alias("feed"), "url"
    )
    return bad.unionByName(ads)


SQL["feeds"] = """
SELECT 'feed_a' AS feed, url FROM pages WHERE regexp_matches(url, 'cheap-pills|adult')
UNION ALL SELECT 'feed_b', url FROM pages WHERE regexp_matches(url, 'casino|adult|ads-track|free-bets')"""


def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public suffixes: fixed top levels, a wildcard, and exceptions taken from page hosts."""
    fixed = spark.createDataFrame(
        [("com", "normal"), ("net", "normal"), ("org", "normal"), ("uk", "normal"), ("co.uk", "normal"),
         ("example.org", "normal"), ("example.net", "wildcard")],
        "suffix string, kind string",
    )
    hosts = table(spark, sf_dir, "pages").select(exprs.url_host(F.col("url")).alias("host"))
    exceptions = hosts.select(F.regexp_extract("host", "([^.]+e[^.]*\\.example\\.net)$", 1).alias("suffix"))
    return fixed.unionByName(
        exceptions.where("suffix <> ''").distinct().withColumn("kind", F.lit("exception"))
    )


SQL["suffixes"] = """
SELECT * FROM (VALUES ('com', 'normal'), ('net', 'normal'), ('org', 'normal'), ('uk', 'normal'), ('co.uk', 'normal'),
  ('example.org', 'normal'), ('example.net', 'wildcard')) AS f(suffix, kind)
UNION ALL SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1).regexp_extract('([^.]+e[^.]*\\.example\\.net)$', 1) AS s, 'exception'
FROM pages WHERE regexp_extract(url, '^https?://([^/?#:]+)', 1).regexp_extract('([^.]+e[^.]*\\.example\\.net)$', 1) <> ''"""

# Hosts of pages, and the registrable domain by trying every rule on every host.
SQL["hosts"] = "SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages"
SQL["host_domains"] = """
SELECT host, CASE WHEN len(labels) > taken THEN array_to_string(labels[len(labels) - taken : len(labels)], '.') END AS domain
FROM (
  SELECT h.host, string_split(h.host, '.') AS labels,
         coalesce(min(CASE WHEN kind = 'exception' THEN n - 1 END),
                  max(CASE WHEN kind = 'normal' THEN n WHEN kind = 'wildcard' AND len(string_split(h.host, '.')) > n THEN n + 1 END), 1) AS taken
  FROM hosts h LEFT JOIN (SELECT suffix, kind, len(string_split(suffix, '.')) AS n FROM suffixes) s
    ON h.host = s.suffix OR ends_with(h.host, '.' || s.suffix)
  GROUP BY h.host)"""
NEEDS["host_domains"] = ("hosts", "suffixes")


# --- brands, from parts --------------------------------------------------------


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.substring_index("p_name", " ", -1)
    return table(spark, sf_dir, "part").select(
        word.alias("token"), F.concat(word, F.lit(".example.com")).alias("domain")
    ).distinct()


def brand_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders and link texts that name a brand; for odd sizes the domain is another one."""
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as message_id",
        "p_name as from_display",
        "p_name as anchor_text",
        "concat('sales@mail.', if(p_size % 2 = 0, substring_index(p_name, ' ', -1), 'shop'), '.example.com') as from_addr",
        "concat('https://www.', if(p_size % 3 = 0, substring_index(p_name, ' ', -1), 'shop'), '.example.com/', p_partkey) as url",
    )


def brand_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("com", "normal"), ("example.com", "normal")], "suffix string, kind string")


# --- addresses and networks, from events and suppliers ---------------------------


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("h"), F.col("user_id") % 500, F.lit(".example.com")).alias("host"),
        F.concat_ws(".", F.lit("10"), F.col("event_id") % 200, F.col("user_id") % 256, k_value()).alias("ip"),
    )


SQL["dns"] = """
SELECT 'h' || user_id % 500 || '.example.com' AS host,
       '10.' || event_id % 200 || '.' || user_id % 256 || '.' || regexp_extract(props, '([0-9]+)', 1) AS ip,
       10 * 16777216 + (event_id % 200) * 65536 + (user_id % 256) * 256 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS n
FROM events"""


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = 10 * 16777216 + F.col("s_nationkey") * 8 * 65536 + (F.col("s_suppkey") % 256) * 256 + F.col("s_suppkey") % 7
    return table(spark, sf_dir, "supplier").select(
        lo.cast("bigint").alias("lo"),
        (lo + F.col("s_suppkey") * 331).cast("bigint").alias("hi"),
        F.concat(F.lit("AS"), F.col("s_suppkey")).alias("owner"),
    )


SQL["networks"] = """
SELECT lo, lo + s_suppkey * 331 AS hi, 'AS' || s_suppkey AS owner FROM (
  SELECT *, 10 * 16777216 + s_nationkey * 8 * 65536 + (s_suppkey % 256) * 256 + s_suppkey % 7 AS lo FROM supplier)"""


def host_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr("cast(event_id div 4 as string)").alias("message_id"),
        F.concat(F.lit("https://h"), F.col("user_id") % 500, F.lit(".example.com/x")).alias("url"),
    )


SQL["host_links"] = """
SELECT DISTINCT CAST(event_id // 4 AS VARCHAR) AS message_id, 'h' || user_id % 500 || '.example.com' AS host FROM events"""


# --- lookups, from events --------------------------------------------------------


def lookup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are recorded lookups of a user's domain; some say that nothing is known."""
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    created = F.when(k_value() % 10 != 0, F.expr("ts - make_dt_interval(cast(regexp_extract(props, '([0-9]+)', 1) as int) div 4)"))
    return events.select(
        F.concat(F.lit("d"), F.col("user_id"), F.lit(".example.com")).alias("domain"),
        created.alias("created_at"),
        F.col("ts").alias("fetched_at"),
    )


def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'signup'").select(
        F.col("event_id").cast("string").alias("message_id"),
        F.concat(F.lit("d"), F.col("user_id"), F.lit(".example.com")).alias("from_domain"),
        F.col("ts").alias("received_at"),
    )


SQL["lookup_records"] = """
SELECT 'd' || user_id || '.example.com' AS domain,
       CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 10 <> 0
            THEN ts - to_days(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) // 4) END AS created_at,
       ts AS fetched_at
FROM events WHERE event_type = 'signup'"""
SQL["lookup_requests"] = """
SELECT CAST(event_id AS VARCHAR) AS message_id, 'd' || user_id || '.example.com' AS domain, ts AS received_at
FROM events WHERE event_type <> 'signup'"""
SQL["looked_up"] = """
SELECT q.message_id, q.domain, q.received_at,
       CASE WHEN q.received_at - r.fetched_at <= INTERVAL 7 DAY THEN r.fetched_at END AS fetched_at,
       CASE WHEN q.received_at - r.fetched_at <= INTERVAL 7 DAY THEN r.created_at END AS created_at
FROM lookup_requests q ASOF LEFT JOIN lookup_records r
  ON q.domain = r.domain AND q.received_at >= r.fetched_at"""
NEEDS["looked_up"] = ("lookup_requests", "lookup_records")
