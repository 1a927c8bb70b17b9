"""URL observations: what URLs a message shows, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.functions import exprs
from mailrisk.functions.html import html_scan
from mailrisk.operators.signals import emit
from mailrisk.session import bound_batches


def html_links(df: DataFrame, html_col: str) -> DataFrame:
    """One row per a[href], img[src] and form[action], in document order."""
    bound_batches(df.sparkSession)
    others = [c for c in df.columns if c != html_col]
    return df.withColumn("scan", html_scan(html_col)).select(*others, F.inline("scan.links"))


def text_urls(df: DataFrame, text_col: str) -> DataFrame:
    """One row per http(s) URL written in a text, in order."""
    others = [c for c in df.columns if c != text_col]
    return df.select(
        *others, F.posexplode(exprs.text_url_array(F.col(text_col))).alias("pos", "url")
    )


def classify_href(href: Column) -> Column:
    """What a link target is: http, or the reason it is left out."""
    url = F.lower(exprs.strip(href))
    return (
        F.when(url == "", "empty")
        .when(url.rlike("^https?://"), "http")
        .when(url.startswith("mailto:"), "mailto")
        .when(url.startswith("tel:"), "tel")
        .when(url.startswith("cid:"), "cid")
        .when(url.startswith("data:"), "data")
        .when(url.startswith("javascript:"), "javascript")
        .when(url.startswith("#"), "fragment")
        .when(url.rlike("^[a-z][a-z0-9+.\\-]*:"), "other_scheme")
        .otherwise("relative")
    )


def keep_http(links: DataFrame) -> DataFrame:
    """Absolute http(s) targets only, stripped, in column `url`."""
    return links.withColumn("url", exprs.strip(F.col("href"))).where(F.col("url").rlike(exprs.HTTP))


def url_observations(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """url_observations(key, pos, url, source, anchor_text).

    HTML links come first and text URLs after them; the first occurrence of each
    (url, source) is kept, with its anchor text. A message holds all of its own
    URLs, so this is sorted and compared within the row: no shuffle, whatever the
    number of copies of a message.
    """
    stripped = F.transform(
        "links",
        lambda l: F.struct(
            exprs.strip(l["href"]).alias("url"),
            l["source"].alias("source"),
            l["pos"].alias("pos"),
            l["anchor_text"].alias("anchor_text"),
        ),
    )
    from_html = F.filter(stripped, lambda l: l["url"].rlike(exprs.HTTP))
    from_text = F.transform(
        exprs.text_url_array(F.col("body_text")),
        lambda u, i: F.struct(
            u.alias("url"),
            F.lit("plain_text").alias("source"),
            (F.size("links") + i).alias("pos"),
            F.lit(None).cast("string").alias("anchor_text"),
        ),
    )
    ordered = messages.select(key, F.array_sort(F.concat(from_html, from_text)).alias("found"))
    first = F.filter(
        "found",
        lambda o, i: (i == 0)
        | (o["url"] != F.get("found", i - 1)["url"])
        | (o["source"] != F.get("found", i - 1)["source"]),
    )
    return ordered.select(key, F.inline(first)).select(key, "pos", "url", "source", "anchor_text")


def with_qr_observations(
    observations: DataFrame, qr_decodes: DataFrame, key: str = "message_id"
) -> DataFrame:
    """Add URLs read from images: qr_decodes(key, url). They are kept once per message.

    A QR URL is a source of its own, so it never collides with a row that is
    already there and only the new rows are grouped.
    """
    absolute = qr_decodes.select(key, exprs.strip(F.col("url")).alias("url")).where(
        F.col("url").rlike(exprs.HTTP)
    )
    fresh = absolute.groupBy(key, "url").agg(F.lit(None).cast("int").alias("pos")).select(
        key,
        "pos",
        "url",
        F.lit("qr_code").alias("source"),
        F.lit(None).cast("string").alias("anchor_text"),
    )
    return observations.unionByName(fresh)


def unread_signals(messages: DataFrame, name: str, key: str = "message_id") -> DataFrame:
    """links_unread, text_unread or intel_unread: abstains for mail whose markup was refused before its end.

    Signals found in what was read still count; without one the layer has no score.
    """
    refused = messages.where(F.col("html_error").isNotNull())
    return emit(refused, name, F.lit(""), error=F.concat(F.lit("markup could not be read: "), "html_error"), key=key)
