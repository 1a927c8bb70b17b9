"""Message normalisation: raw bytes to one `messages` row, and its child tables.

Bytes are decoded once per message by one Arrow function into a nested record.
Everything after that is a column expression on the same row, so a message never
has to be shuffled to be put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.functions.html import html_scan
from mailrisk.functions.mime import mail_record
from mailrisk.session import bound_batches

EMPTY_TYPE = "application/octet-stream"


def decode_messages(raw: DataFrame, limit_s: float | None = None) -> DataFrame:
    """raw_messages(source_id, content) with the decoded record in `mail`; a message may take limit_s seconds."""
    bound_batches(raw.sparkSession)
    return raw.withColumn("mail", mail_record("content", limit_s))


def readable(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("mail.error").isNull())


def parse_rejects(decoded: DataFrame) -> DataFrame:
    """Messages that could not be decoded at all: rejects(source_id, stage, reason)."""
    return decoded.where(F.col("mail.error").isNotNull()).select(
        "source_id", F.lit("parse").alias("stage"), F.col("mail.error").alias("reason")
    )


def _first_header(name: str) -> Column:
    return F.get(F.try_element_at(F.col("mail.headers"), F.lit(name)), F.lit(0))["value"]


def message_id() -> Column:
    """Message-ID header, or a hash of the bytes when it is missing or empty."""
    return F.coalesce(
        F.nullif(_first_header("message-id"), F.lit("")),
        F.concat(F.lit("sha256:"), F.sha2(F.col("content"), 256)),
    )


def with_message_id(decoded: DataFrame) -> DataFrame:
    return decoded.withColumn("message_id", message_id())


def header_rows(decoded: DataFrame) -> DataFrame:
    """headers(source_id, pos, name, value): one row per header line."""
    return (
        readable(decoded)
        .select("source_id", F.explode("mail.headers").alias("name", "found"))
        .select("source_id", "name", F.inline("found"))
        .select("source_id", "pos", "name", "value")
    )


def headers_map() -> Column:
    """All values of each header, in the order they appeared."""
    return F.transform_values(F.col("mail.headers"), lambda _, found: found["value"])


def received_chain() -> Column:
    return F.coalesce(
        F.try_element_at(F.col("mail.headers"), F.lit("received"))["value"],
        F.array().cast("array<string>"),
    )


# Zone names of mail dates, as offsets. A name that is not here says nothing.
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
MAIL_DATE = "([0-9]{1,2})\\s+([A-Za-z]{3})[a-z]*\\s+([0-9]{4})\\s+([0-9]{1,2}:[0-9]{2})(:[0-9]{2})?\\s*([+-][0-9]{4}|[A-Z]{1,4})?"


def mail_date(text: Column) -> Column:
    """The moment a mail date names, or NULL. Without a known zone it is taken as UTC."""
    part = lambda n: F.regexp_extract(text, MAIL_DATE, n)
    names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    zone = F.when(part(6).rlike("^[+-]"), part(6)).otherwise(F.coalesce(F.try_element_at(names, part(6)), F.lit("+0000")))
    seconds = F.when(part(5) == "", ":00").otherwise(part(5))
    written = F.concat(part(1), F.lit(" "), F.initcap(part(2)), F.lit(" "), part(3), F.lit(" "), part(4), seconds, F.lit(" "), zone)
    return F.try_to_timestamp(written, F.lit("d MMM yyyy H:mm:ss xx"))


def received_at() -> Column:
    """When the mail arrived: the date of the topmost Received header, else the Date header, else NULL.

    The topmost is the one of the receiving server; Date is what the sender wrote.
    """
    top = F.get(received_chain(), F.lit(0))
    stamp = F.when(F.instr(top, ";") > 0, F.substring_index(top, ";", -1))
    return F.coalesce(mail_date(stamp), mail_date(_first_header("date")))


def recipients() -> Column:
    """To addresses over repeated headers, in order, first occurrence kept."""
    return F.array_distinct(F.filter(F.col("mail.to_addrs"), lambda a: a != ""))


def is_attachment(part: Column) -> Column:
    return (part["disposition"] == "attachment") | (part["filename"] != "") | (part["content_id"] != "")


def _first_body(content_type: str) -> Column:
    """Text of the first part of this type that is not an attachment, in tree order."""
    fits = F.filter(
        F.col("mail.parts"), lambda p: (p["content_type"] == content_type) & ~is_attachment(p)
    )
    return F.get(fits, F.lit(0))["text"]


def attachment_array() -> Column:
    return F.transform(
        F.filter(F.col("mail.parts"), is_attachment),
        lambda p: F.struct(
            p["part_no"].alias("part_no"),
            p["filename"].alias("filename"),
            F.coalesce(F.nullif(p["content_type"], F.lit("")), F.lit(EMPTY_TYPE)).alias("content_type"),
            p["size_bytes"].alias("size_bytes"),
            F.nullif(p["content_id"], F.lit("")).alias("content_id"),
        ),
    )


def part_rows(decoded: DataFrame) -> DataFrame:
    """parts(source_id, part_no, ...): one row per leaf of the MIME tree."""
    return readable(decoded).select("source_id", F.inline("mail.parts"))


def attachment_rows(decoded: DataFrame) -> DataFrame:
    """Metadata of attachments and of images referenced by Content-ID; no payload."""
    return (
        readable(decoded)
        .select("source_id", F.inline(attachment_array()))
        .withColumn("is_inline", F.col("content_id").isNotNull())
    )


def inline_images(attachments: DataFrame) -> DataFrame:
    return attachments.where(F.col("content_id").isNotNull())


def choose_bodies(decoded: DataFrame, limit_s: float | None = None) -> DataFrame:
    """Add body_html, body_text and the links found in the HTML.

    Text is the first plain part; else the text of the HTML; else the flat body
    of a message that declares parts it does not have; else empty. The HTML is
    read once for both its text and its links.
    """
    scanned = (
        decoded.withColumn("plain", _first_body("text/plain"))
        .withColumn("body_html", _first_body("text/html"))
        .withColumn("scan", html_scan("body_html", limit_s))
    )
    return scanned.withColumn(
        "body_text", F.coalesce("plain", "scan.text", "mail.flat_text", F.lit(""))
    ).withColumn("links", F.coalesce("scan.links", F.from_json(F.lit("[]"), _links_type()))).withColumn(
        "html_error", F.col("scan.error")
    )


def _links_type() -> str:
    return "array<struct<pos:int,source:string,href:string,anchor_text:string>>"


def assemble_messages(
    decoded: DataFrame, keep_raw: bool = False, limit_s: float | None = None, durations: bool = False
) -> DataFrame:
    """The `messages` table from decoded rows; with durations also decode_ms and html_ms of each message.

    Columns that came along with the raw messages are kept, and a received_at among them
    counts in place of the headers. A row that could not be
    decoded has its reason in `error` and nothing else.
    """
    raw = [F.col("content").alias("raw")] if keep_raw else []
    took = [F.col("mail.elapsed_ms").alias("decode_ms"), F.coalesce("scan.elapsed_ms", F.lit(0).cast("bigint")).alias("html_ms")]
    along = [c for c in decoded.columns if c not in ("source_id", "content", "mail")]
    arrived = [] if "received_at" in along else [received_at().alias("received_at")]
    return choose_bodies(decoded, limit_s).select(
        "source_id",
        message_id().alias("message_id"),
        F.col("mail.from_addr").alias("from_addr"),
        F.col("mail.from_display").alias("from_display"),
        recipients().alias("to_addrs"),
        F.coalesce(_first_header("subject"), F.lit("")).alias("subject"),
        "body_text",
        "body_html",
        "html_error",
        *arrived,
        F.col("mail.reply_to").alias("reply_to"),
        "links",
        headers_map().alias("headers"),
        received_chain().alias("received_chain"),
        attachment_array().alias("attachments"),
        F.col("mail.error").alias("error"),
        *along,
        *raw,
        *(took if durations else []),
    )


def normalize_messages(raw: DataFrame, keep_raw: bool = False) -> DataFrame:
    """raw_messages to `messages`; undecodable rows are left to parse_rejects."""
    return assemble_messages(readable(decode_messages(raw)), keep_raw).drop("error")
