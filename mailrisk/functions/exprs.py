"""Column expressions shared by the operators. All of them stay in the JVM.

Mail is hostile, so patterns take time linear in the text: no repeated groups, and
no run of characters is looked at again from each of its positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a URL in prose is made of, and the punctuation that trails it.
TEXT_URL = "(?iU)https?://[^\\s\\x1c-\\x1f<>\"'`\\[\\]{}\\\\^|]+"
TRAILING = ".,;:!?\"'>*_~"

# Absolute http(s) URLs, white space, e-mail addresses, zero-width characters.
HTTP = "(?i)^https?://"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
EMAIL = "\\A[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-][A-Za-z0-9.\\-]*\\.[A-Za-z]{2,}\\z"
ZERO_WIDTH = "[\\u200b\\u200c\\u200d\\u2060\\ufeff]"
TOKEN = "[\\p{L}\\p{M}\\p{N}]+"


def strip(col: Column) -> Column:
    """Without white space at both ends, in any script's sense of white space."""
    return F.btrim(col, F.lit(SPACES))


def blank(col: Column) -> Column:
    """True for NULL, empty and white space only."""
    return col.isNull() | ~col.rlike(f"(?U)[^\\s\\x1c-\\x1f]")


def is_address(col: Column) -> Column:
    """True for text that is one e-mail address and nothing else."""
    return col.rlike(EMAIL) & ~col.contains("..")


def count_char(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def trim_url(url: Column) -> Column:
    """Drop sentence punctuation and unbalanced closing parentheses from the end.

    `head` is the URL up to its last other character and `tail` the run after
    it. Each surplus ")" takes the punctuation beside it along, so the tail is cut
    before the first ")" that has to go; all of it in one pass over the string.
    """
    bare = F.rtrim(url, F.lit(TRAILING))
    head = F.rtrim(url, F.lit(TRAILING + ")"))
    tail = F.substring(bare, F.length(head) + 1, F.length(bare))
    surplus = F.greatest(count_char(bare, ")") - count_char(bare, "("), F.lit(0))
    keep = F.greatest(count_char(tail, ")") - surplus, F.lit(0))
    cut = F.rtrim(F.call_function("substring_index", tail, F.lit(")"), keep + 1), F.lit(TRAILING))
    return F.when(surplus == 0, bare).otherwise(F.concat(head, cut))


def text_url_array(text: Column) -> Column:
    """http(s) URLs of a text in order, trimmed; repeats are kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(TEXT_URL), F.lit(0)), trim_url)


def url_host(url: Column) -> Column:
    """Lower-cased host of an absolute URL, without credentials, port or closing dot."""
    host = F.regexp_extract(
        F.lower(url), "^https?://(?:[^/?#\\\\]*@)?(\\[[^\\]]*\\]|[^/?#:\\\\]*)", 1
    )
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def address_domain(address: Column) -> Column:
    """Lower-cased part after the last @, or NULL."""
    return F.nullif(F.lower(F.substring_index(F.nullif(address, F.lit("")), "@", -1)), F.lit(""))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def json_text(**fields: Column) -> Column:
    """Signal metadata: a map of text values, skipping NULLs."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
