"""Layer 2: URL signals on recorded data. Nothing is fetched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.functions import exprs
from mailrisk.operators import asof
from mailrisk.operators.domains import registrable_domain
from mailrisk.operators.headers import named_brands
from mailrisk.operators.signals import emit
from mailrisk.operators.skew import lookup_join
from mailrisk.schemas import FLAG_DEPTH, MAX_HOPS
from mailrisk.session import cut_lineage

# What a page that hides behind a challenge contains.
CAPTCHA_MARKERS = {
    "turnstile": "(?i)challenges\\.cloudflare\\.com/turnstile|cf-turnstile",
    "hcaptcha": "(?i)hcaptcha\\.com|h-captcha",
    "recaptcha": "(?i)google\\.com/recaptcha|recaptcha\\.net|g-recaptcha",
}


def _decoded_text(token: Column) -> Column:
    """Text of a base64 or base64url token, or NULL."""
    body = F.rtrim(token, F.lit("="))
    fits = token.rlike("\\A[A-Za-z0-9+/_\\-]{8,}={0,2}\\z") & (F.length(body) % 4 != 1)
    data = F.try_to_binary(F.translate(body, "-_", "+/"), F.lit("base64"))
    return F.when(fits, F.try_validate_utf8(data.cast("string")))


def hidden_addresses(url: Column) -> Column:
    """E-mail addresses that a URL carries base64-encoded in its query or fragment."""
    tail = F.regexp_extract(url, "(?s)^[^?#]*[?#](.*)$", 1)
    params = F.split(tail, "[?&#;]")
    values = F.transform(params, lambda p: F.regexp_replace(p, "^[^=]*=(.+)$", "$1"))
    tokens = F.transform(
        F.concat(params, values), lambda t: F.regexp_replace(t, "(?i)%3d", "=")
    )
    decoded = F.transform(F.array_distinct(tokens), _decoded_text)
    return F.array_distinct(F.filter(decoded, exprs.is_address))


def base64_email_signals(observations: DataFrame, key: str = "message_id") -> DataFrame:
    """base64_email_param: a URL carries an encoded e-mail address.

    Other encoded values, such as tracking ids, are decoded too and stay silent. One
    signal per message, naming the first address in order.
    """
    found = observations.withColumn("address", F.explode(hidden_addresses(F.col("url"))))
    per_message = found.groupBy(key).agg(
        F.min("address").alias("address"), F.count_distinct("url").alias("urls")
    )
    return emit(
        per_message,
        "base64_email_param",
        F.format_string("%d URL(s) carry an encoded address, first %s", "urls", "address"),
        key=key,
        address=F.col("address"),
        urls=F.col("urls"),
    )


def redirect_paths(hops: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """paths(src, path): up to max_hops targets from each recorded source, loops included.

    A source with several recorded targets follows the smallest. Paths double in
    length with each join, so eight hops take three joins, not eight.
    """
    paths = hops.groupBy("src").agg(F.array(F.min("dst")).alias("path"))
    length = 1
    while length < max_hops:
        further = paths.select(F.col("src").alias("last"), F.col("path").alias("further"))
        ends = paths.withColumn("last", F.element_at("path", -1))
        paths = lookup_join(ends, further, "last").select(
            "src", F.concat("path", F.coalesce("further", F.array().cast("array<string>"))).alias("path")
        )
        length *= 2
        if length < max_hops:
            paths = cut_lineage(paths)  # the next join reads it several times
    return paths.withColumn("path", F.slice("path", 1, max_hops))


def _until_repeat(url: Column, path: Column) -> Column:
    """The path up to the first target that was visited before."""
    visited = F.concat(F.array(url), path)
    back = F.array_position(
        F.transform(visited, lambda u, i: F.array_position(visited, u) < i + 1), F.lit(True)
    )
    return F.when(back == 0, path).otherwise(F.slice(path, 1, F.greatest(back - 2, F.lit(0)).cast("int")))


def resolve_redirects(
    observations: DataFrame, hops: DataFrame, max_hops: int = MAX_HOPS
) -> DataFrame:
    """Add redirect_chain, final_url and redirect_depth from recorded hops(src, dst).

    A chain ends where no hop is recorded, after max_hops, or before a target that
    it has already visited.
    """
    paths = redirect_paths(hops, max_hops).select(
        F.col("src").alias("url"), _until_repeat(F.col("src"), F.col("path")).alias("redirect_chain")
    )
    chained = lookup_join(observations, paths, "url")
    chain = F.coalesce("redirect_chain", F.array().cast("array<string>"))
    return chained.withColumn("redirect_chain", chain).select(
        "*",
        F.coalesce(F.get(F.reverse("redirect_chain"), F.lit(0)), "url").alias("final_url"),
        F.size("redirect_chain").alias("redirect_depth"),
    )


def resolve_redirects_as_of(
    observations: DataFrame, hops: DataFrame, at: str = "received_at", max_hops: int = MAX_HOPS
) -> DataFrame:
    """The same from hops(src, dst, seen_at) as they were when the message came.

    Each step takes the newest hop of a URL that was recorded at or before the time in column `at`; of several
    recorded at that time the smallest target. A message without a time follows the newest hops of all.
    Hops without source, target or time are left out. Every different URL and time is followed once;
    a step is an as-of merge (`asof`), so a URL in a third of the mail is not one task, and chains that have
    ended take no part in the next.
    """
    known = hops.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("seen_at").isNotNull())
    one = known.groupBy("src", F.col("seen_at").cast("timestamp").alias("_time")).agg(F.min("dst").alias("dst"))
    records = cut_lineage(one.select(F.col("src").alias("_key"), "_time", F.struct(F.col("_time").alias("_at"), "dst").alias("_record")))
    latest = F.lit("9999-12-31").cast("timestamp")
    moment = F.coalesce(F.col(at).cast("timestamp"), latest)
    starts = observations.where(F.col("url").isNotNull()).select("url", moment.alias("_moment")).distinct()
    going = starts.select("url", "_moment", F.array().cast("array<string>").alias("path"))
    ended = []
    for _ in range(max_hops):
        last = F.coalesce(F.get(F.reverse("path"), F.lit(0)), "url")
        asked = going.select(last.alias("_key"), F.col("_moment").alias("_time"), F.struct("url", "_moment", "path").alias("_event"))
        target = F.col("_record.dst")
        stepped = asof.merge(asked, records).select("_event.*", target.alias("_next"))
        stays = F.col("_next").isNull() | (F.col("_next") == F.col("url")) | F.array_contains("path", F.col("_next"))
        stepped = cut_lineage(stepped.withColumn("_ended", stays))
        ended.append(stepped.where("_ended").select("url", "_moment", "path"))
        going = stepped.where("NOT _ended").select("url", "_moment", F.array_append("path", F.col("_next")).alias("path"))
        if going.isEmpty():
            break
    paths = reduce(DataFrame.unionByName, [*ended, going]).withColumnRenamed("path", "redirect_chain")
    # A URL and a time make a key of their own; many messages of one time and URL are looked up, not joined by it.
    name = lambda url, time: F.concat_ws(" ", F.unix_micros(time).cast("string"), url)
    keyed = paths.select(name(F.col("url"), F.col("_moment")).alias("_place"), "redirect_chain")
    chained = lookup_join(observations.withColumn("_place", name(F.col("url"), moment)), keyed, "_place").drop("_place")
    chain = F.coalesce("redirect_chain", F.array().cast("array<string>"))
    return chained.withColumn("redirect_chain", chain).select(
        "*",
        F.coalesce(F.get(F.reverse("redirect_chain"), F.lit(0)), "url").alias("final_url"),
        F.size("redirect_chain").alias("redirect_depth"),
    )


def redirect_signals(
    resolved: DataFrame, flag_depth: int = FLAG_DEPTH, key: str = "message_id"
) -> DataFrame:
    """redirect_depth: a URL redirects more than flag_depth times. The deepest is named."""
    deep = resolved.where(F.col("redirect_depth") > flag_depth)
    worst = deep.groupBy(key).agg(
        F.max("redirect_depth").alias("depth"),
        F.min(F.struct(-F.col("redirect_depth"), "url", "final_url")).alias("worst"),
    ).select(key, "depth", "worst.url", "worst.final_url")
    return emit(
        worst,
        "redirect_depth",
        F.format_string("%s redirects %d times to %s", "url", "depth", "final_url"),
        F.least(F.lit(1.0), F.col("depth") / 8),
        key=key,
        depth=F.col("depth"),
        final_url=F.col("final_url"),
    )


def captcha_kinds(markup: Column) -> Column:
    """Names of the challenge widgets that a page contains."""
    kinds = [F.when(markup.rlike(p), F.lit(name)) for name, p in CAPTCHA_MARKERS.items()]
    return F.array_compact(F.array(*kinds))


def captcha_signals(
    resolved: DataFrame, pages: DataFrame, key: str = "message_id"
) -> DataFrame:
    """captcha_gate: the captured landing page of a URL is gated.

    pages(url, html) are reduced to gated URLs before anything is joined, so page
    text is never shuffled.
    """
    gated = (
        pages.select("url", F.explode(captcha_kinds(F.col("html"))).alias("kind"))
        .groupBy("url")
        .agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
        .withColumnRenamed("url", "final_url")
    )
    hits = lookup_join(resolved.select(key, "final_url"), gated, "final_url").where("kinds IS NOT NULL")
    per_message = hits.groupBy(key).agg(
        F.min(F.struct("final_url", "kinds")).alias("first"),
        F.count_distinct("final_url").alias("pages"),
    )
    return emit(
        per_message.select(key, "first.*", "pages"),
        "captcha_gate",
        F.format_string("landing page %s is gated by %s", "final_url", "kinds"),
        key=key,
        final_url=F.col("final_url"),
        kinds=F.col("kinds"),
        pages=F.col("pages"),
    )


def anchor_brand_signals(
    observations: DataFrame, brands: DataFrame, suffixes: DataFrame, key: str = "message_id"
) -> DataFrame:
    """domain_mismatch_brand: link text names a brand and the link leads elsewhere."""
    shown = observations.where(F.col("anchor_text").isNotNull()).select(key, "url", "anchor_text")
    named = named_brands(shown, "anchor_text", brands).withColumn(
        "_host", exprs.url_host(F.col("url"))
    )
    placed = registrable_domain(named, "_host", suffixes, "domain")
    posing = placed.where(~F.coalesce(F.array_contains("domains", F.col("domain")), F.lit(False)))
    per_message = posing.groupBy(key).agg(
        F.min(F.struct("token", "url")).alias("first"), F.count_distinct("url").alias("urls")
    )
    return emit(
        per_message.select(key, "first.*", "urls"),
        "domain_mismatch_brand",
        F.format_string("link text names %s, link leads to %s", "token", "url"),
        key=key,
        brand=F.col("token"),
        url=F.col("url"),
        urls=F.col("urls"),
    )


def qr_signals(observations: DataFrame, key: str = "message_id") -> DataFrame:
    """qr_url: the message shows a URL inside an image."""
    found = observations.where(F.col("source") == "qr_code").groupBy(key).agg(
        F.count("*").alias("urls"), F.min("url").alias("first_url")
    )
    return emit(
        found,
        "qr_url",
        F.format_string("%d URL(s) in images, first %s", "urls", "first_url"),
        key=key,
        urls=F.col("urls"),
        first_url=F.col("first_url"),
    )
