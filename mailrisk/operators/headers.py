"""Layer 1: header and domain signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.functions import exprs
from mailrisk.operators.domains import registrable_domain
from mailrisk.operators.lookups import ttl_lookup
from mailrisk.operators.signals import emit
from mailrisk.operators.skew import lookup_join
from mailrisk.schemas import DOMAIN_TTL_S

MECHANISMS = ("spf", "dkim", "dmarc")
FAILED = ("fail", "softfail", "permerror")
MAX_BRANDS = 100_000


def _verdict(header: Column, mechanism: str) -> Column:
    """The mechanism's verdict; of several (a mail may carry several signatures) `pass` counts, else the first."""
    found = F.transform(
        F.regexp_extract_all(header, F.lit(f"(?i)(?:^|[\\s;]){mechanism}\\s*=\\s*([a-z]+)"), F.lit(1)), F.lower)
    return F.when(F.array_contains(found, "pass"), "pass").otherwise(F.get(found, F.lit(0)))


def auth_results(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """auth_results(key, header, spf, dkim, dmarc) from the topmost results header.

    The receiving server puts its header on top; ones below may have been sent along.
    """
    header = F.get(F.try_element_at("headers", F.lit("authentication-results")), F.lit(0))
    return messages.select(key, header.alias("header")).select(
        key, "header", *[_verdict(F.col("header"), m).alias(m) for m in MECHANISMS]
    )


def auth_signals(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """auth_fail: recorded spf, dkim or dmarc failures. Nothing is verified again.

    The score grows with the failures; a dmarc failure alone is conclusive. A message without
    any verdict abstains.
    """
    failed = [F.when(F.col(m).isin(*FAILED), F.lit(m)) for m in MECHANISMS]
    judged = auth_results(messages, key).withColumn("failed", F.array_compact(F.array(*failed)))
    unknown = F.coalesce(*MECHANISMS).isNull()
    score = F.when(F.array_contains("failed", "dmarc"), 1.0).when(F.size("failed") == 2, 0.8).otherwise(0.5)
    return emit(
        judged.where(unknown | (F.size("failed") > 0)),
        "auth_fail",
        F.concat(F.lit("failed: "), F.array_join("failed", ", ")),
        score,
        F.when(unknown, F.lit("no authentication results")),
        key,
        spf=F.col("spf"),
        dkim=F.col("dkim"),
        dmarc=F.col("dmarc"),
    )


def sender_domains(messages: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Messages with from_domain, the registrable domain of the sender address."""
    hosts = messages.withColumn("_host", exprs.address_domain(F.col("from_addr")))
    return registrable_domain(hosts, "_host", suffixes, "from_domain").drop("_host")


def replyto_signals(messages: DataFrame, suffixes: DataFrame, key: str = "message_id") -> DataFrame:
    """replyto_mismatch: Reply-To and From have different registrable domains."""
    asked = messages.where(F.col("reply_to").isNotNull() & (F.col("from_addr") != ""))
    hosts = sender_domains(asked.select(key, "from_addr", "reply_to"), suffixes).withColumn(
        "_host", exprs.address_domain(F.col("reply_to"))
    )
    both = registrable_domain(hosts, "_host", suffixes, "reply_domain")
    return emit(
        both.where(F.col("from_domain") != F.col("reply_domain")),
        "replyto_mismatch",
        F.format_string("replies go to %s, sender is %s", "reply_domain", "from_domain"),
        key=key,
        from_domain=F.col("from_domain"),
        reply_domain=F.col("reply_domain"),
    )


def domain_age_signals(
    messages: DataFrame,
    registrations: DataFrame,
    key: str = "message_id",
    domain: str = "from_domain",
    received_at: str = "received_at",
    max_age_days: int = 7,
    ttl_s: int = DOMAIN_TTL_S,
) -> DataFrame:
    """domain_age_lt_7d: the sender domain was registered less than a week before receipt.

    registrations(domain, created_at, fetched_at). No valid record, or a record of a
    failed lookup (NULL created_at), abstains.
    """
    asked = messages.select(key, F.col(domain).alias("domain"), received_at)
    aged = ttl_lookup(asked, registrations, "domain", received_at, "fetched_at", ttl_s)
    days = F.timestamp_diff("DAY", F.col("created_at").cast("timestamp"), F.col(received_at).cast("timestamp"))
    aged = aged.withColumn("age_days", days)
    reason = (
        F.when(F.col("domain").isNull(), F.lit("no sender domain"))
        .when(F.col(received_at).isNull(), F.lit("no time of receipt"))
        .when(F.col("fetched_at").isNull(), F.lit("no registration record"))
        .when(F.col("created_at").isNull(), F.lit("registration unknown"))
    )
    return emit(
        aged.where(reason.isNotNull() | (F.col("age_days") < max_age_days)),
        "domain_age_lt_7d",
        F.format_string("%s was registered %d days before receipt", "domain", "age_days"),
        error=reason,
        key=key,
        domain=F.col("domain"),
        age_days=F.col("age_days"),
    )


def brand_words(text: Column) -> Column:
    """The words of a name; invisible characters inside them do not part them."""
    return exprs.word_tokens(F.regexp_replace(text, exprs.ZERO_WIDTH, ""))


def brand_domains(brands: DataFrame) -> DataFrame:
    """brands(token, domain) to one row per name, its words joined by a space, with all of its domains."""
    return brands.groupBy(F.array_join(brand_words(F.col("token")), " ").alias("token")).agg(
        F.collect_set(F.lower("domain")).alias("domains")
    ).where("token <> ''")


def named_brands(
    df: DataFrame, text_col: str, brands: DataFrame, max_broadcast: int = MAX_BRANDS
) -> DataFrame:
    """Rows of df once per brand their text names, with the brand's domains.

    A brand of several words, however many, is named by these words in a row. The brand list is broadcast after its
    size is checked. A longer list is joined by name, with the frequent ones of these texts set apart.
    """
    known = brand_domains(brands)
    # As many rows as names differ in length, whatever the number of brands.
    lengths = sorted(r[0] for r in known.select(F.size(F.split("token", " "))).distinct().collect())
    words = brand_words(F.col(text_col))
    none = F.array().cast("array<string>")

    def runs_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

    named = F.concat(none, *[runs_of(n) for n in lengths])
    spelled = df.select(*df.columns, F.explode(F.array_distinct(named)).alias("token"))
    return lookup_join(spelled, known, "token", max_broadcast).where("domains IS NOT NULL")


def impersonation_signals(
    messages: DataFrame, brands: DataFrame, suffixes: DataFrame, key: str = "message_id"
) -> DataFrame:
    """display_name_impersonation: the display name names a brand the sender is not."""
    shown = messages.where(F.col("from_display") != "").select(key, "from_display", "from_addr")
    named = sender_domains(named_brands(shown, "from_display", brands), suffixes)
    own = F.array_contains("domains", F.col("from_domain"))
    posing = named.where(~F.coalesce(own, F.lit(False)))
    per_message = posing.groupBy(key, "from_display", "from_domain").agg(
        F.array_join(F.array_sort(F.collect_set("token")), ", ").alias("brands")
    )
    return emit(
        per_message,
        "display_name_impersonation",
        F.concat(
            F.lit("display name names "), "brands", F.lit(" but sender domain is "),
            F.coalesce("from_domain", F.lit("missing")),
        ),
        key=key,
        brands=F.col("brands"),
        from_domain=F.col("from_domain"),
    )
