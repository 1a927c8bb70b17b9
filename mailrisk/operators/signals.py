"""The one signal shape that every detector emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.functions.exprs import json_text

# Default strength of each signal: (layer, score). A detector that measures a
# strength of its own scales it instead.
STRENGTH = {
    "auth_fail": (1, 0.8),
    "replyto_mismatch": (1, 0.7),
    "domain_age_lt_7d": (1, 0.6),
    "display_name_impersonation": (1, 0.7),
    "base64_email_param": (2, 0.9),
    "redirect_depth": (2, 0.6),
    "captcha_gate": (2, 0.7),
    "qr_url": (2, 0.6),
    "domain_mismatch_brand": (2, 0.8),
    "zero_width": (3, 0.7),
    "urgency": (3, 0.5),
    "perplexity": (3, 0.5),
    "burstiness": (3, 0.5),
    "fusion": (3, 0.5),
    # These only ever abstain: markup that could not be read to its end.
    "links_unread": (2, 0.0),
    "text_unread": (3, 0.0),
    "intel_unread": (4, 0.0),
    "url_ioc": (4, 1.0),
    "domain_ioc": (4, 0.8),
    "hosting_flag": (4, 0.6),
}


def severity_of(score: Column) -> Column:
    return F.when(score >= 0.65, "high").when(score >= 0.35, "medium").otherwise("low")


def emit(
    df: DataFrame,
    name: str,
    evidence: Column,
    score: Column | None = None,
    error: Column | None = None,
    key: str = "message_id",
    **metadata: Column,
) -> DataFrame:
    """Rows of `df` as signals. A row with an error abstains: it carries no finding."""
    layer, strength = STRENGTH[name]
    error = F.lit(None).cast("string") if error is None else error
    level = F.lit(strength) if score is None else score
    level = F.when(error.isNull(), level.cast("double")).otherwise(F.lit(0.0))
    facts = json_text(**metadata) if metadata else F.create_map().cast("map<string,string>")
    return df.select(
        F.col(key),
        F.lit(layer).alias("layer"),
        F.lit(name).alias("name"),
        level.alias("score"),
        severity_of(level).alias("severity"),
        F.when(error.isNull(), evidence).otherwise(F.concat(F.lit("not computed: "), error)).alias("evidence"),
        facts.alias("metadata"),
        error.alias("error"),
    )
