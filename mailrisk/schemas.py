"""Table schemas, allowed values and default configuration.

Everything here is a fixed value: the numbers and names that a result must agree
on. Detector scores are defaults of this package and can be passed in instead.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Allowed values.
LAYERS = (1, 2, 3, 4)
LEVELS = ("low", "medium", "high")
URL_SOURCES = ("anchor_href", "img_src", "form_action", "plain_text", "header", "qr_code")

# Phase-one scoring configuration.
DEFAULT_WEIGHTS = {1: 0.30, 2: 0.30, 3: 0.20, 4: 0.20}
DEFAULT_THRESHOLDS = {"deliver": 0.35, "block": 0.65}
DEFAULT_POLICY = {"low": "deliver", "medium": "warn", "high": "block"}

# Time budgets in seconds: one per layer, and one for the whole message.
LAYER_BUDGET_S = {1: 8.0, 2: 15.0, 3: 10.0, 4: 6.0}
TOTAL_BUDGET_S = 20.0

# Lookup freshness in seconds.
DOMAIN_TTL_S = 7 * 24 * 3600
INTEL_TTL_S = 6 * 3600

# Redirects: hops followed, and the depth above which a chain is flagged.
MAX_HOPS = 8
FLAG_DEPTH = 2

# Body length below which perplexity abstains, in tokens.
MIN_TOKENS = 40

# Weighted scores are rounded here before they are banded, so two engines that
# add doubles in a different order agree on the band.
SCORE_DIGITS = 9

HEADER_VALUES = T.ArrayType(
    T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())])
)

PART = T.StructType([
    T.StructField("part_no", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("disposition", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("content_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
])

MAIL = T.StructType([
    T.StructField("headers", T.MapType(T.StringType(), HEADER_VALUES)),
    T.StructField("from_display", T.StringType()),
    T.StructField("from_addr", T.StringType()),
    T.StructField("reply_to", T.StringType()),
    T.StructField("to_addrs", T.ArrayType(T.StringType())),
    T.StructField("parts", T.ArrayType(PART)),
    T.StructField("flat_text", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed_ms", T.LongType()),
])

LINK = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("anchor_text", T.StringType()),
])

HTML_SCAN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed_ms", T.LongType()),
])

RAW_MESSAGES = "source_id string, content binary"
REJECTS = "source_id string, stage string, reason string"
SIGNALS = (
    "message_id string, layer int, name string, score double, severity string, "
    "evidence string, metadata map<string,string>, error string"
)
LAYER_RESULTS = (
    "message_id string, layer int, completed boolean, error string, duration_ms bigint"
)
ASSESSMENTS = (
    "message_id string, score double, level string, summary string, "
    "layers_completed array<int>, scored_at timestamp"
)
WEIGHTS = "profile string, layer int, weight double"
THRESHOLDS = "profile string, deliver double, block double"
