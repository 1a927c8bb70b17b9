"""From raw mail to assessments: normalise once, run four layers, score what completed."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.operators import body, headers, intel, links, lookups, observations, results, scoring
from mailrisk.operators.logistic import TermModel
from mailrisk.operators.messages import assemble_messages, decode_messages
from mailrisk.schemas import LAYERS, MIN_TOKENS, SIGNALS, TOTAL_BUDGET_S
from mailrisk.session import cut_lineage


class LayerUnavailable(RuntimeError):
    """A layer cannot look, so it must not report that it found nothing."""


# Of the errors that Spark finds before a job runs, those about data that is not there. Any
# other, such as an unknown column, is a mistake in a program and ends the plan.
DATA_MISSING = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


@dataclass(frozen=True)
class Mail:
    """Normalised mail. Rows are keyed by source_id, in column message_id.

    A Message-ID is chosen by the sender and may be repeated; the source is what tells
    two messages apart, so it is the key of everything until the result is written.
    """

    messages: DataFrame
    observations: DataFrame
    rejects: DataFrame


@dataclass(frozen=True)
class Records:
    """Recorded tables and fitted models that layers look things up in; all optional but suffixes."""

    suffixes: DataFrame
    brands: DataFrame | None = None
    registrations: DataFrame | None = None
    hops: DataFrame | None = None
    pages: DataFrame | None = None
    feeds: DataFrame | None = None
    feed_status: DataFrame | None = None
    dns: DataFrame | None = None
    networks: DataFrame | None = None
    language_model: DataFrame | None = None
    urgency_model: TermModel | PipelineModel | None = None
    fusion_model: PipelineModel | None = None


# Layers that look at what was read from markup.
MARKUP_LAYERS = (2, 3, 4)

# A layer takes the mail and gives signals. What it raises makes it incomplete.
Layer = Callable[[Mail], DataFrame]


def normalize(raw: DataFrame, qr_decodes: DataFrame | None = None, deadline_s: float | None = TOTAL_BUDGET_S) -> Mail:
    """Decode every message once and write the result, which all layers then read.

    A message whose decoding takes longer than deadline_s is a reject; one whose markup does is read
    up to there (see run_layers). Both know their own time, in decode_ms and html_ms.
    """
    decoded = cut_lineage(assemble_messages(decode_messages(raw, deadline_s), limit_s=deadline_s, durations=True))
    rejects = decoded.where("error IS NOT NULL").select(
        "source_id", F.lit("parse").alias("stage"), F.col("error").alias("reason")
    )
    messages = (
        decoded.where("error IS NULL")
        .drop("error")
        .withColumnsRenamed({"message_id": "header_id", "source_id": "message_id"})
    )
    found = observations.url_observations(messages)
    if qr_decodes is not None:
        found = observations.with_qr_observations(found, qr_decodes)
    return Mail(messages, cut_lineage(found), rejects)


def standard_layers(records: Records) -> dict[int, Layer]:
    """The four layers over what is recorded. A detector without its table is left out."""

    def union(signals: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, signals)

    def header_layer(mail: Mail) -> DataFrame:
        found = [
            headers.auth_signals(mail.messages),
            headers.replyto_signals(mail.messages, records.suffixes),
        ]
        if records.brands is not None:
            found.append(headers.impersonation_signals(mail.messages, records.brands, records.suffixes))
        if records.registrations is not None:
            senders = headers.sender_domains(
                mail.messages.select("message_id", "from_addr", "received_at"), records.suffixes)
            found.append(headers.domain_age_signals(senders, records.registrations))
        return union(found)

    def url_layer(mail: Mail) -> DataFrame:
        seen = mail.observations
        found = [
            links.base64_email_signals(seen), links.qr_signals(seen),
            observations.unread_signals(mail.messages, "links_unread"),
        ]
        if records.brands is not None:
            found.append(links.anchor_brand_signals(seen, records.brands, records.suffixes))
        if records.hops is not None:
            if "seen_at" in records.hops.columns:
                timed = seen.join(mail.messages.select("message_id", "received_at"), "message_id")
                resolved = cut_lineage(links.resolve_redirects_as_of(timed, records.hops))
            else:
                resolved = cut_lineage(links.resolve_redirects(seen, records.hops))
            found.append(links.redirect_signals(resolved))
            if records.pages is not None:
                found.append(links.captcha_signals(resolved, records.pages))
        return union(found)

    def text_layer(mail: Mail) -> DataFrame:
        found = [
            body.zero_width_signals(mail.messages),
            observations.unread_signals(mail.messages, "text_unread"),
        ]
        invisible = lambda c: F.regexp_count(c, F.lit(body.exprs.ZERO_WIDTH))
        features = mail.messages.select(
            "message_id", (invisible("subject") + invisible("body_text")).cast("double").alias("zero_width"),
        )
        if records.urgency_model is not None:
            texts = mail.messages.select("message_id", "body_text")
            urgency = cut_lineage(
                body.score_urgency(records.urgency_model, texts, "body_text").select("message_id", "urgency")
            )
            found.append(body.urgency_signals(urgency))
            features = features.join(urgency, "message_id")
        if records.language_model is not None:
            scores = body.sentence_scores(mail.messages, records.language_model)
            shape = cut_lineage(body.text_shape(scores, mail.messages))
            found += [body.perplexity_signals(shape), body.burstiness_signals(shape)]
            # Where the language-model signals abstain, fusion has no value either.
            long_enough = F.col("tokens") >= MIN_TOKENS
            features = features.join(
                shape.select(
                    "message_id", F.when(long_enough, F.col("perplexity")).alias("perplexity"),
                    F.when(long_enough, F.col("nll_spread")).alias("burstiness")), "message_id"
            )
        if records.fusion_model is not None and {*body.FUSION_FEATURES} <= {*features.columns}:
            found.append(body.fusion_signals(records.fusion_model, features))
        return union(found)

    def intel_layer(mail: Mail) -> DataFrame:
        if records.feeds is None:
            raise LayerUnavailable("no feeds are recorded")
        if records.feed_status is None:
            raise LayerUnavailable("the state of the feeds is not recorded")
        state = lookups.intel_available(records.feed_status).first()
        if not state["completed"]:
            raise LayerUnavailable(state["error"])
        feeds = records.feeds
        if "fetched_at" in feeds.columns:
            feeds = lookups.current_entries(feeds, records.feed_status)
        found = [
            intel.url_ioc_signals(mail.observations, feeds),
            intel.domain_ioc_signals(mail.observations, feeds, records.suffixes),
            observations.unread_signals(mail.messages, "intel_unread"),
        ]
        if records.dns is not None and records.networks is not None:
            found.append(intel.hosting_signals(mail.observations, records.dns, records.networks))
        return union(found)

    return {1: header_layer, 2: url_layer, 3: text_layer, 4: intel_layer}


def run_layers(mail: Mail, layers: Mapping[int, Layer | None]) -> tuple[DataFrame, DataFrame]:
    """Run each layer as a job of its own: (signals, runs).

    The signals of a layer are written before the next one starts, so a layer that
    fails takes nothing else with it; it is incomplete for the batch, with the reason.
    A layer that gives no table, or is not there, is incomplete too. Signals carry in `ran` the layer
    that produced them. duration_ms is what a message took: its own time in the functions that read
    it, which the layers share, and an equal part of the layer's job. The layers that read
    markup are incomplete for a message whose markup was cut by the deadline.
    """
    spark = mail.messages.sparkSession
    columns = spark.createDataFrame([], SIGNALS).columns
    signals = spark.createDataFrame([], f"{SIGNALS}, ran int")
    outcome = []
    for number in LAYERS:
        started, reason = time.monotonic(), None
        try:
            found = layers[number](mail) if layers.get(number) else None
            if found is None:
                raise TypeError("layer returned no signals table")
            signals = signals.unionByName(cut_lineage(found.select(*columns, F.lit(number).alias("ran"))))
        except AnalysisException as exc:
            if exc.getCondition() not in DATA_MISSING:
                raise
            reason = _reason(exc)
        except Exception as exc:  # whatever a layer meets stays in that layer
            reason = _reason(exc)
        outcome.append((number, reason, int((time.monotonic() - started) * 1000)))
    batch = max(1, mail.messages.count())
    late = F.when(F.col("html_error").startswith("timeout after "), F.col("html_error"))
    states = F.array(*[
        F.struct(
            F.lit(number).alias("layer"),
            (F.lit(reason is None) & (late.isNull() if number in MARKUP_LAYERS else F.lit(True))).alias("completed"),
            (F.coalesce(F.lit(reason).cast("string"), late) if number in MARKUP_LAYERS else F.lit(reason).cast("string")).alias("error"),
            (F.col("decode_ms") + (F.col("html_ms") if number in MARKUP_LAYERS else 0) + -(-max(1, took) // batch)).cast("bigint").alias("duration_ms"),
        )
        for number, reason, took in outcome
    ])
    return signals, mail.messages.select("message_id", F.inline(states))


def _reason(exc: Exception) -> str:
    """Kind of an error and the first line of its text, if it has one."""
    lines = str(exc).splitlines()
    return f"{type(exc).__name__}: {lines[0]}" if lines else type(exc).__name__


@dataclass(frozen=True)
class Result:
    assessments: DataFrame
    signals: DataFrame
    quarantine: DataFrame
    grid: DataFrame
    rejects: DataFrame


def assess_mail(
    raw: DataFrame,
    layers: Mapping[int, Layer | None],
    weights: DataFrame,
    thresholds: DataFrame,
    scored_at: Column,
    qr_decodes: DataFrame | None = None,
    limits: Mapping[int, float] | None = None,
    total: float | None = None,
    deadline_s: float | None = TOTAL_BUDGET_S,
) -> Result:
    """raw_messages(source_id, content) to assessments, with all that led to them.

    Assessments carry source_id beside the message's own id. A layer is incomplete for a message
    if it failed, if it produced a signal that breaks the contract, or if it took longer than
    `limits` (seconds by layer) or the whole longer than `total`; its signals do not count then.
    Limits are off by default. deadline_s is how long the functions that read a message may take for it.
    """
    mail = normalize(raw, qr_decodes, deadline_s)
    produced, runs = run_layers(mail, layers)
    accepted, quarantine = results.collect_signals(produced)
    grid = results.reject_layers(results.layer_grid(mail.messages, runs), quarantine)
    if limits is not None or total is not None:
        unlimited = dict.fromkeys(LAYERS, float("1e12"))
        grid = results.apply_budgets(grid, {**unlimited, **(limits or {})}, total)
    grid = cut_lineage(grid)
    signals = results.surviving_signals(accepted.drop("ran"), grid)
    scored = scoring.assess(grid, signals, weights, thresholds, scored_at)
    named = scored.join(mail.messages.select("message_id", "header_id"), "message_id").withColumnsRenamed(
        {"message_id": "source_id", "header_id": "message_id"}
    )
    return Result(named, signals, quarantine, grid, mail.rejects)
