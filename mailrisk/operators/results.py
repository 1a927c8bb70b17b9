"""Signal contract, completeness of layers, time budgets and the evidence table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailrisk.functions.exprs import blank
from mailrisk.schemas import LAYER_BUDGET_S, LAYERS, LEVELS, TOTAL_BUDGET_S
from mailrisk.session import if_small

NO_RESULT = "layer returned no result"
MAX_CONFIG_ROWS = 100_000


def signal_rule() -> Column:
    """The first rule of the signal contract that a row breaks, or NULL."""
    score = F.col("score")
    return (
        F.when(blank(F.col("message_id")), "message_id is blank")
        .when(F.col("layer").isNull() | ~F.col("layer").isin(*LAYERS), "layer is not one of 1-4")
        .when(F.col("severity").isNull() | ~F.col("severity").isin(*LEVELS), "severity is not a level")
        .when(blank(F.col("name")), "name is blank")
        .when(blank(F.col("evidence")), "evidence is blank")
        .when(score.isNull(), "score is missing")
        .when(F.isnan(score) | (F.abs(score) == float("inf")), "score is not finite")
        .when((score < 0) | (score > 1), "score is outside 0-1")
    )


def collect_signals(*producers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of all producers as (signals, quarantine); quarantined rows name the rule.

    Rows may say in `ran` which layer produced them; a signal of another layer is then quarantined too.
    """
    rows = reduce(DataFrame.unionByName, producers)
    rule = signal_rule()
    if "ran" in rows.columns:
        rule = F.coalesce(rule, F.when(F.col("layer") != F.col("ran"), "layer is not the one that ran"))
    ruled = rows.withColumn("rule", rule)
    return ruled.where("rule IS NULL").drop("rule"), ruled.where("rule IS NOT NULL")


def reject_layers(grid: DataFrame, quarantine: DataFrame, key: str = "message_id") -> DataFrame:
    """Make every layer that produced a quarantined signal for a message incomplete, with the rule as reason.

    quarantine(key, ran, rule). What such a layer found is not known, so it has not found the
    message clean. A quarantined signal without a message could be of any, so its layer is
    incomplete for all of them.
    """
    by_rule = F.min("rule").alias("rule")
    nameless = blank(F.col(key))
    named = quarantine.where(~nameless).groupBy(key, F.col("ran").alias("layer")).agg(by_rule)
    # One row per layer at most.
    anyone = F.broadcast(
        quarantine.where(nameless).groupBy(F.col("ran").alias("layer")).agg(F.min("rule").alias("any_rule")))
    rule = F.coalesce("rule", "any_rule")
    error = F.when(F.col("completed") & rule.isNotNull(), F.concat(F.lit("quarantined signal: "), rule)).otherwise(F.col("error"))
    return grid.join(named, [key, "layer"], "left").join(anyone, "layer", "left").select(
        key, "layer", (F.col("completed") & rule.isNull()).alias("completed"), error.alias("error"), "duration_ms")


def qualified_name() -> Column:
    return F.concat(F.lit("L"), F.col("layer"), F.lit("/"), F.col("name"))


def layer_grid(messages: DataFrame, runs: DataFrame, key: str = "message_id") -> DataFrame:
    """Exactly one row per message and layer; a layer without a result is incomplete.

    runs(key, layer, completed, error, duration_ms). Expected rows and recorded rows
    meet in one aggregation, so there is one shuffle and repeats are reduced before
    it. Of repeated results a completed one counts, then the longest.
    """
    run = F.struct(F.coalesce("completed", F.lit(False)).alias("completed"), "duration_ms", "error")
    recorded = runs.select(key, "layer", F.lit(False).alias("expected"), run.alias("run"))
    expected = messages.select(key, F.explode(F.array(*map(F.lit, LAYERS))).alias("layer")).select(
        key, "layer", F.lit(True).alias("expected"),
        F.lit(None).cast(recorded.schema["run"].dataType).alias("run"),
    )
    rows = expected.unionByName(recorded).groupBy(key, "layer").agg(
        F.max("expected").alias("expected"), F.max("run").alias("run")
    )
    done = F.coalesce(F.col("run.completed"), F.lit(False))
    return rows.where("expected").select(
        key,
        "layer",
        done.alias("completed"),
        F.when(~done, F.when(blank(F.col("run.error")), NO_RESULT).otherwise(F.col("run.error"))).alias("error"),
        F.coalesce("run.duration_ms", F.lit(0)).cast("bigint").alias("duration_ms"),
    )


def apply_budgets(
    grid: DataFrame,
    budgets: dict[int, float] | None = None,
    total: float | None = TOTAL_BUDGET_S,
    key: str = "message_id",
) -> DataFrame:
    """Make layers that ran over their time incomplete, from recorded durations.

    `budgets` replaces the limits of the layers it names. Layers run side by side and
    a cut layer has run only to its limit, so a message took as long as its longest
    cut layer. Over the total, all four layers are incomplete, finished or not. The
    grid has four rows per message, so the window is bounded.
    """
    limits = {**LAYER_BUDGET_S, **(budgets or {})}
    limit = lambda value: reduce(
        lambda case, k: case.when(F.col("layer") == k, value(limits[k])),
        sorted(limits)[1:],
        F.when(F.col("layer") == min(limits), value(limits[min(limits)])),
    )
    limit_ms = limit(lambda s: F.lit(int(s * 1000)).cast("bigint"))
    reason = limit(lambda s: F.lit(f"timeout after {s:g}s"))
    over = F.col("duration_ms") > F.col("limit_ms")
    cut = grid.withColumn("limit_ms", limit_ms).select(
        key,
        "layer",
        (F.col("completed") & ~over).alias("completed"),
        F.when(over, reason).otherwise(F.col("error")).alias("error"),
        F.least("duration_ms", "limit_ms").alias("duration_ms"),
    )
    if total is None:
        return cut
    total_ms = F.lit(int(total * 1000)).cast("bigint")
    late = F.max("duration_ms").over(Window.partitionBy(key)) > total_ms
    return cut.withColumn("late", late).select(
        key,
        "layer",
        (F.col("completed") & ~F.col("late")).alias("completed"),
        F.when(F.col("late"), f"pipeline exceeded its {total:g}s total budget")
        .otherwise(F.col("error")).alias("error"),
        F.when(F.col("late"), total_ms).otherwise(F.col("duration_ms")).alias("duration_ms"),
    )


def surviving_signals(signals: DataFrame, grid: DataFrame, key: str = "message_id") -> DataFrame:
    """Signals of completed layers; an incomplete layer reports nothing."""
    return signals.join(grid.where(~F.col("completed")).select(key, "layer"), [key, "layer"], "left_anti")


def check_layer_results(
    runs: DataFrame, signals: DataFrame, key: str = "message_id"
) -> DataFrame:
    """violations(key, layer, rule): one row for each rule a layer result breaks."""
    rules = F.array_compact(F.array(
        F.when(F.col("layer").isNull() | ~F.col("layer").isin(*LAYERS), F.lit("layer is not one of 1-4")),
        F.when(F.col("completed").isNull(), F.lit("completed is missing")),
        F.when(F.col("duration_ms").isNull() | (F.col("duration_ms") < 0), F.lit("duration is negative")),
        F.when(F.col("completed") & F.col("error").isNotNull(), F.lit("completed with an error")),
        F.when(~F.col("completed") & blank(F.col("error")), F.lit("incomplete without a reason")),
    ))
    broken = runs.select(key, "layer", F.explode(rules).alias("rule"))
    talking = (
        runs.where(~F.col("completed"))
        .select(key, "layer")
        .join(signals, [key, "layer"], "left_semi")
        .withColumn("rule", F.lit("incomplete with signals"))
    )
    return broken.unionByName(talking)


def evidence_table(
    grid: DataFrame, signals: DataFrame, weights: DataFrame, key: str = "message_id"
) -> DataFrame:
    """Every layer of every message with its signals, their evidence and contribution.

    The strongest signal of a layer makes its score, so it carries the layer's part of
    the composite; the others contribute nothing, also those of the same name or score.
    The contributions of a message add up to its composite. A layer without signals is one row,
    marked `no findings` or `not completed`.
    """
    live = F.when(F.col("error").isNull(), F.col("score"))
    top = signals.groupBy(key, "layer").agg(
        F.max(live).alias("top_score"),
        F.count("*").alias("produced"),
    )
    states = grid.select(key, "layer", "completed", F.col("error").alias("reason")).join(
        top, [key, "layer"], "left"
    )
    layer_score = F.when(
        F.col("completed"),
        F.when(F.col("produced").isNull(), F.lit(0.0)).otherwise(F.col("top_score")),
    )
    weighted = states.join(if_small(weights.select("layer", "weight"), MAX_CONFIG_ROWS), "layer")
    counted = weighted.withColumn("layer_score", layer_score)
    shares = F.sum(F.when(F.col("layer_score").isNotNull(), F.col("weight"))).over(Window.partitionBy(key))
    layers = counted.withColumn("share", F.col("weight") / shares)
    # A layer that did not complete shows no signal, whatever was recorded for it.
    ties = Window.partitionBy(key, "layer").orderBy(live.desc_nulls_last(), "name", "evidence")
    reported = signals.select(
        key, "layer", F.lit(True).alias("completed"), "name", "severity",
        live.alias("score"), "evidence", F.col("error").alias("abstained"), F.row_number().over(ties).alias("rank"),
    )
    shown = layers.join(reported, [key, "layer", "completed"], "left")
    status = (
        F.when(~F.col("completed"), "not completed")
        .when(F.col("name").isNull(), "no findings")
        .when(F.col("abstained").isNotNull(), "abstained")
        .otherwise("fired")
    )
    contribution = F.when(
        status == "fired",
        F.when(F.col("rank") == 1, F.col("share") * F.col("score")).otherwise(0.0),
    )
    return shown.select(
        key, "layer", "name", status.alias("status"), "score", "severity",
        F.when(F.col("completed"), F.col("evidence")).otherwise(F.col("reason")).alias("evidence"),
        contribution.alias("contribution"),
    )
