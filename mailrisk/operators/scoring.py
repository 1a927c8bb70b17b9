"""Layer scores, composite score, level, action and assessments.

A layer without a score is missing information. It stays NULL all the way: its
weight goes to the layers that have a score, and a message without any has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.operators.results import MAX_CONFIG_ROWS
from mailrisk.schemas import LAYERS, SCORE_DIGITS
from mailrisk.session import if_small


def layer_scores(grid: DataFrame, signals: DataFrame, key: str = "message_id") -> DataFrame:
    """layer_scores(key, layer, completed, score).

    The strongest signal that did not abstain; 0 for a completed layer that produced
    none; NULL when the layer is incomplete or all of its signals abstained. Signals are
    reduced to one row per layer before they meet the grid, which comes from its own
    aggregation partitioned by the same keys and is not shuffled again.
    """
    found = signals.groupBy(key, "layer").agg(
        F.max(F.when(F.col("error").isNull(), F.col("score"))).alias("score"),
        F.count("*").alias("produced"),
    )
    score = F.when(F.col("completed") & F.col("produced").isNull(), F.lit(0.0)).when(
        F.col("completed"), F.col("score")
    )
    return grid.select(key, "layer", "completed").join(found, [key, "layer"], "left").select(
        key, "layer", "completed", score.alias("score")
    )


def composite_score(scores: DataFrame, weights: DataFrame, key: str = "message_id") -> DataFrame:
    """composite(profile, key, score, layers_completed), one row per message and profile.

    The weighted mean over layers with a score. weights(profile, layer, weight) may
    hold several profiles; the same recorded scores are then scored under each.
    """
    weighted = scores.join(if_small(weights, MAX_CONFIG_ROWS), "layer")
    known = F.col("score").isNotNull()
    total = F.sum(F.when(known, F.col("weight") * F.col("score")))
    mass = F.sum(F.when(known, F.col("weight")))
    # Layers that ran, as one bit each: a fixed-size value that hash aggregation can hold.
    ran = F.bit_or(F.when(F.col("completed"), F.expr("shiftleft(1, layer)")).otherwise(0))
    sums = weighted.groupBy("profile", key).agg(total.alias("total"), mass.alias("mass"), ran.alias("ran"))
    layers = [F.when(F.col("ran").bitwiseAND(1 << k) != 0, F.lit(k)) for k in LAYERS]
    return sums.select(
        "profile",
        key,
        F.round(F.try_divide("total", "mass"), SCORE_DIGITS).alias("score"),
        F.array_compact(F.array(*layers)).alias("layers_completed"),
    )


def rescore(scores: DataFrame, profiles: DataFrame, key: str = "message_id") -> DataFrame:
    """Recorded layer scores under every weight profile at once."""
    return composite_score(scores, profiles, key).select("profile", key, "score")


def level_of(score: Column, deliver: Column, block: Column) -> Column:
    return F.when(score >= block, "high").when(score >= deliver, "medium").when(score.isNotNull(), "low")


def band_level(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add level by the thresholds of the row's profile; no score gives no level."""
    bounds = if_small(thresholds, MAX_CONFIG_ROWS)
    return scored.join(bounds, "profile").withColumn(
        "level", level_of(F.col("score"), F.col("deliver"), F.col("block"))
    ).drop("deliver", "block")


def apply_policy(assessments: DataFrame, policy: DataFrame) -> DataFrame:
    """Add action by policy(level, action); no level gives no action."""
    return assessments.join(if_small(policy, MAX_CONFIG_ROWS), "level", "left")


def assess(
    grid: DataFrame,
    signals: DataFrame,
    weights: DataFrame,
    thresholds: DataFrame,
    scored_at: Column,
    key: str = "message_id",
) -> DataFrame:
    """Assessments with the layers that ran. The caller supplies the time stamp.

    Weights and thresholds must hold one profile; see rescore for several.
    """
    scored = composite_score(layer_scores(grid, signals, key), weights, key)
    levelled = band_level(scored, thresholds)
    missing = F.array_except(F.array(*map(F.lit, LAYERS)), "layers_completed")
    summary = F.when(F.size(missing) == 0, "all layers completed").otherwise(
        F.concat(F.lit("not completed: L"), F.array_join(missing, ", L"))
    )
    return levelled.select(
        key, "score", "level", summary.alias("summary"), "layers_completed", scored_at.alias("scored_at")
    )
