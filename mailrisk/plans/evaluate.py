"""The evaluation report: every table of it, written to one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.operators import evaluation, scoring
from mailrisk.session import cut_lineage


def write_report(
    signals: DataFrame,
    grid: DataFrame,
    labels: DataFrame,
    weights: DataFrame,
    thresholds: DataFrame,
    path: str,
    fp_cost: float = 5.0,
    fn_cost: float = 1.0,
) -> list[str]:
    """Metrics, confusion, ROC with AUC and thresholds, ablation, refitted weights and health.

    Layer scores are written once and read by all of them. Composite scores are
    layer 0 in the ROC tables.
    """
    scores = cut_lineage(scoring.layer_scores(grid, signals))
    composite = scoring.composite_score(scores, weights)
    levelled = scoring.band_level(composite, thresholds)
    ranked = scores.select("message_id", "layer", "score").unionByName(
        composite.select("message_id", F.lit(0).alias("layer"), "score")
    )
    points = cut_lineage(evaluation.roc_points(ranked, labels, "layer"))
    tables = {
        "signal_metrics": evaluation.signal_metrics(signals, labels, grid),
        "confusion": evaluation.confusion(levelled, labels),
        "roc_points": points,
        "auc": evaluation.auc(points, "layer"),
        "thresholds": evaluation.choose_threshold(points, "layer", fp_cost, fn_cost),
        "ablation": evaluation.ablation(scores, weights, labels),
        "fitted_weights": evaluation.fit_composite(scores, labels),
        "layer_health": evaluation.layer_health(grid, signals),
    }
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    return list(tables)
