"""Evaluation against labels: metrics, ROC, threshold choice, ablation, refit, health.

labels(message_id, label) hold 1 for threat and 0 for clean.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailrisk.operators.results import MAX_CONFIG_ROWS
from mailrisk.operators.skew import running_total
from mailrisk.schemas import LAYERS, SCORE_DIGITS, WEIGHTS
from mailrisk.session import cut_lineage, if_small

ROC_BUCKETS = 4096


def signal_metrics(signals: DataFrame, labels: DataFrame, grid: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each signal over labelled messages whose layer completed.

    A message on which a signal abstained counts neither for nor against it; those
    are in `abstained`. One whose layer did not complete was not judged at all: its signals do not
    count, and it is in `incomplete`, not among the misses. Labelled messages that are not
    in the grid(message_id, layer, completed) were never assessed and take no part.
    Each message counts once per signal.
    """
    fired = F.col("error").isNull() & (F.col("score") > 0)
    per_message = signals.groupBy("message_id", "layer", "name").agg(
        F.max(fired).alias("fired"), F.max(F.col("error").isNotNull()).alias("unknown")
    )
    assessed = grid.select("message_id", "layer", "completed").join(labels.select("message_id", "label"), "message_id")
    judged = per_message.join(assessed.where("completed").select("message_id", "layer", "label"), ["message_id", "layer"])
    # Four rows: what the signals of a layer could have found.
    layers = F.broadcast(assessed.groupBy("layer").agg(
        F.count_if(F.col("completed") & (F.col("label") == 1)).alias("threats"), F.count_if(~F.col("completed")).alias("incomplete")))
    threat = F.col("label") == 1
    silent = F.col("unknown") & ~F.col("fired")
    counts = judged.groupBy("layer", "name").agg(
        F.count_if(F.col("fired") & threat).alias("tp"),
        F.count_if(F.col("fired") & ~threat).alias("fp"),
        F.count_if(silent).alias("abstained"),
        F.count_if(silent & threat).alias("abstained_threats"),
    )
    scored = counts.join(layers, "layer").withColumn("fn", F.col("threats") - F.col("tp") - F.col("abstained_threats"))
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return scored.select(
        "layer", "name", "tp", "fp", "fn", "abstained", "incomplete",
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    )


def confusion(assessments: DataFrame, labels: DataFrame, verdict: str = "level") -> DataFrame:
    """Messages by label and verdict. A message that could not be scored is `unscored`."""
    return (
        assessments.join(labels, "message_id")
        .groupBy("label", F.coalesce(F.col(verdict), F.lit("unscored")).alias("verdict"))
        .agg(F.count("*").alias("messages"))
    )


def roc_points(scored: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """ROC points of each group: flag everything scored `threshold` or higher.

    Messages are counted per distinct score first, and the counts are written once.
    The running totals are taken in score buckets, so a group of any size is spread
    over many tasks.
    """
    judged = scored.where("score IS NOT NULL").select("message_id", by, "score").join(labels, "message_id")
    counts = judged.groupBy(by, F.col("score").alias("threshold")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    bucket = F.floor((1 - F.col("threshold")) * ROC_BUCKETS)
    running = running_total(cut_lineage(counts), [by], F.col("threshold").desc(), bucket, ["pos", "neg"])
    tp = F.col("before_pos") + F.col("pos")
    fp = F.col("before_neg") + F.col("neg")
    return running.select(
        by, "threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"),
        F.col("all_pos").alias("positives"), F.col("all_neg").alias("negatives"),
        F.try_divide(tp, F.col("all_pos")).alias("tpr"), F.try_divide(fp, F.col("all_neg")).alias("fpr"),
    )


def auc(points: DataFrame, by: str) -> DataFrame:
    """Area under the ROC curve; messages with equal scores get half credit.

    The sums are whole numbers of up to 38 digits until the last division, so the value does not
    depend on the order of addition, and no number of messages overflows it.
    """
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    pairs = wide("neg") * (2 * (wide("tp") - wide("pos")) + wide("pos")).cast("decimal(19,0)")
    return points.groupBy(by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("scored"),
        F.round(
            F.try_divide(
                F.sum(pairs).cast("double"),
                2 * F.max("positives").cast("double") * F.max("negatives").cast("double"),
            ), SCORE_DIGITS
        ).alias("auc"),
    )


def choose_threshold(
    points: DataFrame, by: str, fp_cost: float = 5.0, fn_cost: float = 1.0
) -> DataFrame:
    """The cheapest threshold of each group, false alarms costing more. Ties go to the higher one."""
    cost = F.col("fp") * fp_cost + (F.col("positives") - F.col("tp")) * fn_cost
    best = points.withColumn("cost", cost).groupBy(by).agg(
        F.min(F.struct("cost", (-F.col("threshold")).alias("lowered"), "tp", "fp")).alias("best")
    )
    return best.select(
        by, (-F.col("best.lowered")).alias("threshold"), "best.cost", "best.tp", "best.fp"
    )


def ablation(scores: DataFrame, weights: DataFrame, labels: DataFrame) -> DataFrame:
    """AUC with all layers and with each left out: ablation(dropped, scored, auc, marginal).

    `dropped` is 0 for all layers. Every variant is a sum over the same four rows of
    a message, so all five are computed in one aggregation and unfolded after it.
    """
    weighted = scores.join(if_small(weights.select("layer", "weight"), MAX_CONFIG_ROWS), "layer")
    known = F.col("score").isNotNull()

    def part(dropped: int, value):
        return F.sum(F.when(known & (F.col("layer") != dropped), value))

    variants = (0, *LAYERS)
    sums = weighted.groupBy("message_id").agg(
        *[part(d, F.col("weight") * F.col("score")).alias(f"total{d}") for d in variants],
        *[part(d, F.col("weight")).alias(f"mass{d}") for d in variants],
    )
    rows = F.array(*[
        F.struct(
            F.lit(d).alias("dropped"),
            F.round(F.try_divide(F.col(f"total{d}"), F.col(f"mass{d}")), SCORE_DIGITS).alias("score"),
        )
        for d in variants
    ])
    areas = auc(roc_points(sums.select("message_id", F.inline(rows)), labels, "dropped"), "dropped")
    # Five rows meet in one window, so the areas are computed once.
    whole = F.max(F.when(F.col("dropped") == 0, F.col("auc"))).over(Window.partitionBy(F.lit(0)))
    return areas.withColumn("marginal", F.round(whole - F.col("auc"), SCORE_DIGITS))


def fit_composite(
    scores: DataFrame, labels: DataFrame, profile: str = "fitted", max_iter: int = 100
) -> DataFrame:
    """Weights refitted on labelled messages: weights(profile, layer, weight).

    Only messages on which all layers have a score are used. A layer that speaks
    against a threat gets no weight; the others are scaled to sum to one.
    """
    columns = [f"l{k}" for k in LAYERS]
    wide = scores.groupBy("message_id").pivot("layer", list(LAYERS)).agg(F.max("score")).toDF(
        "message_id", *columns
    )
    rows = wide.dropna(subset=columns).join(labels, "message_id").withColumn(
        "label", F.col("label").cast("double")
    )
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    fitted = LogisticRegression(maxIter=max_iter, regParam=0.01).fit(vectors)
    positive = [max(0.0, c) for c in fitted.coefficients.toArray().tolist()]
    mass = sum(positive)
    share = [c / mass if mass else 1.0 / len(LAYERS) for c in positive]
    return scores.sparkSession.createDataFrame(
        [(profile, k, w) for k, w in zip(LAYERS, share)], WEIGHTS
    )


def layer_health(grid: DataFrame, signals: DataFrame) -> DataFrame:
    """Coverage and latency by layer.

    Durations are counted per millisecond value first, so the exact percentiles are
    taken over the distinct values of a layer and not over its runs.
    """
    runs = grid.groupBy("layer", "duration_ms").agg(
        F.count("*").alias("runs"), F.count_if("completed").alias("completed")
    )
    at = lambda share: F.percentile("duration_ms", F.lit(share), F.col("runs"))
    health = runs.groupBy("layer").agg(
        F.sum("runs").alias("runs"),
        (F.sum("completed") / F.sum("runs")).alias("completed_share"),
        at(0.5).alias("p50_ms"),
        at(0.95).alias("p95_ms"),
        F.max("duration_ms").alias("max_ms"),
    )
    abstained = signals.groupBy("layer").agg(
        F.count("*").alias("signals"),
        F.avg(F.col("error").isNotNull().cast("double")).alias("abstained_share"),
    )
    return health.join(abstained, "layer", "left").withColumn("signals", F.coalesce("signals", F.lit(0)))


def holdout(df: DataFrame, fraction: float, key: str = "message_id") -> DataFrame:
    """Add `heldout`: the same messages every time, by a hash of the id alone."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10)
    return df.withColumn("heldout", number.cast("bigint") % 1000 < int(fraction * 1000))
