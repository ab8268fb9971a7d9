"""Calibration: confusion counts, rates and their intervals, ROC-AUC by ranks, threshold sweep, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import numbers as N

SUFFICIENT = 30
PARTS = 64


def confusion(scored: DataFrame, threshold: float, *group: str) -> DataFrame:
    """tp, fp, tn, fn of label (0/1) at score >= threshold."""
    hit = F.col("score") >= threshold
    return scored.groupBy(*group).agg(
        F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"),
        F.count_if(~hit & (F.col("label") == 0)).alias("tn"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Recall, false-positive rate, precision, balanced accuracy with Wilson intervals of the first two; null without cases."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, fpr = N.ratio(tp, tp + fn), N.ratio(fp, fp + tn)
    recall_low, recall_high = N.wilson(tp, tp + fn)
    fpr_low, fpr_high = N.wilson(fp, fp + tn)
    return counts.select(
        "*", recall.alias("recall"), fpr.alias("fpr"), N.ratio(tp, tp + fp).alias("precision"), ((recall + 1 - fpr) / 2).alias("balanced"),
        recall_low.alias("recall_low"), recall_high.alias("recall_high"), fpr_low.alias("fpr_low"), fpr_high.alias("fpr_high"),
        ((tp + fn >= SUFFICIENT) & (fp + tn >= SUFFICIENT)).alias("sufficient"),
    )


def _by_score(scored: DataFrame) -> DataFrame:
    """p and n (rows of label 1 and 0) of each distinct score, with p_above, n_above, n_below and the totals over all others.

    Scores are dealt by value into PARTS ranges. Within a range a running sum is exact; what lies in other ranges is added from
    a table of one row for each, so no task sees more scores than a range has.
    """
    by = scored.where("score is not null").groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    bounds = by.agg(F.percentile_approx("score", [i / PARTS for i in range(1, PARTS)])).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("score"))) if bounds else F.lit(0)
    by = by.withColumn("part", part)
    ranges = by.groupBy("part").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    order = Window.orderBy("part")  # of PARTS rows
    after, before, all_ = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranges = ranges.select(
        "part", zero(F.sum("rp").over(after)).alias("pa"), zero(F.sum("rn").over(after)).alias("na"), zero(F.sum("rn").over(before)).alias("nb"), F.sum("rp").over(all_).alias("positives"), F.sum("rn").over(all_).alias("negatives")
    )
    up = Window.partitionBy("part").orderBy("score")
    from_here, lower = up.rowsBetween(0, Window.unboundedFollowing), up.rowsBetween(Window.unboundedPreceding, -1)
    return by.join(F.broadcast(ranges), "part").select(
        "score", "p", "n", (F.sum("p").over(from_here) + F.col("pa")).alias("p_above"), (F.sum("n").over(from_here) + F.col("na")).alias("n_above"),
        (zero(F.sum("n").over(lower)) + F.col("nb")).alias("n_below"), "positives", "negatives",
    )


def _labelled(scored: DataFrame) -> DataFrame:
    return scored.select("score", (F.col("label") == 1).cast("long").alias("p"), (F.col("label") == 0).cast("long").alias("n"))


def auc_counts(scored: DataFrame) -> DataFrame:
    """twice_wins, positives, negatives: AUC = twice_wins / (2 * positives * negatives), ties one half; null score rows don't count."""
    by = _by_score(_labelled(scored))
    return by.agg(F.sum(F.col("p") * (2 * F.col("n_below") + F.col("n"))).alias("twice_wins"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Counts at every distinct score, and at 0.0 and 1.0."""
    none = F.lit(0).cast("long")
    ends = scored.sparkSession.range(2).select(F.col("id").cast("double").alias("score"), none.alias("p"), none.alias("n"))
    by = _by_score(_labelled(scored).unionByName(ends))
    return by.select(
        F.col("score").alias("threshold"), F.col("p_above").alias("tp"), F.col("n_above").alias("fp"), (F.col("negatives") - F.col("n_above")).alias("tn"), (F.col("positives") - F.col("p_above")).alias("fn")
    )


def best_threshold(swept: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """The threshold of highest balanced accuracy, then lowest false-positive rate, then highest threshold; rates in millionths."""
    scored = rates(swept).select("threshold", N.scaled("balanced", scale).alias("balanced"), N.scaled("fpr", scale).alias("fpr"))
    return scored.orderBy(F.desc("balanced"), "fpr", F.desc("threshold")).limit(1)


def sliced(scored: DataFrame, threshold: float, *dimensions: str) -> DataFrame:
    """Confusion counts overall and for each value of each dimension, in one pass over grouping sets."""
    hit = F.col("score") >= threshold
    by = scored.groupingSets([[], *[[d] for d in dimensions]], *dimensions).agg(
        F.count("*").alias("n"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.grouping_id().alias("level")
    )
    return by
