"""ROC and precision-recall curves per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.operators.quantiles import running_sums
from opinaria.session import cut_lineage


def _ranked(scored: DataFrame, model: str, score: str, label: str) -> DataFrame:
    """Distinct scores with positives and negatives at and above each. Rows of equal score are
    merged map-side, then summed bucket by bucket instead of in one sorted partition."""
    merged = scored.groupBy(F.col(model).alias("model"), F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    merged = cut_lineage(merged)
    totals = merged.groupBy("model").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ranked = running_sums(merged, ["model"], "threshold", ["pos", "neg"])
    return ranked.join(F.broadcast(totals), "model")


def roc_curve(scored: DataFrame, model: str = "model", score: str = "score", label: str = "label",
              drop_collinear: bool = True) -> DataFrame:
    """(model, threshold, fpr, tpr), starting at (0, 0) with a null threshold. ``drop_collinear`` omits
    points on a straight line between their neighbours. For a micro average over classes, give
    all classes' rows the same model name."""
    ranked = _ranked(scored, model, score, label)
    if drop_collinear:
        bends = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        ranked = ranked.filter(bends | F.col("next_pos").isNull())
    points = ranked.select("model", "threshold", (F.col("cum_neg") / F.nullif("n", F.lit(0))).alias("fpr"),
                           (F.col("cum_pos") / F.nullif("p", F.lit(0))).alias("tpr"))
    origin = points.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def area_under_roc(scored: DataFrame, model: str = "model", score: str = "score", label: str = "label") -> DataFrame:
    """Trapezoid area per model; each distinct score adds its own strip."""
    ranked = _ranked(scored, model, score, label)
    strip = F.col("neg") * (F.col("cum_pos") * 2 - F.col("pos")) / 2.0
    return ranked.groupBy("model").agg((F.sum(strip) / F.nullif(F.first("p") * F.first("n"), F.lit(0))).alias("auc"))


def precision_recall_curve(scored: DataFrame, model: str = "model", score: str = "score", label: str = "label") -> DataFrame:
    """(model, threshold, precision, recall) down to the first threshold with full recall, and the end
    point (1, 0) with a null threshold."""
    ranked = _ranked(scored, model, score, label).filter(F.col("cum_pos") - F.col("pos") < F.col("p"))
    points = ranked.select("model", "threshold", (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                           (F.col("cum_pos") / F.col("p")).alias("recall"))
    end = points.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)
