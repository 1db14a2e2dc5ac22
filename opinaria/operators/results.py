"""Result tables of model comparisons: pivots with margins, pruning, best cells, flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AVERAGE = "Average"


def grouped_means(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    """(c_name, v_name, mean) for each cell and, under the name ``Average``, each row, column and
    the whole. Margins average the raw rows, not the cell means; null metrics are left out."""
    cube = results.filter(F.col(metric).isNotNull()).cube("c_name", "v_name").agg(
        F.avg(metric).alias("mean"), F.grouping("c_name").alias("_gc"), F.grouping("v_name").alias("_gv"))
    return cube.select(F.when(F.col("_gc") == 1, AVERAGE).otherwise(F.col("c_name")).alias("c_name"),
                       F.when(F.col("_gv") == 1, AVERAGE).otherwise(F.col("v_name")).alias("v_name"), "mean")


def pivot_means(means: DataFrame, v_names: Sequence[str], average: bool = True, ascending: bool = False) -> DataFrame:
    """One row per classifier and one column per vectoriser, ordered by the row average."""
    wide = means.groupBy("c_name").pivot("v_name", [*v_names, AVERAGE]).agg(F.first("mean"))
    order = F.asc(AVERAGE) if ascending else F.desc(AVERAGE)
    if average:
        return wide.orderBy(order, "c_name")
    return wide.filter(F.col("c_name") != AVERAGE).orderBy(order, "c_name").drop(AVERAGE)


def column_order(means: DataFrame, ascending: bool = True) -> DataFrame:
    """Vectorisers (and the average) by column average rounded to four digits."""
    rounded = F.round("mean", 4)
    columns = means.filter(F.col("c_name") == AVERAGE).select("v_name", rounded.alias("mean"))
    return columns.orderBy(F.asc("mean") if ascending else F.desc("mean"), "v_name")


def above_average(results: DataFrame, metric: str = "accuracy", renamed: Mapping[str, str] | None = None) -> DataFrame:
    """(kind, name) of the classifiers and vectorisers whose mean beats the grand mean.
    ``renamed`` rewrites parts of classifier names."""
    means = grouped_means(results, metric)
    grand = means.filter((F.col("c_name") == AVERAGE) & (F.col("v_name") == AVERAGE)).select("mean").scalar()
    margins = means.filter((F.col("c_name") == AVERAGE) != (F.col("v_name") == AVERAGE)).filter(F.col("mean") > grand)
    is_c = F.col("v_name") == AVERAGE
    c_name = F.col("c_name")
    for old, new in (renamed or {}).items():
        c_name = F.replace(c_name, F.lit(old), F.lit(new))
    return margins.select(F.when(is_c, "classifier").otherwise("vectorizer").alias("kind"),
                          F.when(is_c, c_name).otherwise(F.col("v_name")).alias("name"))


def keep_options(options: DataFrame, kept: DataFrame, kind: str) -> DataFrame:
    """Options (column ``name``) that survived the pruning."""
    return options.join(kept.filter(F.col("kind") == kind).select("name"), "name", "left_semi")


def metric_range(results: DataFrame, metric: str) -> DataFrame:
    return results.agg(F.min(metric).alias("low"), F.max(metric).alias("high"))


def best_cell(results: DataFrame, metric: str = "accuracy", largest: bool = True) -> DataFrame:
    """The row holding the extreme value; ties go to the first names."""
    value = F.col(metric)
    rows = results.filter(value.isNotNull())
    pick = F.min(F.struct((-value if largest else value).alias("_v"), "v_name", "c_name"))
    return rows.agg(pick.alias("_b")).select("_b.v_name", "_b.c_name",
                                             (-F.col("_b._v") if largest else F.col("_b._v")).alias(metric))


def cell(results: DataFrame, c_name: str, v_name: str) -> DataFrame:
    return results.filter((F.col("c_name") == c_name) & (F.col("v_name") == v_name))


def with_total_time(results: DataFrame) -> DataFrame:
    return results.withColumn("total_time", F.col("train_time") + F.col("predict_time"))


def flag_members(results: DataFrame, chosen: DataFrame) -> DataFrame:
    """``*`` on the results whose (v_name, c_name) was chosen; the list of members is a few names."""
    marked = chosen.select("v_name", "c_name", F.lit("*").alias("_flag")).distinct()
    return results.drop("flag").join(marked, ["v_name", "c_name"], "left").withColumn(
        "flag", F.coalesce("_flag", F.lit(""))).drop("_flag")


def weighted_accuracy(new, old):
    """A refitted ensemble's accuracy and its earlier vote's, the earlier counting twice."""
    return (new + 2 * old) / 3


def confusion_matrix(predictions: DataFrame, labels: Sequence, label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts per (label, prediction) and their share of all rows, zero cells included."""
    counts = predictions.groupBy(F.col(label).alias("label")).agg(
        *[F.count_if(F.col(pred) == p).alias(f"_p{i}") for i, p in enumerate(labels)])
    total = counts.agg(F.sum(sum([F.col(f"_p{i}") for i in range(1, len(labels))], F.col("_p0")))).scalar()
    cells = F.array(*[F.struct(F.lit(p).alias("pred"), F.col(f"_p{i}").alias("n")) for i, p in enumerate(labels)])
    return counts.select("label", F.inline(cells)).withColumn("share", F.col("n") / total)


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy on ``test`` of always answering the most frequent label of ``train``."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("_n"), label))[label]).scalar()
    return test.agg(F.avg((F.col(label) == top).cast("int")).alias("accuracy")).withColumn("majority", top)
