"""Counts, means and word frequencies behind the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.functions.tokens import words
from opinaria.session import computed, cut_lineage, lookup, sized

SENTIMENTS = ("positive", "negative")


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None, id_col: str | None = None) -> DataFrame:
    """One row per distinct content. With ``id_col``, which is unique, the row with the smallest id is kept, so the
    outcome does not depend on the order of rows.

    Then only ids and 128-bit digests of the content are shuffled, merged before the shuffle; the ids that lose are found
    among the groups of more than one row and taken out of ``df``, whose texts stay where they are while those ids fit a broadcast.
    """
    keys = list(subset) if subset else [c for c in df.columns if c != id_col]
    if id_col is None:
        return df.dropDuplicates(keys)
    losers = duplicate_ids(df, keys, id_col)
    return df.join(sized(losers), id_col, "left_anti").select(df.columns)


def duplicate_ids(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The ids of all rows but the first of each content, a written table."""
    cells = [part for c in keys for part in (F.isnull(c), F.col(c))]  # the hash itself passes over nulls
    digest = F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *reversed(cells)).alias("b"))
    rows = cut_lineage(df.select(id_col, digest.alias("_digest")))
    groups = rows.groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    losers = lookup(rows, groups, "_digest", "inner", salt=F.col(id_col)).filter(F.col(id_col) != F.col("_first")).select(id_col)
    return cut_lineage(losers)


def count_share(df: DataFrame, by: str) -> DataFrame:
    """Rows per value and their share of all rows. The total sums the counted groups."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def mean_by(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias(f"mean_{value}"))


def count_by(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def count_by_source_sentiment(df: DataFrame) -> DataFrame:
    """Counts per source with a zero-filled column per sentiment, largest source first."""
    counted = df.groupBy("source").agg(
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS], F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "source")


def exploded_words(df: DataFrame, text: str, name: str, *carry: str) -> DataFrame:
    """One row per word of ``text``; the text is split once."""
    return computed(df.select(*carry, text), _t=words(F.col(text))).select(*carry, F.explode("_t").alias(name))


def word_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """Word counts over all texts and per sentiment; ``sentiment`` is null for all texts.

    One aggregation with a count per class, combined before the shuffle; the classes are
    unfolded afterwards from one row per word.
    """
    tokens = exploded_words(df, text, "word", "sentiment")
    counted = tokens.groupBy("word").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS])
    cells = F.array(F.struct(F.lit(None).cast("string").alias("sentiment"), F.col("n")),
                    *[F.struct(F.lit(s).alias("sentiment"), F.col(s).alias("n")) for s in SENTIMENTS])
    return counted.select("word", F.inline(cells)).filter("n > 0")


def top_n(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(n)


def token_counts(tokens: DataFrame, word: str = "word") -> DataFrame:
    return tokens.groupBy(word).agg(F.count("*").alias("n"))


def unigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return exploded_words(df, text, "term").groupBy("term").agg(F.count("*").alias("n"))


def bigrams_of(tokens: Column) -> Column:
    """Adjacent word pairs of one sentence."""
    pairs = F.arrays_zip(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("w1"),
                         F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("w2"))
    return pairs


def bigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    pairs = computed(df.select(text), _t=words(F.col(text))).select(bigrams_of(F.col("_t")).alias("_p"))
    return (pairs.select(F.inline("_p"))
            .groupBy("w1", "w2").agg(F.count("*").alias("n")))


def accuracy(prediction: Column, label: Column) -> Column:
    return F.avg((prediction == label).cast("int"))


def misclassification(prediction: Column, label: Column) -> Column:
    return F.avg((prediction != label).cast("int"))


def stage_counts(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, n): rows that pass each condition and all before it, counted in one pass over ``df``."""
    passed, counts = F.lit(True), []
    for name, condition in stages.items():
        passed = passed & condition
        counts.append(F.struct(F.lit(name).alias("stage"), F.count_if(passed).alias("n")))
    return df.agg(F.array(*counts).alias("_c")).select(F.inline("_c"))
