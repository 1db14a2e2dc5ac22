"""Bag-of-words features: vocabulary fit, counts, TF-IDF, robust scaling, information gain.

Long form (document, term, value) serves the relational operators; the same fitted vocabulary
also becomes Spark ML transformers, which need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinaria.functions.tokens import bucket, ngrams, skip_ngrams, vector_tokens
from opinaria.operators.lexicon import bucket_test
from opinaria.operators.quantiles import exact_quantiles
from opinaria.session import computed, cut_lineage, lookup


@dataclass(frozen=True)
class Vectorizer:
    """What to count: n-grams up to ``high``, with ``skip`` words left out, as counts or TF-IDF."""

    name: str
    high: int = 1
    skip: int | None = None
    tfidf: bool = False
    min_df: int = 8
    max_df: float = 0.8
    max_features: int = 2500

    def terms(self, text: Column) -> Column:
        return self.grams(vector_tokens(text), 1, self.high)

    def grams(self, tokens: Column, low: int, high: int) -> Column:
        """The terms of ``low`` to ``high`` words, in this order."""
        return ngrams(tokens, low, high) if self.skip is None else skip_ngrams(tokens, high, self.skip, low)


# The eight vectorisers compared by the model search.
VECTORIZERS = (
    Vectorizer("Unigram"),
    Vectorizer("Bigram", high=2),
    Vectorizer("Trigram", high=3),
    Vectorizer("2-Skip-Bigram", high=2, skip=2),
    Vectorizer("2-Skip-Trigram", high=3, skip=2),
    Vectorizer("TF-IDF Unigram", tfidf=True),
    Vectorizer("TF-IDF Bigram", high=2, tfidf=True),
    Vectorizer("TF-IDF Trigram", high=3, tfidf=True),
)


def term_statistics(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """Documents (``df``) and occurrences (``tf``) per term. Both counts come from one exploded
    stream and are combined map-side, so a term in every document shuffles one row per task."""
    return _counted(docs, terms, with_rows=False)


def _counted(docs: DataFrame, terms: str, with_rows: bool) -> DataFrame:
    """``with_rows`` adds a row without a term, whose ``df`` is the number of documents: counting them by themselves would
    work out the terms of every text once more."""
    once = F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("t")))
    every = F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("t")))
    row = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("d"), F.lit(0).alias("t")))
    return (computed(docs.select(terms), _t=F.concat(once, every, row) if with_rows else F.concat(once, every)).select(F.inline("_t"))
            .groupBy("term").agg(F.sum("d").alias("df"), F.sum("t").alias("tf")))


def fit_vocabulary(docs: DataFrame, spec: Vectorizer, terms: str = "terms") -> DataFrame:
    """The most frequent terms within the document-frequency bounds, indexed alphabetically:
    (term, idx, df, tf), at most ``max_features`` rows. ``terms`` may hold all terms or the words only."""
    if spec.high == 1:
        return word_vocabulary(docs, spec, terms)
    return word_vocabulary(cut_lineage(docs.select(F.filter(terms, lambda t: ~F.contains(t, F.lit(" "))).alias("words"))), spec)


def word_vocabulary(docs: DataFrame, spec: Vectorizer, words: str = "words") -> DataFrame:
    """:func:`fit_vocabulary` from the words of the documents, one length of the terms after the other (Agrawal & Srikant 1994).

    A term is no more frequent than the term without its last or its first word, times the ``skip + 1`` places of the word left out. So once
    ``max_features`` shorter terms are known, longer ones are counted only if both these parts are frequent enough to get among them: nearly
    all others never leave their row, and the result is the same. ``docs`` is read once for each length and should be a written table if these are several.
    """
    counted = cut_lineage(_counted(docs, words, with_rows=True).filter((F.col("df") >= spec.min_df) | F.col("term").isNull()))
    n_docs = counted.filter("term is null").agg(F.max("df")).first()[0] or 0
    top = last = counted.filter(F.col("term").isNotNull())

    def most_frequent(some: DataFrame) -> DataFrame:
        return some.filter(F.col("df") <= n_docs * spec.max_df).orderBy(F.desc("tf"), "term").limit(spec.max_features)

    top = most_frequent(top)
    for n in range(2, spec.high + 1):
        top = cut_lineage(top)
        held, least = top.agg(F.count("*"), F.min("tf")).first()
        parts = last.filter(F.col("tf") * ((spec.skip or 0) + 1) >= (least if held == spec.max_features else spec.min_df))
        frequent = bucket_test(parts, "term")
        grams = F.filter(spec.grams(F.col(words), n, n), lambda g: frequent(F.substring_index(g, " ", n - 1)) & frequent(F.substring_index(g, " ", 1 - n)))
        last = cut_lineage(_counted(computed(docs, _g=grams), "_g", with_rows=False).filter(F.col("df") >= spec.min_df))
        top = most_frequent(top.unionByName(last))
    return top.withColumn("idx", F.row_number().over(W.orderBy("term")) - 1).select("term", "idx", "df", "tf")


def count_terms(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", terms: str = "terms",
                carry: Sequence[str] = (), bounded: bool | None = True) -> DataFrame:
    """(id, term, tf) for terms of the vocabulary, which ``limit`` has bounded; nearly all others are dropped inside
    the row, and only those terms are shuffled. The rows are partitioned by document for what follows."""
    may_be_known = bucket_test(vocab, "term")
    rows = computed(docs.select(id_col, *carry, terms), _known=F.filter(terms, may_be_known)).select(id_col, *carry, F.explode("_known").alias("term"))
    hits = lookup(rows, vocab.select("term"), "term", "inner", salt=F.col(id_col), bounded=bounded)
    # A stated number of partitions is not merged at run time: merging goes by compressed bytes, of which these narrow rows have
    # few, and a task would hold many times that.
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hits.repartition(parts, id_col).groupBy(id_col, *carry, "term").agg(F.count("*").alias("tf"))


def sparse_rows(ids: DataFrame, cells: DataFrame, value: str, id_col: str = "doc_id") -> DataFrame:
    """(id, idx, val): the cells (id, idx, value) of every row of ``ids`` as two arrays, empty for rows without a cell."""
    pair = F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct(F.col("idx").cast("int").alias("i"), F.col(value).cast("double").alias("v")))))
    held = ids.select(id_col).join(cells.select(id_col, "idx", value), id_col, "left").groupBy(id_col).agg(pair.alias("_c"))
    return held.select(F.col(id_col).alias("id"), F.col("_c.i").alias("idx"), F.col("_c.v").alias("val"))


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: Column, id_col: str = "doc_id") -> DataFrame:
    """Adds ``value``: tf times smoothed idf, each document scaled to length one."""
    idf = F.log((n_docs + 1) / (F.col("df") + 1)) + 1
    weighted = counts.join(F.broadcast(vocab.select("term", "df")), "term").withColumn("_w", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(id_col)))
    return weighted.withColumn("value", F.col("_w") / norm).drop("_w", "df")


def split_train(df: DataFrame, id_col: str = "doc_id", percent: int = 50) -> DataFrame:
    """Adds ``is_train`` from a hash of the id, so a row keeps its side on every run."""
    return df.withColumn("is_train", bucket(F.col(id_col)) < percent)


def term_scales(long: DataFrame, n_docs: Column, value: str = "value") -> DataFrame:
    """(term, scale): the inter-quartile range over all documents, zeros included, or 1 if that is 0.

    A term in fewer than a quarter of the documents has both quartiles at zero, so only the few
    terms above that are put in order. ``long`` should be a written table.
    """
    present = cut_lineage(long.groupBy("term").agg(F.count("*").alias("_m")).withColumn("total", n_docs.cast("bigint")))
    frequent = present.filter(F.col("_m") > (F.col("total") - 1) * 0.25 - 1).select("term", "total")
    rows = lookup(long, frequent.select("term"), "term", "left_semi", salt=F.struct(*long.columns)).select("term", value)
    quartiles = exact_quantiles(rows, ["term"], value, (0.25, 0.75), totals=frequent)
    iqr = F.col("q1") - F.col("q0")
    return present.select("term").join(quartiles, "term", "left").select(
        "term", F.when(iqr.isNull() | (iqr == 0), 1.0).otherwise(iqr).alias("scale"))


def robust_scale(long: DataFrame, scales: DataFrame, value: str = "value") -> DataFrame:
    """Divide by the term's scale; zeros stay zeros, nothing is centred."""
    return lookup(long, scales, "term", "inner", salt=F.struct(*long.columns)).withColumn(value, F.col(value) / F.col("scale")).drop("scale")


def information_gain(long: DataFrame, docs: DataFrame, labels: Sequence, label: str = "label",
                     value: str = "tf") -> DataFrame:
    """Mutual information, in nats, between a term's value and the label.

    ``long`` holds the non-zero values with the label on every row; a term's zero cells follow
    from the label totals of ``docs``, so documents x terms is never formed.
    """
    seen = [F.count_if(F.col(label) == l).alias(f"_c{i}") for i, l in enumerate(labels)]
    n_l = [docs.agg(F.count_if(F.col(label) == l)).scalar() for l in labels]
    total = sum(n_l[1:], n_l[0])

    def part(cells: list[Column]) -> Column:
        n_v = sum(cells[1:], cells[0])
        terms = [F.when(c > 0, c / F.col("_all") * F.log(c * F.col("_all") / (n_v * F.col(f"_l{i}")))).otherwise(0.0)
                 for i, c in enumerate(cells)]
        return sum(terms[1:], terms[0])

    cells = long.groupBy("term", value).agg(*seen).select(
        "*", total.cast("double").alias("_all"), *[n.alias(f"_l{i}") for i, n in enumerate(n_l)])
    k = range(len(labels))
    per_term = cells.groupBy("term").agg(
        F.sum(part([F.col(f"_c{i}") for i in k])).alias("_gain"),
        *[(F.first(f"_l{i}") - F.sum(f"_c{i}")).alias(f"_z{i}") for i in k],
        *[F.first(f"_l{i}").alias(f"_l{i}") for i in k], F.first("_all").alias("_all"))
    gain = F.col("_gain") + part([F.col(f"_z{i}") for i in k])
    return per_term.select("term", F.greatest(gain, F.lit(0.0)).alias("gain"))


def ml_stages(vocab: DataFrame, spec: Vectorizer, n_docs: int, scales: DataFrame | None = None,
              input_col: str = "terms", output_col: str = "features") -> list:
    """Spark ML transformers equal to the long form. They work row by row and shuffle nothing;
    the vocabulary, bounded by ``max_features``, is their only driver-side state."""
    rows = vocab.orderBy("idx").collect()
    factors = {r["term"]: 1.0 for r in rows}
    if not rows:
        raise ValueError("no term meets the document-frequency bounds")
    stages = [CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol=input_col, outputCol="_tf")]
    last = "_tf"
    if spec.tfidf:
        idf = Vectors.dense([log((1 + n_docs) / (1 + r["df"])) + 1 for r in rows])
        stages += [ElementwiseProduct(scalingVec=idf, inputCol=last, outputCol="_idf"),
                   Normalizer(p=2.0, inputCol="_idf", outputCol="_norm")]
        last = "_norm"
    if scales is not None:
        factors.update({r["term"]: r["scale"] for r in scales.join(F.broadcast(vocab.select("term")), "term").collect()})
    scaling = Vectors.dense([1.0 / factors[r["term"]] for r in rows])
    stages.append(ElementwiseProduct(scalingVec=scaling, inputCol=last, outputCol=output_col))
    return stages
