"""From raw documents to packed training sequences: five stages, each working on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from opinaria.llm import decontaminate, packing, simhash, substrings, toxicity
from opinaria.llm.common import table
from opinaria.llm.queries import TOXICITY_CHAIN, tokenizer_path
from opinaria.session import cut_lineage

# Tokens and trained models have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Every stage hands whole texts to Python, so its batches are bounded by their bytes; rows alone would bound nothing where texts are long.
BATCH_BYTES = 8 << 20


def bounded_batches(run: Stage) -> Stage:
    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return run(spark, docs, sf_dir)

    return stage


@bounded_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. The chain is fitted on labelled rows of the stage's input."""
    chain = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), TOXICITY_CHAIN)
    return toxicity.score(docs, chain).where(f"not is_{TOXICITY_CHAIN[-1]}").select(docs.columns)


@bounded_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    return simhash.one_per_group(docs)


@bounded_batches
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; n_chars follows the text."""
    return substrings.without_repeats(docs).selectExpr(
        *[c if c != "n_chars" else "cast(length(text) as bigint) as n_chars" for c in docs.columns])


@bounded_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@bounded_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("substring_dedup", cut_repeated_passages),
          ("decontamination", drop_contaminated), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what a stage returns is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
