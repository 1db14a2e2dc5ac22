"""Lexicons, boosters, negations, stop words and term-count dictionaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinaria import schemas
from opinaria.functions.normalize import normalize_text

# The strength of a booster, and the words no stop list may remove.
BOOST = 0.293
MANDATORY = ("nao", "boa", "bom", "bem", "ruim", "muita", "pouca", "pouco", "maximo", "tanta",
             "nunca", "falta", "nenhuma", "obrigado", "obrigada")

# Degree phrases that strengthen or weaken the word after them.
INCREASING = (
    "absolutamente", "agitadamente", "altamente", "bastante", "completamente", "consideravelmente",
    "decididamente", "demais", "enormemente", "especialmente", "excecivamente", "excepcionalmente",
    "extremamente", "fabulosamente", "fortemente", "fudidamente", "grandemente", "grandiosamente",
    "incrivelmente", "inteiramente", "intensamente", "majoritariamente", "muito mais", "muito muito",
    "na moral", "o mais", "particularmente", "pra caramba", "pra valer", "predominantemente",
    "profundamente", "puramente", "realmente", "substancialmente", "super", "surpreendentemente",
    "tao", "terrivelmente", "tremendamente", "tão",
)
DECREASING = (
    "algo", "bem pouco", "bem pouqinho", "bem pouquinho", "dificilmente", "escassamente",
    "fracamente", "horrivelmente", "levemente", "mais ou menos", "muito menos", "muito pouco",
    "ocasionalmente", "parcialmente", "pouco", "pouqinho", "pouquinho", "quase", "so o necessario",
    "superficialmente", "tantinho", "tipo", "um pouco", "um pouqinho", "um pouquinho",
    "um tantinho", "um tanto",
)
# Negating words and phrases.
NEGATIONS = (
    "dificilmente", "nao", "nao consegue", "nao conseguem", "nao conseguiam", "nao conseguirei",
    "nao conseguiriam", "nao consigo", "nao devem", "nao deverao", "nao deveriam", "nao devo",
    "nao e", "nao eh", "nao eram", "nao estao", "nao estarao", "nao estariam", "nao estavam",
    "nao estiveram", "nao farao", "nao farei", "nao faz", "nao faziam", "nao fez", "nao fiz",
    "nao ousa", "nao ousam", "nao ousarao", "nao ousariam", "nao ouso", "nao poderei",
    "nao poderia", "nao podia", "nao posso", "nao sao", "nao serao", "nao serei", "nao seriam",
    "nao sou", "nao tem", "nao tenho", "nao terei", "nao teria", "nao tinha", "nope", "raramente",
)


def boosters(spark: SparkSession) -> DataFrame:
    rows = [(p, BOOST) for p in INCREASING] + [(p, -BOOST) for p in DECREASING]
    return spark.createDataFrame(rows, "phrase string, boost double")


def negations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in NEGATIONS], "phrase string")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file name, offset of the block, order within the block. Files of a folder count in the order of their
    names, however Spark deals them to tasks."""
    return spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line"))


def _two_columns(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """First two tab-separated columns; the last line of a repeated key wins."""
    parts = F.split(F.trim("value"), "\t")
    rows = _numbered_lines(spark, path).select(
        F.get(parts, F.lit(0)).alias(key), F.get(parts, F.lit(1)).alias(value), "line")
    return (rows.filter(F.col(value).isNotNull())
            .groupBy(key).agg(F.max_by(value, "line").alias(value)))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    rows = _two_columns(spark, path, "word", "measure")
    return schemas.require(rows.withColumn("measure", F.col("measure").cast("double")), schemas.LEXICON)


def read_emoji_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return schemas.require(_two_columns(spark, path, "emoji", "description"), schemas.EMOJI)


def read_boosters(spark: SparkSession, path: str) -> DataFrame:
    """``phrase CLASS`` lines: INCR strengthens, anything else weakens."""
    line = F.trim("value")
    return spark.read.text(path).filter(line != "").select(
        F.regexp_extract(line, r"^(.*) (\S+)$", 1).alias("phrase"),
        F.when(F.regexp_extract(line, r"^(.*) (\S+)$", 2) == "INCR", BOOST).otherwise(-BOOST).alias("boost"))


def read_negations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("phrase")).filter("phrase <> ''")


def mandatory_words(boosters: DataFrame) -> DataFrame:
    """Every word of the booster file, its weakening mark included, plus the fixed list."""
    phrase_words = boosters.select(F.explode(F.split("phrase", " ")).alias("word"))
    fixed = boosters.sparkSession.createDataFrame([(w,) for w in (*MANDATORY, "DECR")], "word string")
    return phrase_words.union(fixed).distinct()


def stop_words(base: DataFrame, boosters: DataFrame) -> DataFrame:
    """Normalised, distinct words of ``base`` minus the mandatory words."""
    return (base.select(normalize_text(F.col("word")).alias("word")).distinct()
            .join(F.broadcast(mandatory_words(boosters)), "word", "left_anti"))


def portuguese_stop_words(spark: SparkSession, extra: Iterable[str] = ()) -> DataFrame:
    words = [*StopWordsRemover.loadDefaultStopWords("portuguese"), *extra]
    return stop_words(spark.createDataFrame([(w,) for w in words], "word string"), boosters(spark))


def read_unigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.UNIGRAMS).csv(path, sep=" ")


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BIGRAMS).csv(path, sep=" ")


def write_term_counts(df: DataFrame, path: str) -> None:
    """``term n`` or ``w1 w2 n`` lines."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]).alias("value")) \
        .write.mode("overwrite").text(path)
