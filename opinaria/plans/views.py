"""Input views over the given tables, in Spark and as SQL fragments for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinaria.functions import normalize as N
from opinaria.functions.tokens import bucket
from opinaria.session import spread

WIDE = 1 << 32


TEXT_TABLES = ("documents", "pages", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Work on text and vectors is heavy per row; a single-split test file would keep one core busy.
    return spread(df) if name in TEXT_TABLES else df


def hashed(value: Column) -> Column:
    return bucket(value, WIDE)


def sql_hashed(expr: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8)) AS UBIGINT)::BIGINT"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews: first line the title, the rest the text, a rating hashed from the text.
    Ratings of ``src0`` run from 0 to 10, all others from 1 to 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = F.instr("text", "\n")
    h = hashed(F.col("text"))
    return docs.select(
        "doc_id", "source",
        F.when(cut > 0, F.left("text", cut - 1)).otherwise(F.col("text")).alias("title"),
        F.when(cut > 0, F.substr("text", cut + 1)).otherwise(F.lit("")).alias("text"),
        F.when(F.col("source") == "src0", h % 11).otherwise(1 + h % 5).cast("double").alias("rating"))


REVIEWS = f"""reviews AS (
  SELECT doc_id, source,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS text,
    CAST(CASE WHEN source = 'src0' THEN {sql_hashed('text')} % 11 ELSE 1 + {sql_hashed('text')} % 5 END AS DOUBLE) AS rating
  FROM documents)"""

TEN_POINT = ("src0",)


# Fixed value: the word with a digit, without the Unicode boundaries the other engine lacks.
SQL_WORD_WITH_DIGIT = r"\b[0-9a-z]*[0-9]+[0-9a-z]*\b"


def sql_normalized(expr: str) -> str:
    """The normalisation chain in the other engine's dialect; it has neither back-references
    nor Unicode word boundaries, and the data hold only the entities listed."""
    s = f"lower(coalesce({expr}, ''))"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        s = f"replace({s}, '{name}', '{char}')"
    for pattern in (N.TAG, N.URL, SQL_WORD_WITH_DIGIT):
        s = f"regexp_replace({s}, '{pattern}', ' ', 'g')"
    s = f"replace(replace(strip_accents({s}), 'ß', 'ss'), '©', '(c)')"
    s = f"regexp_replace({s}, '[\\x00-\\x1F\\x7F]', '', 'g')"
    s = f"regexp_replace({s}, '[^a-z ]', ' ', 'g')"
    s = f"regexp_replace({s}, '\\s\\s+', ' ', 'g')"
    for vowel in "aeiou":
        s = f"regexp_replace({s}, '{vowel}{vowel}+', '{vowel}', 'g')"
    return f"trim(regexp_replace({s}, '\\b[a-z][a-z]?\\b', '', 'g'))"


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda w: w <> '')"


# The stop list of the queries: frequent words of the test tables' four languages.
STOP_WORDS = (
    "the", "and", "that", "for", "was", "with", "this", "are", "from", "der", "die", "und", "den",
    "von", "das", "mit", "sich", "auf", "que", "les", "des", "une", "pour", "qui", "dans", "los",
    "las", "del", "por", "con",
)
SQL_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_without_stop(expr: str) -> str:
    return f"array_to_string(list_filter({sql_words(expr)}, lambda w: w NOT IN ({SQL_STOP})), ' ')"


def sql_sentiment(rating: str = "rating", source: str = "source") -> str:
    scaled = f"(CASE WHEN {source} = 'src0' THEN {rating} / 2 ELSE {rating} END)"
    return f"CASE WHEN {scaled} < 3 THEN 'negative' WHEN {scaled} >= 3 THEN 'positive' END"


def sql_long_enough(expr: str) -> str:
    return f"(length({expr}) > 10 AND length({expr}) - length(replace({expr}, ' ', '')) >= 4)"


# Deduplicated, merged, normalised, without stop words, filtered and labelled.
CLEAN = f"""{REVIEWS},
unique_reviews AS (SELECT source, title, text, rating, min(doc_id) AS doc_id FROM reviews GROUP BY ALL),
clean AS (
  SELECT doc_id, source, rating, {sql_without_stop(sql_normalized("title || ' ' || text"))} AS text FROM unique_reviews),
labelled AS (
  SELECT doc_id, source, rating, text, {sql_sentiment()} AS sentiment, length(text) AS length
  FROM clean WHERE {sql_long_enough('text')})"""
