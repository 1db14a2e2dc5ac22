"""Queries over text: normalisation, filters, labels, counts and frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.functions import normalize as N
from opinaria.functions.entities import unescape_html
from opinaria.functions.stem import STEPS, stem_text
from opinaria.functions.tokens import (PORTUGUESE_KEYWORDS, bucket, format_duration, has_portuguese_keyword, long_enough, merge_title,
                                       ngrams, remove_words, removed_words, sentiment_label, words)
from opinaria.functions.translit import to_ascii
from opinaria.operators import spelling, stats
from opinaria.plans import reviews as flow
from opinaria.plans.registry import query
from opinaria.plans.views import (CLEAN, REVIEWS, SQL_STOP, STOP_WORDS, TEN_POINT, reviews, sql_hashed,
                                  sql_long_enough, sql_normalized, sql_sentiment, sql_words, table)
from opinaria.session import computed, cut_lineage, lookup

SETTINGS = flow.Settings(stop_words=STOP_WORDS, ten_point_sources=TEN_POINT)


def labelled(spark, sf_dir) -> DataFrame:
    rows = flow.clean(flow.prepare(reviews(spark, sf_dir), SETTINGS), SETTINGS)
    return flow.label(rows.filter(long_enough(F.col("text"))), SETTINGS)


@query("review_summary", f"""WITH {CLEAN}
SELECT source, sentiment, count(*) AS n, round(avg(length), 6) AS mean_length, min(length) AS shortest, max(length) AS longest
FROM labelled GROUP BY source, sentiment""")
def review_summary(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("source", "sentiment").agg(
        F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length"),
        F.min("length").cast("bigint").alias("shortest"), F.max("length").cast("bigint").alias("longest"))


@query("exact_dedup", f"""WITH {REVIEWS}
SELECT source, title, text, rating FROM reviews GROUP BY ALL""")
def exact_dedup(spark, sf_dir):
    return stats.drop_duplicate_rows(reviews(spark, sf_dir).drop("doc_id"))


@query("dedup_keep_first", f"""WITH {REVIEWS}
SELECT title, text, min(doc_id) AS doc_id FROM reviews GROUP BY title, text""")
def dedup_keep_first(spark, sf_dir):
    return stats.drop_duplicate_rows(reviews(spark, sf_dir).select("doc_id", "title", "text"), ["title", "text"], "doc_id")


@query("merge_title", f"""WITH {REVIEWS}
SELECT doc_id, coalesce(title, '') || ' ' || text AS text FROM reviews""")
def merged(spark, sf_dir):
    return reviews(spark, sf_dir).select("doc_id", merge_title(F.col("title"), F.col("text")).alias("text"))


@query("normalize_documents", f"SELECT doc_id, {sql_normalized('text')} AS text FROM documents")
def normalize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.normalize_text(F.col("text")).alias("text"))


@query("normalize_conversations", f"SELECT conv_id, turn, {sql_normalized('text')} AS text FROM conversations")
def normalize_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.normalize_text(F.col("text")).alias("text"))


@query("normalize_pages", f"SELECT page_id, {sql_normalized('html')} AS text FROM pages")
def normalize_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.normalize_text(F.col("html")).alias("text"))


@query("unescape_entities", """SELECT page_id, replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'),
  '&quot;', '"'), '&amp;', '&') AS text FROM pages""")
def unescape_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", unescape_html(F.col("html")).alias("text"))


@query("remove_tags", "SELECT page_id, regexp_replace(html, '<[^.]*>', ' ', 'g') AS text FROM pages")
def remove_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.remove_tags(F.col("html")).alias("text"))


@query("remove_tags_bounded", "SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages")
def remove_tags_bounded(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.remove_tags(F.col("html"), bounded=True).alias("text"))


@query("remove_urls", f"SELECT page_id, regexp_replace('see ' || url || ' and ' || html, '{N.URL}', ' ', 'g') AS text FROM pages")
def remove_urls(spark, sf_dir):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" and "), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", N.remove_urls(text).alias("text"))


@query("remove_words_with_digits", """SELECT event_id,
  regexp_replace(lower(event_type) || ' ' || props || ' x' || CAST(user_id AS VARCHAR) || 'y ok', '\\b[0-9a-z]*[0-9]+[0-9a-z]*\\b', ' ', 'g') AS text
FROM events""")
def remove_words_with_digits(spark, sf_dir):
    text = F.concat(F.lower("event_type"), F.lit(" "), F.col("props"), F.lit(" x"), F.col("user_id").cast("string"), F.lit("y ok"))
    return table(spark, sf_dir, "events").select("event_id", N.remove_words_with_digits(text).alias("text"))


@query("to_ascii", "SELECT doc_id, replace(strip_accents(lower(text)), 'ß', 'ss') AS text FROM documents")
def ascii_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", to_ascii(F.lower("text")).alias("text"))


@query("remove_control", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g') AS text FROM documents")
def remove_control(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.remove_control(F.col("text")).alias("text"))


_VOWELS = "lower(text)"
for _v in "aeiou":
    _VOWELS = f"regexp_replace({_VOWELS}, '{_v}{_v}+', '{_v}', 'g')"


@query("squeeze_vowels", f"SELECT doc_id, {_VOWELS} AS text FROM documents")
def squeeze_vowels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.squeeze_vowels(F.lower("text")).alias("text"))


@query("letters_and_short_words", """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text),
  '[^a-z ]', ' ', 'g'), '\\s\\s+', ' ', 'g'), '\\b[a-z][a-z]?\\b', '', 'g')) AS text FROM documents""")
def letters_and_short_words(spark, sf_dir):
    text = N.remove_short_words(N.squeeze_spaces(N.letters_only(F.lower("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("collapse_lines", """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\n\\r]', ' ', 'g'),
  '  +', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents""")
def collapse_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.collapse_lines(F.col("text")).alias("text"))


@query("remove_stop_words", f"""WITH n AS (SELECT doc_id, {sql_normalized('text')} AS t FROM documents)
SELECT doc_id, array_to_string(list_filter({sql_words('t')}, lambda w: w NOT IN ({SQL_STOP})), ' ') AS text FROM n""")
def remove_stop_words(spark, sf_dir):
    text = remove_words(N.normalize_text(F.col("text")), STOP_WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("removed_stop_words_top50", f"""WITH n AS (SELECT unnest({sql_words(sql_normalized('text'))}) AS word FROM documents)
SELECT word, count(*) AS n FROM n WHERE word IN ({SQL_STOP}) GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def removed_stop_words_top50(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    removed = computed(docs.select("text"), _w=removed_words(N.normalize_text(F.col("text")), STOP_WORDS)).select(F.explode("_w").alias("word"))
    return stats.top_n(stats.token_counts(removed), "n", "word", 50)


@query("sentiment_labels", f"WITH {REVIEWS} SELECT doc_id, rating, {sql_sentiment()} AS sentiment FROM reviews")
def sentiment_labels(spark, sf_dir):
    return reviews(spark, sf_dir).select(
        "doc_id", "rating", sentiment_label(F.col("rating"), F.col("source"), TEN_POINT).alias("sentiment"))


@query("text_length", f"WITH {REVIEWS} SELECT doc_id, length(text) AS length FROM reviews")
def text_length(spark, sf_dir):
    return reviews(spark, sf_dir).select("doc_id", F.char_length("text").cast("bigint").alias("length"))


@query("length_filter", f"""WITH n AS (SELECT doc_id, {sql_normalized('text')} AS text FROM documents)
SELECT doc_id, text FROM n WHERE {sql_long_enough('text')}""")
def length_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return computed(docs, text=N.normalize_text(F.col("text"))).filter(long_enough(F.col("text")))


@query("language_filter", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def language_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select("doc_id", "source", "n_chars")


@query("keyword_language", f"""SELECT doc_id, CASE WHEN regexp_matches(strip_accents(lower(text)),
  '\\b({'|'.join(PORTUGUESE_KEYWORDS)})\\b') THEN 'pt' ELSE lang END AS language FROM documents""")
def keyword_language(spark, sf_dir):
    folded = to_ascii(F.lower("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(has_portuguese_keyword(folded), "pt").otherwise(F.col("lang")).alias("language"))


@query("language_head", """SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 5""")
def language_head(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(5)


@query("class_subset", f"WITH {REVIEWS} SELECT doc_id, source FROM reviews WHERE {sql_sentiment()} = 'positive'")
def class_subset(spark, sf_dir):
    label = sentiment_label(F.col("rating"), F.col("source"), TEN_POINT)
    return reviews(spark, sf_dir).filter(label == "positive").select("doc_id", "source")


@query("duration_text", """SELECT event_id, CASE WHEN s IS NULL THEN '-' WHEN s > 3600 THEN printf('%.1f', s / 3600) || 'h'
  WHEN s > 60 THEN printf('%.1f', s / 60) || 'm' WHEN s >= 1 THEN printf('%.1f', s) || 's'
  ELSE printf('%.0f', s * 1000) || 'ms' END AS duration
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value * value / 7 END AS s FROM events)""")
def duration_text(spark, sf_dir):
    seconds = F.when(F.col("event_type") != "error", F.col("value") * F.col("value") / 7)
    return table(spark, sf_dir, "events").select("event_id", format_duration(seconds).alias("duration"))


@query("count_share_by_source", f"""WITH {CLEAN}
SELECT source, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM labelled GROUP BY source""")
def count_share_by_source(spark, sf_dir):
    return stats.count_share(labelled(spark, sf_dir), "source")


@query("mean_length_by_source", f"WITH {CLEAN} SELECT source, round(avg(length), 6) AS mean_length FROM labelled GROUP BY source")
def mean_length_by_source(spark, sf_dir):
    return stats.mean_by(labelled(spark, sf_dir), "source", "length").withColumn("mean_length", F.round("mean_length", 6))


@query("mean_length_by_sentiment", f"""WITH {CLEAN} SELECT sentiment, round(avg(length), 6) AS mean_length FROM labelled
GROUP BY sentiment ORDER BY sentiment DESC""")
def mean_length_by_sentiment(spark, sf_dir):
    means = stats.mean_by(labelled(spark, sf_dir), "sentiment", "length")
    return means.withColumn("mean_length", F.round("mean_length", 6)).orderBy(F.desc("sentiment"))


@query("count_by_sentiment", f"WITH {CLEAN} SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment")
def count_by_sentiment(spark, sf_dir):
    return stats.count_by(labelled(spark, sf_dir), "sentiment")


@query("count_by_source_sentiment", f"""WITH {CLEAN} SELECT source, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
  count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) AS n FROM labelled GROUP BY source ORDER BY n DESC, source""")
def count_by_source_sentiment(spark, sf_dir):
    return stats.count_by_source_sentiment(labelled(spark, sf_dir))


@query("word_frequencies", f"""WITH {CLEAN},
tokens AS (SELECT sentiment, unnest({sql_words('text')}) AS word FROM labelled)
SELECT word, CASE WHEN grouping(sentiment) = 1 THEN NULL ELSE sentiment END AS sentiment, count(*) AS n
FROM tokens GROUP BY GROUPING SETS ((word), (word, sentiment))""")
def word_frequencies(spark, sf_dir):
    return stats.word_frequencies(labelled(spark, sf_dir))


@query("unigram_counts", f"""WITH s AS (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark),
t AS (SELECT unnest({sql_words(sql_normalized('text'))}) AS term FROM s)
SELECT term, count(*) AS n FROM t GROUP BY term""")
def unigram_counts(spark, sf_dir):
    return stats.unigram_counts(corpus(spark, sf_dir))


def corpus(spark, sf_dir) -> DataFrame:
    """Sentences behind the term-count dictionaries: two corpora, concatenated and normalised."""
    both = table(spark, sf_dir, "conversations").select("text").unionByName(table(spark, sf_dir, "benchmark").select("text"))
    return computed(both, text=N.normalize_text(F.col("text")))


BIGRAMS = f"""s AS (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark),
w AS (SELECT {sql_words(sql_normalized('text'))} AS t FROM s),
pairs AS (SELECT t[i] AS w1, t[i + 1] AS w2 FROM (SELECT t, unnest(range(1, len(t))) AS i FROM w))"""


@query("bigram_counts", f"WITH {BIGRAMS} SELECT w1, w2, count(*) AS n FROM pairs GROUP BY w1, w2")
def bigram_counts(spark, sf_dir):
    return stats.bigram_counts(corpus(spark, sf_dir))


@query("stage_row_counts", f"""WITH {CLEAN}
SELECT 'loaded' AS stage, count(*) AS n FROM reviews UNION ALL SELECT 'unique', count(*) FROM unique_reviews
UNION ALL SELECT 'long enough', count(*) FROM labelled""")
def stage_row_counts(spark, sf_dir):
    """Copies are marked instead of dropped, so that one pass cleans every text once and counts all stages."""
    raw = reviews(spark, sf_dir)
    copies = stats.duplicate_ids(raw, ["source", "title", "text", "rating"], "doc_id").withColumn("copy", F.lit(True))
    marked = lookup(raw, copies, "doc_id", salt=F.col("doc_id")).withColumn("text", merge_title(F.col("title"), F.col("text"), SETTINGS.null_title))
    return stats.stage_counts(flow.clean(marked, SETTINGS), {"loaded": F.lit(True), "unique": F.col("copy").isNull(), "long enough": long_enough(F.col("text"))})


@query("bigram_arrays", f"""WITH w AS (SELECT doc_id, {sql_words(sql_normalized('text'))} AS t FROM documents)
SELECT doc_id, array_to_string(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))],
  [t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)]), '|') AS grams FROM w""")
def bigram_arrays(spark, sf_dir):
    grams = ngrams(words(N.normalize_text(F.col("text"))), 1, 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(grams, "|").alias("grams"))


@query("hash_split", f"SELECT doc_id, {sql_hashed('doc_id')} % 100 AS bucket, {sql_hashed('doc_id')} % 100 < 50 AS is_train FROM documents")
def hash_split(spark, sf_dir):
    b = bucket(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", b.alias("bucket"), (b < 50).alias("is_train"))


@query("concatenate_sources", """SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations
UNION ALL SELECT 'benchmark', text FROM benchmark""")
def concatenate_sources(spark, sf_dir):
    out = None
    for name in ("documents", "conversations", "benchmark"):
        part = table(spark, sf_dir, name).select(F.lit(name).alias("origin"), "text")
        out = part if out is None else out.unionByName(part)
    return out


@query("flatten_lists", f"""WITH w AS (SELECT conv_id, {sql_words('text')} AS t FROM conversations)
SELECT conv_id, unnest(t) AS word FROM w""")
def flatten_lists(spark, sf_dir):
    sentences = table(spark, sf_dir, "conversations").select("conv_id", F.split("text", r"\n").alias("s"))
    nested = F.transform("s", lambda line: words(line))
    return sentences.select("conv_id", F.explode(F.flatten(nested)).alias("word"))


def _sql_rules() -> str:
    """The stemmer's rule table for the oracle: step, order, suffix, shortest stem, replacement, exceptions."""
    rows = []
    for step, rules in STEPS.items():
        for i, (suffix, shortest, replacement, exceptions) in enumerate(rules):
            listed = "[" + ", ".join(f"'{e}'" for e in exceptions) + "]::VARCHAR[]"
            rows.append(f"('{step}', {i}, '{suffix}', {shortest}, '{replacement}', {listed})")
    return "rules(step, ord, suffix, shortest, replacement, exceptions) AS (VALUES " + ", ".join(rows) + ")"


def _sql_step(name: str, steps: tuple[str, ...], source: str) -> str:
    """Words of ``source`` after the first of ``steps`` with a fitting rule; within a step the first fitting rule."""
    order = "CASE step " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(steps)) + " END"
    listed = ", ".join(f"'{s}'" for s in steps)
    return f"""{name} AS (SELECT word, coalesce(min_by(substr(cur, 1, length(cur) - length(suffix)) || replacement, ({order}) * 1000 + ord)
      FILTER (WHERE suffix IS NOT NULL), any_value(cur)) AS cur
    FROM {source} LEFT JOIN (SELECT * FROM rules WHERE step IN ({listed})) r
      ON suffix(cur, r.suffix) AND length(cur) >= length(r.suffix) + shortest AND NOT list_contains(exceptions, cur)
    GROUP BY word)"""


@query("stem_vocabulary", f"""WITH {_sql_rules()},
v0 AS (SELECT DISTINCT word, word AS cur FROM (SELECT unnest({sql_words(sql_normalized('text'))}) AS word FROM documents)),
{_sql_step('v1', ('plural',), 'v0')}, {_sql_step('v2', ('adverb',), 'v1')}, {_sql_step('v3', ('feminine',), 'v2')},
{_sql_step('v4', ('augmentative',), 'v3')}, {_sql_step('v5', ('noun', 'verb', 'vowel'), 'v4')}
SELECT word, cur AS stem FROM v5""")
def stem_vocabulary(spark, sf_dir):
    docs = computed(table(spark, sf_dir, "documents").select("text"), text=N.normalize_text(F.col("text")))
    vocabulary = stats.exploded_words(docs, "text", "word").distinct()
    return vocabulary.select("word", stem_text(F.col("word")).alias("stem"))


@query("stem_texts", f"""WITH {_sql_rules()},
tokens AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {sql_words(sql_normalized('text'))} AS t FROM documents)),
v0 AS (SELECT DISTINCT word, word AS cur FROM tokens),
{_sql_step('v1', ('plural',), 'v0')}, {_sql_step('v2', ('adverb',), 'v1')}, {_sql_step('v3', ('feminine',), 'v2')},
{_sql_step('v4', ('augmentative',), 'v3')}, {_sql_step('v5', ('noun', 'verb', 'vowel'), 'v4')}
SELECT d.doc_id, coalesce(string_agg(cur, ' ' ORDER BY pos), '') AS text FROM documents d LEFT JOIN tokens ON tokens.doc_id = d.doc_id LEFT JOIN v5 USING (word) GROUP BY d.doc_id""")
def stem_texts(spark, sf_dir):
    """Every word of the documents is stemmed once; the texts take the stems from a map of their own words."""
    docs = cut_lineage(computed(table(spark, sf_dir, "documents").select("doc_id", "text"), text=N.normalize_text(F.col("text"))))
    stems = computed(spelling.vocabulary(docs).select("token"), corrected=stem_text(F.col("token"))).filter("token <> corrected")
    return spelling.correct_texts(docs, cut_lineage(stems))


@query("word_frequencies_stemmed", f"""WITH {CLEAN}, {_sql_rules()},
tokens AS (SELECT sentiment, unnest({sql_words('text')}) AS word FROM labelled), v0 AS (SELECT DISTINCT word, word AS cur FROM tokens),
{_sql_step('v1', ('plural',), 'v0')}, {_sql_step('v2', ('adverb',), 'v1')}, {_sql_step('v3', ('feminine',), 'v2')},
{_sql_step('v4', ('augmentative',), 'v3')}, {_sql_step('v5', ('noun', 'verb', 'vowel'), 'v4')}
SELECT cur AS word, CASE WHEN grouping(sentiment) = 1 THEN NULL ELSE sentiment END AS sentiment, count(*) AS n
FROM tokens JOIN v5 USING (word) WHERE cur <> '' GROUP BY GROUPING SETS ((cur), (cur, sentiment))""")
def word_frequencies_stemmed(spark, sf_dir):
    """Frequencies of stems: words are counted first, so that a word is stemmed once, not at every occurrence."""
    counted = stats.word_frequencies(labelled(spark, sf_dir))
    return computed(counted, word=stem_text(F.col("word"))).filter("word <> ''").groupBy("word", "sentiment").agg(F.sum("n").alias("n"))
