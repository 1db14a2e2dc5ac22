"""Queries of the lexicon scorer.

The test texts are not Portuguese, so the word lists are tables derived from the corpus itself: a
hash of each frequent word decides its valence, and whether it strengthens, weakens or negates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.functions.tokens import merge_title, sentiment_label
from opinaria.operators import lexicon as L
from opinaria.operators.frequent import frequent_pairs
from opinaria.plans import reviews as flow
from opinaria.plans.registry import query
from opinaria.plans.views import CLEAN, REVIEWS, STOP_WORDS, TEN_POINT, hashed, reviews, sql_hashed, sql_sentiment, table
from opinaria.session import computed, cut_lineage, shuffled

CONTRAST = ("and", "und", "et", "que")
PLAIN = L.Rules(contrast=CONTRAST, contrast_by_value=False)
BY_VALUE = L.Rules(contrast=CONTRAST, contrast_by_value=True)


def texts(spark, sf_dir) -> DataFrame:
    return reviews(spark, sf_dir).select("doc_id", merge_title(F.col("title"), F.col("text")).alias("text"))


def word_lists(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lexicon, boosters, negations) from the documents' own frequent words and word pairs."""
    toks = computed(docs.select("text"), _w=F.transform(L.tokens(L.scorer_text(F.col("text"))), lambda w: F.lower(w))).select("_w")
    counted = toks.select(F.explode("_w").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    words = cut_lineage(counted.filter((F.col("n") >= 5) & (F.length("k") >= 3)).select("k", hashed(F.col("k")).alias("h")))
    measure = (F.col("h") % 17 - 8) / 4.0
    lexicon = words.filter((F.col("h") % 3 == 0) & (measure != 0)).select(F.col("k").alias("word"), measure.alias("measure"))
    single = words.filter((F.col("h") % 29).isin(1, 2)).select(
        F.col("k").alias("phrase"), F.when(F.col("h") % 29 == 1, 0.293).otherwise(-0.293).alias("boost"))
    kind = lambda w1, w2: hashed(F.concat_ws(" ", w1, w2)) % 4
    pairs = frequent_pairs(toks, "_w", 10, lambda w1, w2: kind(w1, w2) < 2)
    phrases = pairs.select(F.concat_ws(" ", "w1", "w2").alias("phrase"), F.when(kind("w1", "w2") == 0, 0.293).otherwise(-0.293).alias("boost"))
    negations = words.filter(F.col("h") % 29 == 3).select(F.col("k").alias("phrase"))
    return lexicon, cut_lineage(single.unionByName(phrases)), negations


_STRIP = (r"^(?:(?:{i})([^[:punct:]\s]{{2,}})|([^[:punct:]\s]{{2,}})(?:{i}))$").format(
    i="|".join(sorted(("".join("\\" + c for c in p) for p in L.PUNCTUATION), key=lambda p: -len(p)))).replace("'", "''")
_FIRST_CONTRAST = "coalesce(" + ", ".join(f"nullif(list_position(lowered, '{c}'), 0)" for c in CONTRAST) + ")"


def _sql_distance(d: int) -> str:
    """Valence v<d> from v<d-1>: booster, then negation, then (at three) multi-word boosters."""
    damp = {1: "1.0", 2: "0.95", 3: "0.9"}[d]
    p = f"v{d - 1}"
    moved = (f"({p} + CASE WHEN b{d} IS NULL THEN 0 ELSE (b{d} * CASE WHEN {p} < 0 THEN -1 ELSE 1 END + CASE WHEN u{d} AND mixed_caps "
             f"THEN CASE WHEN {p} > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END) * {damp} END)")
    plain = f"{moved} * CASE WHEN n{d} THEN -0.74 ELSE 1 END"
    so1, so2 = "coalesce(k1 IN ('entao', 'este'), false)", "coalesce(k2 IN ('entao', 'este'), false)"
    if d == 1:
        value = plain
    elif d == 2:
        value = f"CASE WHEN k2 = 'nunca' AND {so1} THEN {moved} * 1.25 ELSE {plain} END"
    else:
        value = f"(CASE WHEN (k3 = 'nunca' AND {so2}) OR {so1} THEN {moved} * 1.25 ELSE {plain} END) + phrase_boost"
    return f"s{d} AS (SELECT *, CASE WHEN fpos >= {d} AND NOT known{d} THEN {value} ELSE {p} END AS v{d} FROM s{d - 1})"


_UPPER = "(w = upper(w) AND w <> lower(w))"
TOKENS = f"""{REVIEWS},
folded AS (SELECT doc_id, regexp_replace(strip_accents(title || ' ' || text), '[^\\x00-\\x7F]', '', 'g') AS t FROM reviews),
toks AS (SELECT doc_id, t, list_transform(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) > 1),
  lambda w: regexp_replace(w, '{_STRIP}', '\\1\\2')) AS words FROM folded),
info AS (SELECT doc_id, words, len(words) AS n_words,
  least(length(t) - length(replace(t, '!', '')), 4) * 0.292::DOUBLE + CASE WHEN length(t) - length(replace(t, '?', '')) > 3 THEN 0.96::DOUBLE
    WHEN length(t) - length(replace(t, '?', '')) > 1 THEN (length(t) - length(replace(t, '?', ''))) * 0.18::DOUBLE ELSE 0 END AS emphasis,
  len(list_filter(words, lambda w: {_UPPER})) > 0 AND len(list_filter(words, lambda w: {_UPPER})) < len(words) AS mixed_caps,
  list_transform(words, lambda w: lower(w)) AS lowered FROM toks),
docs AS (SELECT doc_id, words, n_words, emphasis, mixed_caps, {_FIRST_CONTRAST} - 1 AS cpos FROM info)"""

VALENCES = f"""{TOKENS},
tok AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS pos FROM docs),
tokl AS (SELECT doc_id, w, lower(w) AS k, pos, {_UPPER} AS u FROM tok),
vocab AS (SELECT k, {sql_hashed('k')} AS h FROM tokl GROUP BY k HAVING count(*) >= 5 AND length(k) >= 3),
lex AS (SELECT k, ((h % 17 - 8) / 4.0)::DOUBLE AS measure FROM vocab WHERE h % 3 = 0 AND h % 17 <> 8),
boost AS (SELECT k, CASE WHEN h % 29 = 1 THEN 0.293::DOUBLE ELSE -0.293::DOUBLE END AS b FROM vocab WHERE h % 29 IN (1, 2)),
neg AS (SELECT k FROM vocab WHERE h % 29 = 3),
pairs AS (SELECT a.k || ' ' || b.k AS phrase FROM tokl a JOIN tokl b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
phrases AS (SELECT phrase, CASE WHEN {sql_hashed('phrase')} % 4 = 0 THEN 0.293::DOUBLE ELSE -0.293::DOUBLE END AS b
  FROM pairs GROUP BY phrase HAVING count(*) >= 10 AND {sql_hashed('phrase')} % 4 < 2),
firsts AS (SELECT doc_id, w, min(pos) AS fpos FROM tok GROUP BY doc_id, w),
near AS (SELECT t.doc_id, t.pos, t.w, t.u, lex.measure, f.fpos, d.mixed_caps, d.n_words, d.emphasis, d.cpos,
    a.k AS k1, a.u AS u1, b.k AS k2, b.u AS u2, c.k AS k3, c.u AS u3
  FROM tokl t JOIN lex ON lex.k = t.k JOIN firsts f ON f.doc_id = t.doc_id AND f.w = t.w JOIN docs d ON d.doc_id = t.doc_id
  LEFT JOIN tokl a ON a.doc_id = t.doc_id AND a.pos = f.fpos - 1
  LEFT JOIN tokl b ON b.doc_id = t.doc_id AND b.pos = f.fpos - 2
  LEFT JOIN tokl c ON c.doc_id = t.doc_id AND c.pos = f.fpos - 3
  WHERE t.k NOT IN (SELECT k FROM boost)),
s0 AS (SELECT n.*, x1.b AS b1, x2.b AS b2, x3.b AS b3, l1.k IS NOT NULL AS known1, l2.k IS NOT NULL AS known2, l3.k IS NOT NULL AS known3,
    n1.k IS NOT NULL AS n1, n2.k IS NOT NULL AS n2, n3.k IS NOT NULL AS n3,
    coalesce(p32.b, 0) + coalesce(p21.b, 0) AS phrase_boost,
    n.measure + CASE WHEN n.u AND mixed_caps THEN CASE WHEN n.measure > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END AS v0
  FROM near n LEFT JOIN boost x1 ON x1.k = k1 LEFT JOIN boost x2 ON x2.k = k2 LEFT JOIN boost x3 ON x3.k = k3
  LEFT JOIN lex l1 ON l1.k = k1 LEFT JOIN lex l2 ON l2.k = k2 LEFT JOIN lex l3 ON l3.k = k3
  LEFT JOIN neg n1 ON n1.k = k1 LEFT JOIN neg n2 ON n2.k = k2 LEFT JOIN neg n3 ON n3.k = k3
  LEFT JOIN phrases p32 ON p32.phrase = k3 || ' ' || k2 LEFT JOIN phrases p21 ON p21.phrase = k2 || ' ' || k1),
{_sql_distance(1)}, {_sql_distance(2)}, {_sql_distance(3)},
valences AS (SELECT doc_id, pos, w AS word, v3 AS valence, cpos FROM s3)"""


def _sql_scores(weighted: str) -> str:
    """Scores from a CTE ``weighted(doc_id, v)``."""
    return f"""sums AS (SELECT d.doc_id, d.n_words, d.emphasis, coalesce(sum(v), 0) AS s,
  coalesce(sum(v + 1) FILTER (WHERE v > 0), 0) AS p, coalesce(sum(v - 1) FILTER (WHERE v < 0), 0) AS n,
  count(v) FILTER (WHERE v <> 0) AS hit FROM docs d LEFT JOIN {weighted} USING (doc_id) GROUP BY ALL),
total AS (SELECT *, s + CASE WHEN s > 0 THEN emphasis WHEN s < 0 THEN -emphasis ELSE 0 END AS t,
  CASE WHEN p > -n THEN p + emphasis ELSE p END AS pp, abs(CASE WHEN p < -n THEN n - emphasis ELSE n END) AS nn, n_words - hit AS z FROM sums),
scores AS (SELECT doc_id, t / sqrt(t * t + 15) AS raw_compound, CASE WHEN pp + nn + z > 0 THEN pp / (pp + nn + z) ELSE 0 END AS raw_pos,
  CASE WHEN pp + nn + z > 0 THEN nn / (pp + nn + z) ELSE 0 END AS raw_neg,
  CASE WHEN pp + nn + z > 0 THEN z / (pp + nn + z) ELSE 0 END AS raw_neu FROM total)"""


_PLAIN = f"""{VALENCES},
weighted AS (SELECT doc_id, valence * CASE WHEN pos < cpos THEN 0.5 WHEN pos > cpos THEN 1.5 ELSE 1 END AS v FROM valences),
{_sql_scores('weighted')}"""
_BY_VALUE = f"""{VALENCES},
lists AS (SELECT doc_id, cpos, list(valence ORDER BY pos) AS vs, list(pos ORDER BY pos) AS ps FROM valences WHERE cpos IS NOT NULL GROUP BY doc_id, cpos),
fold AS (SELECT doc_id, cpos, vs, ps, 1 AS i, list_position(vs, vs[1]) AS j FROM lists
  UNION ALL
  SELECT doc_id, cpos, nvs, ps, i + 1, list_position(nvs, nvs[i + 1]) FROM (SELECT *, list_transform(vs, lambda x, k: CASE WHEN k <> j THEN x
    WHEN ps[k] < cpos THEN x * 0.5 WHEN ps[k] > cpos THEN x * 1.5 ELSE x END) AS nvs FROM fold) f WHERE i <= len(vs)),
weighted AS (SELECT doc_id, unnest(vs) AS v FROM fold WHERE i = len(vs) + 1 UNION ALL SELECT doc_id, valence FROM valences WHERE cpos IS NULL),
{_sql_scores('weighted')}"""
# Shares and compound to six digits: the two engines add the valences in different orders.
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("raw_compound", "raw_pos", "raw_neg", "raw_neu"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *[F.round(c, 6).alias(c) for c in ("raw_compound", "raw_pos", "raw_neg", "raw_neu")])


def _scores(spark, sf_dir, rules: L.Rules) -> DataFrame:
    docs = texts(spark, sf_dir)
    return L.score_sentiment(docs, *word_lists(docs), rules=rules)


@query("lexicon_tokens", f"WITH {TOKENS} SELECT doc_id, array_to_string(words, ' ') AS words FROM docs")
def lexicon_tokens(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(L.tokens(L.scorer_text(F.col("text"))), " ").alias("words"))


@query("lexicon_emphasis", f"WITH {TOKENS} SELECT doc_id, n_words, mixed_caps, round(emphasis, 6) AS emphasis FROM docs")
def lexicon_emphasis(spark, sf_dir):
    docs = computed(texts(spark, sf_dir), text=L.scorer_text(F.col("text")))
    docs = computed(docs, w=L.tokens(F.col("text")), emphasis=F.round(L.punctuation_emphasis(F.col("text")), 6))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n_words"), L.partly_upper(F.col("w")).alias("mixed_caps"), "emphasis")


@query("lexicon_valences", f"WITH {VALENCES} SELECT doc_id, pos, word, round(valence, 6) AS valence FROM valences")
def lexicon_valences(spark, sf_dir):
    docs = texts(spark, sf_dir)
    rows = L.token_valences(docs, *word_lists(docs), rules=PLAIN).filter("pos >= 0")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "word", F.round("valence", 6).alias("valence"))


@query("lexicon_scores_plain_contrast", f"WITH {_PLAIN} SELECT doc_id, {_ROUNDED} FROM scores")
def lexicon_scores_plain_contrast(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir, PLAIN))


@query("lexicon_scores", f"WITH RECURSIVE {_BY_VALUE} SELECT doc_id, {_ROUNDED} FROM scores")
def lexicon_scores(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir, BY_VALUE))


@query("lexicon_scores_rounded", f"""WITH RECURSIVE {_BY_VALUE} SELECT doc_id, CAST(printf('%.4f', raw_compound) AS DOUBLE) AS compound,
  CAST(printf('%.3f', raw_pos) AS DOUBLE) AS pos, CAST(printf('%.3f', raw_neg) AS DOUBLE) AS neg, CAST(printf('%.3f', raw_neu) AS DOUBLE) AS neu FROM scores""")
def lexicon_scores_rounded(spark, sf_dir):
    return _scores(spark, sf_dir, BY_VALUE).select("doc_id", "compound", "pos", "neg", "neu")


@query("lexicon_labels", f"""WITH RECURSIVE {_BY_VALUE} SELECT doc_id, CASE WHEN round(raw_compound, 4) >= 0 THEN 'positive' ELSE 'negative' END AS leia FROM scores""")
def lexicon_labels(spark, sf_dir):
    return _scores(spark, sf_dir, BY_VALUE).select("doc_id", L.lexicon_label(F.col("compound")).alias("leia"))


@query("lexicon_accuracy", f"""WITH RECURSIVE {_BY_VALUE} SELECT count(*) AS n, round(avg(CASE WHEN
  (CASE WHEN round(raw_compound, 4) >= 0 THEN 'positive' ELSE 'negative' END) = ({sql_sentiment('r.rating', 'r.source')}) THEN 1 ELSE 0 END), 6) AS accuracy
FROM scores JOIN reviews r USING (doc_id)""")
def lexicon_accuracy(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("doc_id", sentiment_label(F.col("rating"), F.col("source"), TEN_POINT).alias("sentiment"))
    both = lexicon_labels(spark, sf_dir).join(shuffled(rows), "doc_id")
    return both.agg(F.count("*").alias("n"), F.round(F.avg((F.col("leia") == F.col("sentiment")).cast("int")), 6).alias("accuracy"))


@query("review_flow_plain", f"""WITH RECURSIVE {_BY_VALUE}{CLEAN.removeprefix(REVIEWS)}
SELECT l.doc_id, l.source, l.rating, l.text, l.sentiment, l.length, CASE WHEN round(raw_compound, 4) >= 0 THEN 'positive' ELSE 'negative' END AS leia
FROM labelled l JOIN scores USING (doc_id)""")
def review_flow_plain(spark, sf_dir):
    """The flow over all documents without spelling, language and stemming: copies dropped, scored raw, cleaned, filtered, labelled."""
    settings = flow.Settings(stop_words=STOP_WORDS, ten_point_sources=TEN_POINT, stem=False, rules=BY_VALUE)
    rows = flow.review_table(reviews(spark, sf_dir), *word_lists(texts(spark, sf_dir)), settings=settings)
    return rows.select("doc_id", "source", "rating", "text", "sentiment", F.col("length").cast("bigint").alias("length"), "leia")


_EMOJI = f"""{REVIEWS},
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM
  (SELECT doc_id, list_filter(regexp_split_to_array(trim(title || ' ' || text), '\\s+'), lambda w: w <> '') AS ws FROM reviews)),
emoji AS (SELECT DISTINCT w AS emoji, 'is ' || length(w) AS description FROM tok WHERE {sql_hashed('w')} % 11 = 0)"""


@query("emoji_to_words", f"""WITH {_EMOJI} SELECT r.doc_id, coalesce(string_agg(coalesce(description, w), ' ' ORDER BY pos), '') AS text
FROM reviews r LEFT JOIN tok USING (doc_id) LEFT JOIN emoji ON emoji = w GROUP BY r.doc_id""")
def emoji_to_words(spark, sf_dir):
    docs = texts(spark, sf_dir)
    toks = computed(docs.select("text"), _w=F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).select(F.explode("_w").alias("emoji")).distinct()
    emoji = toks.filter(hashed(F.col("emoji")) % 11 == 0).select("emoji", F.concat(F.lit("is "), F.length("emoji").cast("string")).alias("description"))
    return L.replace_emoji(docs, cut_lineage(emoji))


# Signs whose decomposition is one or several ASCII signs, put into the texts by id.
_SIGNS = {"\u00a0": " ", "\u202f": " ", "\u3000": " ", "\u2026": "...", "\u2122": "TM", "\ufb01": "fi", "\uff01": "!", "\u00bd": "12"}


def _signed(col: Column, id_col: str) -> Column:
    out = col
    for k, sign in enumerate(_SIGNS):
        out = F.when(F.col(id_col) % len(_SIGNS) == k, F.replace(F.replace(col, F.lit(" th"), F.lit(f"{sign}th")), F.lit(". "), F.lit(f".{sign}"))).otherwise(out)
    return out


@query("scorer_texts_with_signs", "SELECT doc_id, regexp_replace(strip_accents(CASE " + " ".join(
    f"WHEN doc_id % {len(_SIGNS)} = {k} THEN replace(replace(text, ' th', '{ascii_}th'), '. ', '.{ascii_}')" for k, ascii_ in enumerate(_SIGNS.values()))
    + " END), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents")
def scorer_texts_with_signs(spark, sf_dir):
    """What the scorer reads: special spaces, dots, ligatures and trade marks become their ASCII signs."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", L.scorer_text(_signed(F.col("text"), "doc_id")).alias("folded"))
