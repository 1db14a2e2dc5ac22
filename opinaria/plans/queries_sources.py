"""Queries of the sources and sinks. Payloads and files are built by Spark from the given tables, written
to the shared folder where a file is the point, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.functions.normalize import normalize_text
from opinaria.functions.tokens import words
from opinaria.operators import stats
from opinaria.plans.queries_evaluation import RESULTS, results
from opinaria.plans.queries_text import BIGRAMS, corpus, labelled
from opinaria.plans.registry import query
from opinaria.plans.views import CLEAN, REVIEWS, STOP_WORDS, hashed, reviews, sql_hashed, sql_normalized, sql_words, table
from opinaria.session import computed, shared_dir
from opinaria.sources import dictionaries as D, page_ids as P, payloads as J, reviews as S

_TRIMMED = ("regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '[\\n\\r]', ' ', 'g'), '  +', ' ', 'g'), "
            "'^\\s+|\\s+$', '', 'g')")


@query("csv_round_trip", f"""WITH {REVIEWS} SELECT source, nullif({_TRIMMED.format('title')}, '') AS title,
  nullif({_TRIMMED.format('text')}, '') AS text, rating FROM reviews""")
def csv_round_trip(spark, sf_dir):
    path = shared_dir(spark)
    rows = reviews(spark, sf_dir)
    S.append_reviews_csv(rows.filter("doc_id % 2 = 0"), path)
    S.append_reviews_csv(rows.filter("doc_id % 2 = 1"), path)
    return S.read_reviews_csv(spark, path)


@query("csv_raw_texts", f"WITH {REVIEWS} SELECT source, nullif(title, '') AS title, nullif(text, '') AS text, rating FROM reviews")
def csv_raw_texts(spark, sf_dir):
    """Texts with line breaks and quotes as they are, through the CSV scan alone."""
    path = shared_dir(spark)
    quoting = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true", "emptyValue": "",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    reviews(spark, sf_dir).select("source", "title", "text", "rating").write.options(**quoting).csv(path)
    return S.read_reviews_csv(spark, path, multi_line=True)


@query("materialized_reviews", f"WITH {CLEAN} SELECT doc_id, source, rating, text, sentiment, length FROM labelled")
def materialized_reviews(spark, sf_dir):
    out = S.read_or_build(spark, shared_dir(spark), lambda: labelled(spark, sf_dir))
    return out.withColumn("length", F.col("length").cast("bigint"))


@query("materialized_results", f"WITH {RESULTS} SELECT * FROM results")
def materialized_results(spark, sf_dir):
    path = shared_dir(spark)
    S.read_or_build(spark, path, lambda: results(spark, sf_dir))
    return S.read_or_build(spark, path, lambda: results(spark, sf_dir).limit(0))


def _payload(spark, sf_dir, build) -> DataFrame:
    """One payload per document; every seventh lacks its list and every eleventh is cut off."""
    rows = reviews(spark, sf_dir)
    json = F.to_json(build(F.struct("title", "text", "rating")))
    broken = F.left(json, F.lit(20))
    return rows.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "{}").when(F.col("doc_id") % 11 == 0, broken).otherwise(json).alias("payload"))


def _sql_payload(title: str = "title", second: bool = True) -> str:
    base = f"SELECT doc_id, {title} AS title, text, rating FROM reviews WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0"
    twice = f" UNION ALL SELECT doc_id, 'again', text, rating FROM reviews WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0" if second else ""
    return f"WITH {REVIEWS} {base}{twice}"


def _list(names: tuple[str, str, str]):
    """Two reviews per payload under the site's field names."""
    def make(r) -> F.Column:
        def item(title):
            return F.struct(title.alias(names[0]), r["text"].alias(names[1]), r["rating"].alias(names[2]))
        return F.array(item(r["title"]), item(F.lit("again")))
    return make


def _b2w(r):
    return F.struct(_list(("Title", "ReviewText", "Rating"))(r).alias("Results"), F.lit(2).alias("TotalResults"))


def _extra(r):
    return F.struct(F.struct(F.lit(2).alias("quantidadeAvaliacoes"), _list(("titulo", "descricao", "nota"))(r).alias("avaliacoes")).alias("avaliacao"))


def _magalu(r):
    return F.struct(F.struct(F.lit(1).alias("pages"), _list(("title", "review_text", "rating"))(r).alias("objects")).alias("data"))


def _reclame_aqui(r):
    return F.struct(F.struct(F.struct(_list(("evaluation", "description", "score"))(r).alias("data")).alias("complains")).alias("complainResult"))


# Sites whose payload lists reviews: name in the rows and payload of a review.
LISTED = {"b2w": ("B2W", _b2w), "extra": ("Extra", _extra), "magalu": ("Magalu", _magalu), "reclame_aqui": ("ReclameAqui", _reclame_aqui)}


@query("b2w_payloads", _sql_payload())
def b2w_payloads(spark, sf_dir):
    return J.parse_site(_payload(spark, sf_dir, _b2w), "b2w").drop("source")


@query("extra_payloads", _sql_payload())
def extra_payloads(spark, sf_dir):
    return J.parse_site(_payload(spark, sf_dir, _extra), "extra").drop("source")


@query("extra_payloads_without_count", f"WITH {REVIEWS} SELECT doc_id, title, text, rating FROM reviews WHERE doc_id % 2 = 0")
def extra_payloads_without_count(spark, sf_dir):
    """A payload whose count is null gives no rows, list or not."""
    rows = reviews(spark, sf_dir)
    item = F.struct(F.col("title").alias("titulo"), F.col("text").alias("descricao"), F.col("rating").alias("nota"))
    count = F.when(F.col("doc_id") % 2 == 0, 1)
    payload = F.to_json(F.struct(F.struct(count.alias("quantidadeAvaliacoes"), F.array(item).alias("avaliacoes")).alias("avaliacao")))
    return J.parse_site(rows.select("doc_id", payload.alias("payload")), "extra").drop("source")


@query("magalu_payloads", _sql_payload())
def magalu_payloads(spark, sf_dir):
    return J.parse_site(_payload(spark, sf_dir, _magalu), "magalu").drop("source")


@query("reclame_aqui_payloads", _sql_payload())
def reclame_aqui_payloads(spark, sf_dir):
    return J.parse_site(_payload(spark, sf_dir, _reclame_aqui), "reclame_aqui").drop("source")


def _zomato(spark, sf_dir) -> DataFrame:
    def build(r):
        rating_id = F.col("doc_id") * 10
        review = F.struct(r["text"].alias("reviewText"), F.struct(F.array(F.struct(F.array(rating_id).alias("entity_ids"))).alias("entities")).alias("rating"))
        listed = F.when(F.col("doc_id") % 5 == 0, rating_id + 1).otherwise(rating_id)
        return F.struct(F.struct(F.create_map(F.col("doc_id").cast("string"), review).alias("REVIEWS"),
                                 F.create_map(listed.cast("string"), F.struct(r["rating"].alias("rating"))).alias("RATING")).alias("entities"))
    return _payload(spark, sf_dir, build)


@query("zomato_payloads", f"""WITH {REVIEWS} SELECT doc_id, '' AS title, text, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE rating END AS rating
FROM reviews WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0""")
def zomato_payloads(spark, sf_dir):
    return J.parse_site(_zomato(spark, sf_dir), "zomato").drop("source")


_ALL_SITES = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS source, {title} AS title, text, rating FROM good" for name, _ in LISTED.values() for title in ("title", "'again'")) + """
UNION ALL SELECT doc_id, 'Zomato', '', text, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE rating END FROM good"""


@query("all_payloads", f"""WITH {REVIEWS}, good AS (SELECT * FROM reviews WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0)
{_ALL_SITES}""")
def all_payloads(spark, sf_dir):
    return J.parse_payloads(site_payloads(spark, sf_dir))


def site_payloads(spark, sf_dir) -> DataFrame:
    """Payloads of all five sites."""
    rows = _zomato(spark, sf_dir).select("doc_id", F.lit("zomato").alias("site"), "payload")
    for site, (_, build) in LISTED.items():
        rows = rows.unionByName(_payload(spark, sf_dir, build).select("doc_id", F.lit(site).alias("site"), "payload"))
    return rows.select("site", "payload", "doc_id")


@query("search_product_ids", """SELECT page_id, 'p' || page_id AS product_id FROM pages UNION ALL SELECT page_id, 'q' || length(url) FROM pages""")
def search_product_ids(spark, sf_dir):
    ids = F.array(F.struct(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id")),
                  F.struct(F.concat(F.lit("q"), F.length("url").cast("string")).alias("id")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(ids.alias("products"))).alias("payload"))
    return J.b2w_product_ids(rows)


def _shop_pages(spark, sf_dir) -> DataFrame:
    """The given pages with the scripts and elements product pages carry put before their markup; what they carry differs from page to page."""
    page, number = F.col("page_id"), F.col("page_id").cast("string")

    def script(kind: str, *body: Column) -> Column:
        return F.concat(F.lit(f'<script async type="{kind}">'), *body, F.lit("</script>"))

    sku = script("application/ld+json", F.lit('{"@type": "Product",\n "sku": "'), number, F.lit('"}'))
    second = F.when(page % 4 == 1, script("application/ld+json", F.lit('{"sku": '), number, F.lit(', "offers": {"sku": "inner"}}'))).otherwise(F.lit(""))
    no_sku = F.lit('<script type="application/ld+json">{"@type": "Organization"}</script>')
    json_ld = F.concat(F.when(page % 5 == 0, no_sku).when(page % 7 == 3, script("application/ld+json", F.lit('{"sku": "unread", "name": }')))
                       .otherwise(sku), no_sku, second)
    listed = F.transform(F.sequence(F.lit(0), (page % 3).cast("int")), lambda k: F.concat(F.lit('{"idProduct": '), (page + 7 * k).cast("string"), F.lit("}")))
    meta = F.when(page % 4 == 2, script("text/javascript", F.lit("var siteData = 1;"))).otherwise(script(
        "text/javascript", F.lit('var a = 1;\nsiteMetadata = {"page": {"listItems": ['), F.array_join(listed, ", "), F.lit("]}};  ")))
    hit = F.concat(F.when(page % 3 == 0, F.concat(F.lit('<li data-res_id="s'), number, F.lit('"\n class="js-search-result-li">a</li>'))).otherwise(F.lit("")),
                   F.when(page % 4 != 0, F.concat(F.lit('<div data-x="1" class="card js-search-result-li even" data-res_id="r'), number, F.lit('">a</div>')))
                   .otherwise(F.lit('<div class="js-search-result-link" data-res_id="no">a</div>')),
                   F.lit('<div class="other" data-res_id="no">b</div>'))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(json_ld, meta, hit, F.col("html")).alias("html"))


@query("json_ld_skus", """SELECT page_id, CAST(page_id AS VARCHAR) AS product_id FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 3
UNION ALL SELECT page_id, CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 4 = 1""")
def json_ld_skus(spark, sf_dir):
    return P.json_ld_skus(_shop_pages(spark, sf_dir))


@query("metadata_product_ids", """SELECT page_id, CAST(page_id + 7 * k AS VARCHAR) AS product_id
FROM (SELECT page_id, unnest(range(1 + page_id % 3)) AS k FROM pages WHERE page_id % 4 <> 2)""")
def metadata_product_ids(spark, sf_dir):
    return P.metadata_product_ids(_shop_pages(spark, sf_dir))


@query("attribute_ids", """SELECT page_id, 's' || page_id AS value FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'r' || page_id FROM pages WHERE page_id % 4 <> 0""")
def attribute_ids(spark, sf_dir):
    return P.attribute_values(_shop_pages(spark, sf_dir), "js-search-result-li", "data-res_id")


@query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark, sf_dir):
    return P.first_group(table(spark, sf_dir, "pages").select("page_id", "html"), r'<a href="([^"]*)"', "href")


@query("page_tracking_ids", r"""SELECT page_id, unnest(regexp_extract_all(html, '<script>.*?track\((\d+)\)', 1)) AS track_id,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages""")
def page_tracking_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"), "html")
    return P.first_group(rows, r"<script>.*?track\((\d+)\)", "track_id")


_FREQUENT = f"""w AS (SELECT unnest({sql_words(sql_normalized('text'))}) AS word FROM conversations),
frequent AS (SELECT word, {sql_hashed('word')} AS h FROM w GROUP BY word HAVING count(*) >= 3)"""


def _frequent(spark, sf_dir) -> DataFrame:
    rows = computed(table(spark, sf_dir, "conversations").select("text"), text=normalize_text(F.col("text")))
    counted = stats.token_counts(stats.exploded_words(rows, "text", "word"))
    return counted.filter("n >= 3").select("word", hashed(F.col("word")).alias("h"))


@query("lexicon_file", f"WITH {_FREQUENT} SELECT word, (h % 9 - 4)::DOUBLE AS measure FROM frequent")
def lexicon_file(spark, sf_dir):
    """Tab-separated lines with an extra column; repeated words agree."""
    path = shared_dir(spark)
    rows = _frequent(spark, sf_dir).select(F.concat_ws("\t", "word", (F.col("h") % 9 - 4).cast("string"), F.lit("[1, 2]")).alias("value"))
    rows.unionByName(rows).write.text(path)
    return D.read_lexicon(spark, path)


@query("emoji_file", f"WITH {_FREQUENT} SELECT ':' || word AS emoji, 'face ' || word AS description FROM frequent")
def emoji_file(spark, sf_dir):
    path = shared_dir(spark)
    _frequent(spark, sf_dir).select(F.concat_ws("\t", F.concat(F.lit(":"), "word"), F.concat(F.lit("face "), "word")).alias("value")).write.text(path)
    return D.read_emoji_lexicon(spark, path)


@query("booster_file", f"WITH {_FREQUENT} SELECT 'mais ' || word AS phrase, CASE WHEN h % 2 = 0 THEN 0.293::DOUBLE ELSE -0.293::DOUBLE END AS boost FROM frequent")
def booster_file(spark, sf_dir):
    path = shared_dir(spark)
    kind = F.when(F.col("h") % 2 == 0, "INCR").otherwise("DECR")
    _frequent(spark, sf_dir).select(F.concat_ws(" ", F.lit("mais"), "word", kind).alias("value")).write.text(path)
    return D.read_boosters(spark, path)


@query("negation_file", f"WITH {_FREQUENT} SELECT word AS phrase FROM frequent")
def negation_file(spark, sf_dir):
    path = shared_dir(spark)
    _frequent(spark, sf_dir).select(F.concat(F.lit("  "), "word", F.lit(" ")).alias("value")).write.text(path)
    return D.read_negations(spark, path)


_MANDATORY = ", ".join(f"('{w}')" for w in (*D.MANDATORY, "DECR"))


@query("stop_word_set", f"""WITH {_FREQUENT}, base AS (SELECT word FROM frequent UNION ALL SELECT upper(word) FROM frequent WHERE h % 2 = 0
  UNION ALL SELECT 'bom' FROM frequent),
must AS (SELECT unnest(string_split('muito ' || word, ' ')) AS word FROM frequent WHERE h % 5 = 0 UNION ALL SELECT * FROM (VALUES {_MANDATORY}))
SELECT DISTINCT word FROM (SELECT {sql_normalized('word')} AS word FROM base) WHERE word NOT IN (SELECT word FROM must)""")
def stop_word_set(spark, sf_dir):
    rows = _frequent(spark, sf_dir)
    base = rows.select("word").union(rows.filter("h % 2 = 0").select(F.upper("word"))).union(rows.select(F.lit("bom")))
    boosters = rows.filter("h % 5 = 0").select(F.concat(F.lit("muito "), "word").alias("phrase"))
    return D.stop_words(base, boosters)


@query("unigram_file", f"""WITH s AS (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark),
t AS (SELECT unnest({sql_words(sql_normalized('text'))}) AS term FROM s) SELECT term, count(*) AS n FROM t GROUP BY term""")
def unigram_file(spark, sf_dir):
    path = shared_dir(spark)
    D.write_term_counts(stats.unigram_counts(corpus(spark, sf_dir)), path)
    return D.read_unigrams(spark, path)


@query("bigram_file", f"WITH {BIGRAMS} SELECT w1, w2, count(*) AS n FROM pairs GROUP BY w1, w2")
def bigram_file(spark, sf_dir):
    path = shared_dir(spark)
    D.write_term_counts(stats.bigram_counts(corpus(spark, sf_dir)), path)
    return D.read_bigrams(spark, path)


@query("words_not_in_stop_list", f"""WITH t AS (SELECT unnest({sql_words(sql_normalized('text'))}) AS word FROM conversations)
SELECT word, count(*) AS n FROM t WHERE word NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY word""")
def words_not_in_stop_list(spark, sf_dir):
    """The table form of stop-word removal: a broadcast anti join on the exploded words."""
    rows = computed(table(spark, sf_dir, "conversations").select("text"), _w=words(normalize_text(F.col("text"))))
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    kept = rows.select(F.explode("_w").alias("word")).join(F.broadcast(stop), "word", "left_anti")
    return stats.token_counts(kept)


@query("streamed_payloads", f"""WITH {REVIEWS}, good AS (SELECT * FROM reviews WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0),
rows AS ({_ALL_SITES})
SELECT source, {_TRIMMED.format('title')} AS title, {_TRIMMED.format('text')} AS text, rating FROM rows""")
def streamed_payloads(spark, sf_dir):
    """Payload files through the streaming sink, then the table it wrote."""
    from opinaria import schemas
    from opinaria.streaming.ingest import ingest
    base = shared_dir(spark)
    site_payloads(spark, sf_dir).drop("doc_id").write.json(f"{base}/in")
    ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(schemas.REVIEW).parquet(f"{base}/out")
