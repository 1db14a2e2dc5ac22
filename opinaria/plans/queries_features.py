"""Queries of the feature operators: n-grams, vocabularies, TF-IDF, gain, scaling, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.functions.normalize import normalize_text
from opinaria.functions.tokens import skip_ngrams, vector_tokens
from opinaria.operators import neighbors, vectorize as V
from opinaria.plans.registry import query
from opinaria.plans.views import sql_hashed, sql_normalized, sql_words, table
from opinaria.session import computed, cut_lineage

_GRAMS = {
    1: "t",
    2: "list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])",
    3: ("list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))], "
        "[t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)])"),
}
# Skip-grams need a head and tokens at growing distances within n - 1 + 2.
_SKIP2 = "[t[i] || ' ' || t[j] FOR i IN range(1, len(t))  FOR j IN range(i + 1, least(i + 3, len(t)) + 1)]"


def _sql_tokens(name: str, key: str) -> str:
    return f"toks AS (SELECT {key}, {sql_words(sql_normalized('text'))} AS t FROM {name})"


def _sql_skip(key: str, high: int) -> str:
    """(key, ord, gram): unigrams, then skip-bigrams, then skip-trigrams, by self-joins on position."""
    parts = [f"SELECT {key}, 1 AS n, i, 0 AS j, 0 AS k, w AS gram FROM p",
             f"SELECT a.{key}, 2, a.i, b.i, 0, a.w || ' ' || b.w FROM p a JOIN p b ON a.{key} = b.{key} AND b.i BETWEEN a.i + 1 AND a.i + 3"]
    if high == 3:
        parts.append(f"SELECT a.{key}, 3, a.i, b.i, c.i, a.w || ' ' || b.w || ' ' || c.w FROM p a JOIN p b ON a.{key} = b.{key} "
                     f"AND b.i BETWEEN a.i + 1 AND a.i + 4 JOIN p c ON a.{key} = c.{key} AND c.i > b.i AND c.i <= a.i + 4")
    return (f"p AS (SELECT {key}, unnest(t) AS w, unnest(range(len(t))) AS i FROM toks), grams AS ("
            + " UNION ALL ".join(parts) + ")")


def _sql_vocabulary(occurrences: str, key: str, n_docs: str) -> str:
    """Vocabulary CTE from ``occurrences(key, term)``."""
    return f"""stats AS (SELECT term, count(DISTINCT {key}) AS df, count(*) AS tf FROM {occurrences} GROUP BY term),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, tf FROM (
  SELECT * FROM stats WHERE df >= 8 AND df <= 0.8 * (SELECT count(*) FROM {n_docs}) ORDER BY tf DESC, term LIMIT 2500))"""


def documents(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return computed(docs, text=normalize_text(F.col("text")))


def _terms(docs: DataFrame, spec: V.Vectorizer, key: str = "doc_id") -> DataFrame:
    return computed(docs.select(key, "text"), terms=spec.terms(F.col("text"))).select(key, "terms")


def _words(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The words of the documents, written: both the vocabulary and the counts are made of them."""
    return cut_lineage(computed(docs.select(key, "text"), words=vector_tokens(F.col("text"))).select(key, "words"))


def _plain_vocabulary(high: int):
    sql = f"""WITH {_sql_tokens('documents', 'doc_id')}, occ AS (SELECT doc_id, unnest({_GRAMS[high]}) AS term FROM toks),
{_sql_vocabulary('occ', 'doc_id', 'documents')} SELECT term, idx, df, tf FROM vocab"""
    spec = V.VECTORIZERS[high - 1]

    @query(f"vocabulary_{spec.name.lower()}", sql)
    def vocabulary(spark, sf_dir):
        return V.word_vocabulary(_words(documents(spark, sf_dir)), spec).withColumn("idx", F.col("idx").cast("bigint"))

    return vocabulary


for _high in (1, 2, 3):
    _plain_vocabulary(_high)


def conversations(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    return computed(rows, text=normalize_text(F.col("text")))


_CONVERSATIONS = f"toks AS (SELECT conv_id * 1000 + turn AS row_id, {sql_words(sql_normalized('text'))} AS t FROM conversations)"


def _skip_queries(high: int):
    spec = V.VECTORIZERS[high + 1]
    name = spec.name.lower().replace("-", "_").replace("2_skip", "skip")

    @query(f"{name}_arrays", f"""WITH {_CONVERSATIONS}, {_sql_skip('row_id', high)}
SELECT toks.row_id, coalesce(string_agg(gram, '|' ORDER BY n, i, j, k), '') AS grams FROM toks LEFT JOIN grams USING (row_id) GROUP BY toks.row_id""")
    def arrays(spark, sf_dir):
        grams = skip_ngrams(vector_tokens(F.col("text")), high, 2)
        return conversations(spark, sf_dir).select("row_id", F.array_join(grams, "|").alias("grams"))

    @query(f"vocabulary_{name}", f"""WITH {_CONVERSATIONS}, {_sql_skip('row_id', high)}, occ AS (SELECT row_id, gram AS term FROM grams),
{_sql_vocabulary('occ', 'row_id', 'conversations')} SELECT term, idx, df, tf FROM vocab""")
    def vocabulary(spark, sf_dir):
        return V.word_vocabulary(_words(conversations(spark, sf_dir), "row_id"), spec).withColumn("idx", F.col("idx").cast("bigint"))

    return arrays, vocabulary


for _high in (2, 3):
    _skip_queries(_high)

_UNIGRAM, _TFIDF = V.VECTORIZERS[0], V.VECTORIZERS[5:8]
_OCC = f"{_sql_tokens('documents', 'doc_id')}, occ AS (SELECT doc_id, unnest(t) AS term FROM toks)"
_TRAIN = f"train AS (SELECT doc_id FROM documents WHERE {sql_hashed('doc_id')} % 100 < 50)"
# Fitted on the training half, applied to every document.
_COUNTS = f"""{_OCC}, {_TRAIN}, train_occ AS (SELECT * FROM occ SEMI JOIN train USING (doc_id)),
{_sql_vocabulary('train_occ', 'doc_id', 'train')},
counts AS (SELECT doc_id, term, count(*) AS tf FROM occ SEMI JOIN vocab USING (term) GROUP BY doc_id, term)"""


def unigram_counts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(vocabulary of the training half, counts of all documents)."""
    docs = V.split_train(_terms(documents(spark, sf_dir), _UNIGRAM))
    vocab = cut_lineage(V.fit_vocabulary(docs.filter("is_train"), _UNIGRAM))
    return vocab, V.count_terms(docs, vocab)


@query("count_features", f"WITH {_COUNTS} SELECT doc_id, term, tf FROM counts")
def count_features(spark, sf_dir):
    return unigram_counts(spark, sf_dir)[1]


def _tfidf_query(spec: V.Vectorizer):
    high = spec.high
    # Whole documents, all three n-gram ranges, weights of the fitted corpus itself.
    sql = f"""WITH {_sql_tokens('documents', 'doc_id')}, occ AS (SELECT doc_id, unnest({_GRAMS[high]}) AS term FROM toks),
{_sql_vocabulary('occ', 'doc_id', 'documents')},
w AS (SELECT doc_id, term, count(*) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + any_value(df))) + 1) AS w
  FROM occ JOIN vocab USING (term) GROUP BY doc_id, term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM w"""

    @query(spec.name.lower().replace("tf-idf ", "tfidf_"), sql)
    def weights(spark, sf_dir):
        docs = _words(documents(spark, sf_dir))
        vocab = cut_lineage(V.word_vocabulary(docs, spec))
        docs = docs.select("doc_id", spec.grams(F.col("words"), 1, spec.high).alias("terms"))
        n_docs = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
        out = V.tfidf(V.count_terms(docs, vocab), vocab, n_docs)
        return out.select("doc_id", "term", F.round("value", 6).alias("value"))

    return weights


for _spec in _TFIDF:
    _tfidf_query(_spec)


@query("information_gain_top20", f"""WITH {_OCC}, {_sql_vocabulary('occ', 'doc_id', 'documents')},
lab AS (SELECT doc_id, quality FROM labels JOIN documents USING (doc_id)),
tf AS (SELECT doc_id, term, count(*) AS v, any_value(quality) AS y FROM occ SEMI JOIN vocab USING (term) JOIN lab USING (doc_id) GROUP BY doc_id, term),
ny AS (SELECT quality AS y, count(*) AS ny FROM lab GROUP BY quality),
cells AS (SELECT term, v, y, count(*) AS c FROM tf GROUP BY term, v, y
  UNION ALL SELECT term, 0, y, any_value(ny) - count(doc_id) FROM (SELECT DISTINCT term FROM tf) CROSS JOIN ny LEFT JOIN tf USING (term, y) GROUP BY term, y),
marg AS (SELECT *, sum(c) OVER (PARTITION BY term, v) AS nv, sum(c) OVER (PARTITION BY term, y) AS nl, sum(c) OVER (PARTITION BY term) AS n FROM cells),
gain AS (SELECT term, sum(CASE WHEN c > 0 THEN c::DOUBLE / n * ln(c::DOUBLE * n / (nv * nl)) ELSE 0 END) AS gain FROM marg GROUP BY term)
SELECT term, round(gain, 6) AS gain FROM gain ORDER BY round(gain, 9) DESC, term LIMIT 20""")
def information_gain_top20(spark, sf_dir):
    docs = _terms(documents(spark, sf_dir), _UNIGRAM)
    vocab = cut_lineage(V.fit_vocabulary(docs, _UNIGRAM))
    marked = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    counts = V.count_terms(marked, vocab, carry=("label",))
    label_rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))
    gain = V.information_gain(counts, label_rows, (0, 1))
    return gain.orderBy(F.desc(F.round("gain", 9)), "term").limit(20).select("term", F.round("gain", 6).alias("gain"))


_SCALES = f"""{_COUNTS},
size AS (SELECT count(*) AS n FROM train),
present AS (SELECT term, list(tf::DOUBLE ORDER BY tf) AS vs, n, n - count(*) AS zeros FROM counts SEMI JOIN train USING (doc_id) CROSS JOIN size GROUP BY term, n),
ranks AS (SELECT term, vs, zeros, unnest([0.25, 0.75]) AS q, (n - 1) * q AS place FROM present),
ends AS (SELECT term, q, place - floor(place) AS frac, CASE WHEN floor(place) < zeros THEN 0 ELSE vs[floor(place)::BIGINT - zeros + 1] END AS lo,
  CASE WHEN ceil(place) < zeros THEN 0 ELSE vs[ceil(place)::BIGINT - zeros + 1] END AS hi FROM ranks),
iqr AS (SELECT term, sum(CASE WHEN q > 0.5 THEN lo + (hi - lo) * frac ELSE -(lo + (hi - lo) * frac) END) AS iqr FROM ends GROUP BY term),
scales AS (SELECT term, CASE WHEN iqr = 0 THEN 1 ELSE iqr END AS scale FROM iqr)"""


def scales(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    _, counts = unigram_counts(spark, sf_dir)
    counts = cut_lineage(counts.withColumn("value", F.col("tf").cast("double")))
    n_train = V.split_train(table(spark, sf_dir, "documents").select("doc_id")).agg(F.count_if("is_train")).scalar()
    return counts, V.term_scales(V.split_train(counts).filter("is_train").drop("is_train"), n_train)


@query("robust_scales", f"WITH {_SCALES} SELECT term, scale FROM scales")
def robust_scales(spark, sf_dir):
    return scales(spark, sf_dir)[1]


@query("robust_scaled_counts", f"WITH {_SCALES} SELECT doc_id, term, round(tf / scale, 6) AS value FROM counts JOIN scales USING (term)")
def robust_scaled_counts(spark, sf_dir):
    counts, scale = scales(spark, sf_dir)
    return V.robust_scale(counts, scale).select("doc_id", "term", F.round("value", 6).alias("value"))


K = 5
_KNN = f"""pts AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.id, b.id AS nid, list_distance(a.v, b.v) AS dist FROM pts a JOIN pts b ON a.id <> b.id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM d) WHERE rank <= {K})"""
_LOF = f"""{_KNN}, kd AS (SELECT id AS nid, dist AS kdist FROM knn WHERE rank = {K}),
lrd AS (SELECT id, 1 / (avg(greatest(dist, kdist)) + 1e-10) AS lrd FROM knn JOIN kd USING (nid) GROUP BY id),
lof AS (SELECT knn.id, avg(n.lrd) / any_value(o.lrd) AS lof FROM knn JOIN lrd n ON n.id = knn.nid JOIN lrd o ON o.id = knn.id GROUP BY knn.id),
cut AS (SELECT quantile_cont(-lof, 0.01) AS q FROM lof)"""


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@query("k_nearest", f"WITH {_KNN} SELECT id, nid, rank, round(dist, 6) AS dist FROM knn")
def k_nearest(spark, sf_dir):
    near = neighbors.k_nearest(points(spark, sf_dir), K)
    return near.select("id", "nid", F.col("rank").cast("bigint").alias("rank"), F.round("dist", 6).alias("dist"))


@query("local_outlier_factor", f"WITH {_LOF} SELECT id, round(lof, 6) AS lof, -lof < q AS is_outlier FROM lof, cut")
def local_outlier_factor(spark, sf_dir):
    return neighbors.outlier_mask(points(spark, sf_dir), K).select("id", F.round("lof", 6).alias("lof"), "is_outlier")


# Raw counts of the training half, as the model search sees them before scaling; dense lists in the other engine.
_FEATURE_LOF = f"""{_COUNTS}, cells AS (SELECT d.doc_id AS id, vocab.idx, coalesce(c.tf, 0)::DOUBLE AS v FROM train d CROSS JOIN vocab LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.term = vocab.term),
pts AS (SELECT id, list(v ORDER BY idx) AS v FROM cells GROUP BY id), d AS (SELECT a.id, b.id AS nid, list_distance(a.v, b.v) AS dist FROM pts a JOIN pts b ON a.id <> b.id),
knn AS {_LOF.split("knn AS ", 1)[1]}"""


def training_features(spark, sf_dir) -> DataFrame:
    """Sparse rows (id, idx, val) of all training documents, those without any term too."""
    vocab, counts = unigram_counts(spark, sf_dir)
    cells = V.split_train(counts).filter("is_train").join(F.broadcast(vocab.select("term", "idx")), "term")
    ids = V.split_train(table(spark, sf_dir, "documents").select("doc_id")).filter("is_train").select("doc_id")
    return V.sparse_rows(ids, cells, "tf")


@query("feature_outliers", f"WITH {_FEATURE_LOF} SELECT id, round(lof, 6) AS lof, -lof < q AS is_outlier FROM lof, cut")
def feature_outliers(spark, sf_dir):
    mask = neighbors.sparse_outlier_mask(training_features(spark, sf_dir), K)
    return mask.select("id", F.round("lof", 6).alias("lof"), "is_outlier")


@query("inliers", f"WITH {_LOF} SELECT vec_id AS id, label FROM embeddings JOIN lof ON id = vec_id, cut WHERE NOT (-lof < q)")
def inliers(spark, sf_dir):
    pts = points(spark, sf_dir)
    mask = neighbors.outlier_mask(pts, K)
    return pts.select("id", "label").join(mask.filter(~F.col("is_outlier")).select("id"), "id", "left_semi")
