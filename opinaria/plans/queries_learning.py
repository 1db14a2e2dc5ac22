"""Queries of the vocabulary jobs (spelling) and of the Spark ML jobs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinaria.functions.normalize import normalize_text
from opinaria.functions.tokens import words as words_of
from opinaria.models import bayes as B, classifiers as C, language as LM, selection as S, stumps as ST
from opinaria.models.text_stages import ReviewCleaner
from opinaria.models.ensembles import WeightedVote
from opinaria.models.search import model_search as search
from opinaria.operators import spelling, stats, vectorize as V
from opinaria.operators.compound import spell_check_compound
from opinaria.operators.curves import roc_curve
from opinaria.operators.frequent import counted_pairs
from opinaria.plans import reviews as flow
from opinaria.plans.queries_features import _SCALES, _UNIGRAM, _sql_vocabulary, documents, unigram_counts
from opinaria.plans.queries_lexicon import BY_VALUE, texts as scored_texts, word_lists
from opinaria.plans.registry import query
from opinaria.plans.views import STOP_WORDS, TEN_POINT, reviews, sql_hashed, sql_normalized, sql_words, table
from opinaria.session import computed, cut_lineage, shared_dir

# ---- spelling: words of the benchmark and conversations against a dictionary of frequent document words

_DICTIONARY = f"""dw AS (SELECT unnest({sql_words(sql_normalized('text'))}) AS term FROM documents),
dict AS (SELECT term, count(*) AS n FROM dw GROUP BY term HAVING count(*) >= 4),
cw AS (SELECT DISTINCT unnest({sql_words(sql_normalized('text'))}) AS token FROM benchmark),
unknown AS (SELECT token FROM cw WHERE token NOT IN (SELECT term FROM dict)),
cand AS (SELECT token, term, n, damerau_levenshtein(token, term) AS distance FROM unknown JOIN dict ON abs(length(token) - length(term)) <= 2
  AND CASE WHEN levenshtein(token, term) <= 4 THEN damerau_levenshtein(token, term) <= 2 ELSE false END),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, n DESC, term) AS r FROM cand) WHERE r = 1)"""


def dictionary(spark, sf_dir) -> DataFrame:
    return cut_lineage(stats.unigram_counts(documents(spark, sf_dir)).filter("n >= 4"))


def misspelt(spark, sf_dir) -> DataFrame:
    return computed(table(spark, sf_dir, "benchmark").select("item_id", "text"), text=normalize_text(F.col("text")))


@query("spelling_candidates", f"WITH {_DICTIONARY} SELECT token, term, n, distance FROM cand")
def spelling_candidates(spark, sf_dir):
    words = dictionary(spark, sf_dir)
    unknown = spelling.unknown_words(spelling.vocabulary(misspelt(spark, sf_dir)), words)
    return spelling.candidates(unknown, words).withColumn("distance", F.col("distance").cast("bigint"))


@query("spelling_suggestions", f"WITH {_DICTIONARY} SELECT token, term, distance, n FROM best")
def spelling_suggestions(spark, sf_dir):
    return spelling.best_suggestions(spelling_candidates(spark, sf_dir))


@query("spell_checked_texts", f"""WITH {_DICTIONARY},
toks AS (SELECT item_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT item_id, {sql_words(sql_normalized('text'))} AS t FROM benchmark))
SELECT item_id, string_agg(coalesce(term, token), ' ' ORDER BY pos) AS text FROM toks LEFT JOIN best USING (token) GROUP BY item_id""")
def spell_checked_texts(spark, sf_dir):
    return spelling.spell_check(misspelt(spark, sf_dir), dictionary(spark, sf_dir), id_col="item_id")


@query("spelling_splits", f"""WITH {_DICTIONARY},
sw AS (SELECT {sql_words(sql_normalized('text'))} AS t FROM conversations),
bi AS (SELECT t[i] AS w1, t[i + 1] AS w2, count(*) AS n FROM (SELECT t, unnest(range(1, len(t))) AS i FROM sw) GROUP BY 1, 2),
cuts AS (SELECT token, substr(token, 1, i) AS w1, substr(token, i + 1) AS w2 FROM (SELECT token, unnest(range(1, length(token))) AS i FROM unknown)),
known AS (SELECT c.*, coalesce(bi.n, 0) AS n, ln(a.n) + ln(b.n) AS p FROM cuts c JOIN dict a ON a.term = w1 JOIN dict b ON b.term = w2 LEFT JOIN bi USING (w1, w2))
SELECT token, w1 || ' ' || w2 AS split FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, p DESC, w1 DESC) AS r FROM known) WHERE r = 1""")
def spelling_splits(spark, sf_dir):
    words = dictionary(spark, sf_dir)
    unknown = spelling.unknown_words(spelling.vocabulary(misspelt(spark, sf_dir)), words)
    talk = computed(table(spark, sf_dir, "conversations").select("text"), text=normalize_text(F.col("text")))
    return spelling.splits(unknown, words, cut_lineage(stats.bigram_counts(talk)))


def pair_counter(docs: DataFrame) -> spelling.Bigrams:
    """Counts the word pairs of the documents that are asked for; most of all their pairs are never looked up."""
    tokens = computed(docs.select("text"), _t=words_of(F.col("text"))).select("_t")
    return lambda pairs: counted_pairs(tokens, "_t", pairs)


@query("spell_checked_documents")
def spell_checked_documents(spark, sf_dir):
    """All documents along the best paths of their lattices; the dictionary is their own frequent words, the neighbours their own word pairs."""
    docs = cut_lineage(documents(spark, sf_dir))
    words = cut_lineage(stats.unigram_counts(docs).filter("n >= 4"))
    return spell_check_compound(docs, words, pair_counter(docs))


@query("review_flow")
def review_flow(spark, sf_dir):
    """The whole flow over all documents: copies dropped, scored raw, normalised, corrected as sentences, stop words removed, filtered by length and
    detected language, labelled, stemmed, filtered again."""
    docs = cut_lineage(documents(spark, sf_dir))
    words, pairs = cut_lineage(stats.unigram_counts(docs).filter("n >= 4")), pair_counter(docs)
    model = LM.fit_language_model(V.split_train(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).filter("is_train"))
    settings = flow.Settings(stop_words=STOP_WORDS, ten_point_sources=TEN_POINT, language="en", stem=True, rules=BY_VALUE)
    rows = flow.review_table(reviews(spark, sf_dir), *word_lists(scored_texts(spark, sf_dir)), dictionary=words, bigrams=pairs,
                             detect=lambda df: LM.detect_language(df, model), settings=settings)
    return rows.select("doc_id", "source", "rating", "text", "language", "sentiment", F.col("length").cast("bigint").alias("length"), "leia")


# ---- naive Bayes, against the same model computed from counts

_NB = f"""toks AS (SELECT doc_id, {sql_words(sql_normalized('text'))} AS t FROM documents), occ AS (SELECT doc_id, unnest(t) AS term FROM toks),
train AS (SELECT doc_id FROM documents WHERE {sql_hashed('doc_id')} % 100 < 50),
train_occ AS (SELECT * FROM occ SEMI JOIN train USING (doc_id)), {_sql_vocabulary('train_occ', 'doc_id', 'train')},
y AS (SELECT doc_id, quality AS label FROM labels), tf AS (SELECT doc_id, label, term, count(*) AS tf FROM occ SEMI JOIN vocab USING (term) JOIN y USING (doc_id) GROUP BY ALL),
cells AS (SELECT l.label, v.term, v.idx FROM (SELECT DISTINCT label FROM y) l CROSS JOIN vocab v)"""


def _labelled_vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vocab, _ = unigram_counts(spark, sf_dir)
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    docs = computed(docs, terms=_UNIGRAM.terms(F.col("text"))).select("doc_id", "label", "terms")
    return PipelineModel(V.ml_stages(vocab, _UNIGRAM, 1)).transform(docs), vocab


def _theta(model, vocab: DataFrame) -> DataFrame:
    theta = model.theta.toArray()
    rows = [(float(c), i, float(v)) for c, row in enumerate(theta) for i, v in enumerate(row)]
    table_ = vocab.sparkSession.createDataFrame(rows, "label double, idx int, log_p double")
    return vocab.select("term", "idx").join(table_, "idx").select(
        F.col("label").cast("int").alias("label"), "term", F.round("log_p", 6).alias("log_p"))


@query("multinomial_naive_bayes", f"""WITH {_NB}, s AS (SELECT label, term, sum(tf) AS n FROM tf GROUP BY label, term)
SELECT label, term, round(ln((coalesce(n, 0) + 0.5) / (sum(coalesce(n, 0)) OVER (PARTITION BY label) + 0.5 * count(*) OVER (PARTITION BY label))), 6) AS log_p
FROM cells LEFT JOIN s USING (label, term)""")
def multinomial_naive_bayes(spark, sf_dir):
    vectors, vocab = _labelled_vectors(spark, sf_dir)
    return _theta(NaiveBayes(modelType="multinomial", smoothing=0.5).fit(vectors), vocab)


@query("bernoulli_naive_bayes", f"""WITH {_NB}, s AS (SELECT label, term, count(*) AS n FROM tf GROUP BY label, term),
k AS (SELECT label, count(*) AS docs FROM y SEMI JOIN documents USING (doc_id) GROUP BY label)
SELECT label, term, round(ln((coalesce(n, 0) + 1.0) / (docs + 2.0)), 6) AS log_p FROM cells JOIN k USING (label) LEFT JOIN s USING (label, term)""")
def bernoulli_naive_bayes(spark, sf_dir):
    vectors, vocab = _labelled_vectors(spark, sf_dir)
    spec = C.BY_NAME["BernoulliNB"]
    return _theta(spec.build(1, 1).fit(vectors).stages[-1], vocab)


# ---- seeded estimators: checked for rows here and for quality in the tests

def train_test(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents with a topic that text can tell: is it written in English?"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = computed(docs, text=normalize_text(F.col("text"))).select(
        "doc_id", "text", (F.col("lang") == "en").cast("double").alias("label"))
    rows = V.split_train(rows)
    return rows.filter("is_train").drop("is_train"), rows.filter("NOT is_train").drop("is_train")


_WRITTEN: dict[tuple, tuple] = {}


def _features(spark, sf_dir, spec: V.Vectorizer):
    """Feature tables are written once per session and serve every classifier compared on them. The digest of the documents is part of the
    key, so changed data are never served from an old copy."""
    digest = S.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    key = (spark.sparkContext.applicationId, sf_dir, digest, spec)
    if key not in _WRITTEN:
        train, test = (cut_lineage(part) for part in train_test(spark, sf_dir))
        model, a, b = S.featurize(train, test, spec)
        keep = ["doc_id", "label", "features"]
        _WRITTEN[key] = (model, cut_lineage(a.select(*keep)), cut_lineage(b.select(*keep)))
    return _WRITTEN[key]


UNIGRAMS = V.Vectorizer("Unigram")


# What every classifier must reach whatever its library: each test row of each class is predicted, and more of them rightly than by the majority class.
_JUDGED = f"""SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS label, count(*) AS test_rows, TRUE AS beats_majority
FROM documents WHERE {sql_hashed('doc_id')} % 100 >= 50 GROUP BY 1"""


def judged(predictions: DataFrame) -> DataFrame:
    """(label, test_rows, beats_majority) of rows with label and prediction."""
    rows = predictions.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count("prediction").alias("test_rows"), F.count_if(F.col("prediction") == F.col("label")).alias("_hits"))
    every = W.partitionBy()  # two rows
    return rows.select("label", "test_rows", (F.sum("_hits").over(every) > F.max("test_rows").over(every)).alias("beats_majority"))


def _fitted(name: str):
    @query(f"classifier_{name.lower()}", _JUDGED)
    def fit(spark, sf_dir):
        _, train, test = _features(spark, sf_dir, UNIGRAMS)
        size = len(train.select("features").first()["features"])
        model = C.BY_NAME[name].build(train.count(), size).fit(train)
        return judged(model.transform(test))

    return fit


for _c in C.CLASSIFIERS:
    _fitted(_c.name)

# The general search takes all eight vectorisers and seventeen classifiers; these are registered (README, "Registered parameters").
SEARCHED = (UNIGRAMS, V.Vectorizer("Bigram", high=2), V.Vectorizer("TF-IDF Unigram", tfidf=True))
SWEEP = ("LogisticRegression", "RidgeClassifier", "MultinomialNB", "BernoulliNB")


@query("comparison_sweep", f"""SELECT v_name, c_name, '' AS flag, TRUE AS beats_majority FROM (SELECT unnest(['Unigram', 'TF-IDF Unigram']) AS v_name)
CROSS JOIN (SELECT unnest([{', '.join(repr(C.BY_NAME[n].c_name) for n in SWEEP)}]) AS c_name)""")
def comparison_sweep(spark, sf_dir):
    """Two vectorisers by four classifiers."""
    tables, sizes = {}, {}
    for spec in (UNIGRAMS, V.Vectorizer("TF-IDF Unigram", tfidf=True)):
        _, train, test = _features(spark, sf_dir, spec)
        tables[spec.name], sizes[spec.name] = (train, test), len(train.select("features").first()["features"])
    rows = S.results_frame(spark, S.compare(tables, [C.BY_NAME[n] for n in SWEEP], sizes))
    shares = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).scalar()
    return rows.select("v_name", "c_name", "flag", (F.col("accuracy") > shares).alias("beats_majority"))


# The same counts in the other engine: scaled counts of both halves, ranks and folds of the training half, and naive Bayes from them.
_ALPHAS = C.BY_NAME["MultinomialNB"].grid["alpha"]
_BAYES = f"""{_SCALES}, y AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS label, doc_id IN (SELECT doc_id FROM train) AS is_train FROM documents),
val AS (SELECT doc_id, term, tf / scale AS v FROM counts JOIN scales USING (term)), terms AS (SELECT term FROM vocab), width AS (SELECT count(*) AS n_terms FROM vocab),
ranked AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS r, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS size FROM y WHERE is_train)"""
_WEIGHTS = """n AS (SELECT model, label, term, sum(v) AS n FROM val JOIN learnt USING (doc_id) GROUP BY ALL),
rows AS (SELECT model, label, count(*) AS rows FROM learnt GROUP BY ALL), every AS (SELECT model, l.label FROM (SELECT DISTINCT model FROM learnt) CROSS JOIN (SELECT unnest([0, 1]) AS label) l),
weight AS (SELECT e.model, e.label, a.place, a.alpha, term, ln(coalesce(n, 0) + a.alpha) - ln(sum(coalesce(n, 0)) OVER (PARTITION BY e.model, e.label, a.place) + a.alpha * n_terms) AS w
  FROM every e CROSS JOIN alphas a CROSS JOIN terms CROSS JOIN width LEFT JOIN n USING (model, label, term)),
prior AS (SELECT e.model, e.label, a.place, ln(coalesce(rows, 0) + a.alpha) - ln(sum(coalesce(rows, 0)) OVER (PARTITION BY e.model, a.place) + 2 * a.alpha) AS p
  FROM every e CROSS JOIN alphas a LEFT JOIN rows USING (model, label)),
score AS (SELECT g.doc_id, g.label AS truth, p.model, p.label, p.place, any_value(p) + coalesce(sum(v * w), 0) AS s FROM judged g JOIN prior p ON p.model = g.model
  LEFT JOIN val ON val.doc_id = g.doc_id LEFT JOIN weight x ON x.model = p.model AND x.label = p.label AND x.place = p.place AND x.term = val.term GROUP BY ALL),
pred AS (SELECT doc_id, model, place, any_value(truth) AS truth, CASE WHEN max(s) FILTER (label = 1) > max(s) FILTER (label = 0) THEN 1 ELSE 0 END AS pred FROM score GROUP BY doc_id, model, place)"""


def _long(spark, sf_dir):
    train, test = (cut_lineage(part.withColumn("label", F.col("label").cast("int"))) for part in train_test(spark, sf_dir))
    return train, test, *S.long_features(train, test, UNIGRAMS)


@query("grid_search", f"""WITH {_BAYES}, alphas AS (SELECT unnest(range({len(_ALPHAS)})) AS place, unnest([{', '.join(str(float(max(a, C.LEAST_SMOOTHING))) for a in _ALPHAS)}]::DOUBLE[]) AS alpha),
counted AS (SELECT label, count(*) AS n FROM ranked GROUP BY label), starts AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM counted),
folded AS (SELECT doc_id, label, CASE WHEN r < (start + n + 1) // 2 - (start + 1) // 2 THEN 0 ELSE 1 END AS fold FROM ranked JOIN starts USING (label)),
learnt AS (SELECT doc_id, label, 1 - fold AS model FROM folded UNION ALL SELECT doc_id, label, 2 FROM folded),
judged AS (SELECT doc_id, label, fold AS model FROM folded UNION ALL SELECT doc_id, label, 2 FROM y WHERE NOT is_train), {_WEIGHTS},
accuracy AS (SELECT place, avg(a) AS a FROM (SELECT place, model, avg(CASE WHEN pred = truth THEN 1 ELSE 0 END) AS a FROM pred WHERE model < 2 GROUP BY place, model) GROUP BY place),
chosen AS (SELECT place FROM accuracy ORDER BY round(a, 9) DESC, place LIMIT 1)
SELECT doc_id, ([{', '.join(str(float(a)) for a in _ALPHAS)}]::DOUBLE[])[place + 1] AS alpha, pred FROM pred SEMI JOIN chosen USING (place) WHERE model = 2""")
def grid_search(spark, sf_dir):
    """Every smoothing of the grid from one table of counts; the best one, trained on all folds, predicts the other half."""
    train, test, vocab, seen, new = _long(spark, sf_dir)
    folded = cut_lineage(S.stratified_folds(train.select("doc_id", "label")))
    accuracies = [round(a, 9) for a in B.grid_scores(seen, folded, vocab, _ALPHAS)]
    alpha = float(_ALPHAS[accuracies.index(max(accuracies))])
    stats = B.statistics(seen, folded.withColumnRenamed("fold", "part"), vocab, S.FOLDS)
    weights, priors = B.log_weights(stats, [B.Trial(tuple(range(S.FOLDS)), alpha)])
    found = B.predictions(new, test.select("doc_id", "label"), weights, priors)
    return found.select("doc_id", F.lit(alpha).alias("alpha"), F.col("preds")[0].alias("pred"))


@query("vote_search", _JUDGED)
def vote_search(spark, sf_dir):
    _, train, test = _features(spark, sf_dir, UNIGRAMS)
    n, size, voters = train.count(), len(train.select("features").first()["features"]), []
    for name in SWEEP:
        estimator = C.BY_NAME[name].build(n, size)
        voters.append((name, lambda e=estimator: e, estimator.fit(train)))
    best = S.best_vote(voters, train, test)
    return judged(best["model"].transform(test))


@query("learning_curve", f"""WITH {_BAYES}, alphas AS (SELECT 0 AS place, 1.0::DOUBLE AS alpha), steps AS (SELECT unnest(range(1, 11)) AS model),
learnt AS (SELECT doc_id, label, model FROM ranked JOIN steps ON place < size * model // 10), judged AS (SELECT doc_id, label, model FROM y CROSS JOIN steps WHERE NOT is_train), {_WEIGHTS}
SELECT CAST(10 * model AS INT) AS percent, avg(CASE WHEN pred <> truth THEN 1 ELSE 0 END) AS error FROM pred GROUP BY model""")
def learning_curve(spark, sf_dir):
    """Ten prefixes of the training rows, from running sums of one table of counts."""
    train, test, vocab, seen, new = _long(spark, sf_dir)
    ranked = cut_lineage(S.with_rank(train.select("doc_id", "label"), [], "doc_id"))
    return B.learning_curve(seen, ranked, new, test, vocab)


def _sql_round(k: int) -> str:
    """One round of boosting: w<k> to the best stump m<k> and w<k + 1>."""
    gini = lambda x, y: f"CASE WHEN {x} + {y} > 0 THEN {x} * {y} / ({x} + {y}) ELSE 0 END"
    return f"""t{k} AS (SELECT sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS ones, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS zeros, count(*) AS n FROM w{k}),
s{k} AS (SELECT i, v, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS w1, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS w0, count(*) AS c FROM cell JOIN w{k} USING (doc_id) GROUP BY i, v),
u{k} AS (SELECT i, v, w1, w0 FROM s{k} UNION ALL SELECT i, 0, any_value(ones) - sum(w1), any_value(zeros) - sum(w0) FROM s{k}, t{k} GROUP BY i HAVING any_value(n) > sum(c)),
r{k} AS (SELECT i, v, sum(w1) OVER run AS b1, sum(w0) OVER run AS b0, lead(v) OVER run AS nxt FROM u{k} WINDOW run AS (PARTITION BY i ORDER BY v)),
b{k} AS (SELECT *, {gini('b1', 'b0')} + {gini('a1', 'a0')} AS g FROM (SELECT i, (v + nxt) / 2 AS cut, b1, b0, greatest(ones - b1, 0) AS a1, greatest(zeros - b0, 0) AS a0 FROM r{k}, t{k} WHERE nxt IS NOT NULL)
  ORDER BY round(g, 10), i, cut LIMIT 1),
m{k} AS (SELECT i, cut, CASE WHEN b1 > b0 THEN 1 ELSE 0 END AS below, CASE WHEN a1 > a0 THEN 1 ELSE 0 END AS above, ln((1 - e) / e) AS say FROM (SELECT *, least(b1, b0) + least(a1, a0) AS e FROM b{k})),
w{k + 1} AS (SELECT doc_id, label, w / sum(w) OVER () AS w FROM (
  SELECT w{k}.doc_id, w{k}.label, w{k}.w * CASE WHEN CASE WHEN coalesce(v, 0) <= cut THEN below ELSE above END <> w{k}.label THEN exp(say) ELSE 1 END AS w
  FROM w{k} CROSS JOIN m{k} LEFT JOIN cell ON cell.doc_id = w{k}.doc_id AND cell.i = m{k}.i))"""


@query("boosted_stump_weights", f"""WITH {_NB}, cell AS (SELECT tf.doc_id, idx AS i, tf.tf::DOUBLE AS v FROM tf JOIN vocab USING (term)),
w1 AS (SELECT doc_id, label, 1.0::DOUBLE / count(*) OVER () AS w FROM y SEMI JOIN documents USING (doc_id)),
{', '.join(_sql_round(k) for k in (1, 2, 3))}
SELECT doc_id, round(w, 9) AS weight FROM w4""")
def boosted_stump_weights(spark, sf_dir):
    """The weights of all labelled documents after three rounds of boosting."""
    vectors, _ = _labelled_vectors(spark, sf_dir)
    rows = cut_lineage(vectors.select("doc_id", F.col("label").cast("int").alias("label"), ST.cells_of().alias("cells")))
    _, weighted = ST.boost(rows, 3)
    return weighted.select("doc_id", F.round("w", 9).alias("weight"))


def _sql_curve_points(side: str, docs: str) -> str:
    """Scores of every one-vs-rest model for the rows of one side, under the class's name and under all classes together."""
    return f"""SELECT '{side}/' || m AS model, round(s, 6) AS score, hit FROM (
  SELECT b.lang AS m, CASE WHEN d.lang = b.lang THEN 1 ELSE 0 END AS hit, any_value(b.p) + coalesce(sum(v * w), 0) AS s
  FROM {docs} d CROSS JOIN bias b LEFT JOIN val ON val.doc_id = d.doc_id LEFT JOIN odds o ON o.lang = b.lang AND o.term = val.term GROUP BY d.doc_id, d.lang, b.lang)"""


@query("naive_bayes_curves", f"""WITH {_BAYES}, learnt AS (SELECT doc_id, lang FROM documents SEMI JOIN train USING (doc_id)), judged AS (SELECT doc_id, lang FROM documents ANTI JOIN train USING (doc_id)),
langs AS (SELECT DISTINCT lang FROM learnt), n AS (SELECT lang, term, sum(v) AS n FROM val JOIN learnt USING (doc_id) GROUP BY lang, term),
cell AS (SELECT l.lang, t.term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY t.term) AS every FROM langs l CROSS JOIN terms t LEFT JOIN n ON n.lang = l.lang AND n.term = t.term),
odds AS (SELECT lang, term, ln(n + 1) - ln(sum(n) OVER (PARTITION BY lang) + n_terms) - ln(every - n + 1) + ln(sum(every - n) OVER (PARTITION BY lang) + n_terms) AS w FROM cell, width),
bias AS (SELECT lang, ln(count(*) + 1) - ln((SELECT count(*) FROM learnt) - count(*) + 1) AS p FROM learnt GROUP BY lang),
scored AS ({_sql_curve_points('train', 'learnt')} UNION ALL {_sql_curve_points('test', 'judged')}),
named AS (SELECT model, score, hit FROM scored UNION ALL SELECT split_part(model, '/', 1) || '/all', score, hit FROM scored),
g AS (SELECT model, score, sum(hit) AS pos, count(*) - sum(hit) AS neg FROM named GROUP BY model, score),
c AS (SELECT model, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n,
  lead(pos) OVER (PARTITION BY model ORDER BY score DESC) AS npos, lead(neg) OVER (PARTITION BY model ORDER BY score DESC) AS nneg
  FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM c WHERE npos IS NULL OR npos <> pos OR nneg <> neg UNION ALL SELECT DISTINCT model, 0, 0 FROM named""")
def naive_bayes_curves(spark, sf_dir):
    """ROC points of one-vs-rest naive Bayes over the languages, on training and test rows, per language and for all languages together."""
    train, test, vocab, seen, new = _long(spark, sf_dir)
    langs = [r["lang"] for r in table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").collect()]
    number = sum((F.when(F.col("lang") == name, k).otherwise(0) for k, name in enumerate(langs)), F.lit(0))
    labels = table(spark, sf_dir, "documents").select("doc_id", number.alias("label"), F.lit(0).alias("part"))
    sides = {"train": (train.select("doc_id").join(labels, "doc_id"), seen), "test": (test.select("doc_id").join(labels, "doc_id"), new)}
    stats_ = B.statistics(seen, sides["train"][0], vocab, 1, labels=range(len(langs)))
    weights, priors = B.one_vs_rest(stats_)
    scored = None
    for side, (docs, cells) in sides.items():
        rows = B.predictions(cells, docs, weights, priors)
        decisions = F.array(*[F.struct(F.lit(f"{side}/{name}").alias("model"), (F.col("scores")[2 * k + 1] - F.col("scores")[2 * k]).alias("score"),
                                       (F.col("label") == k).cast("int").alias("label")) for k, name in enumerate(langs)])
        part = rows.select(F.inline(decisions))
        both = part.unionByName(part.withColumn("model", F.lit(f"{side}/all")))
        scored = both if scored is None else scored.unionByName(both)
    points = roc_curve(cut_lineage(scored.withColumn("score", F.round("score", 6))))
    return points.select("model", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("model_search")
def model_search(spark, sf_dir):
    """The whole search: features without outliers, defaults, pruning, grids, refits and votes, for the vectorisers and classifiers below."""
    train, test = train_test(spark, sf_dir)
    found = search(train, test, SEARCHED, [C.BY_NAME[n] for n in SWEEP], shared_dir(spark))
    return found.select("phase", "v_name", "c_name", "params", "accuracy", "flag", "error")


@query("most_informative_terms")
def most_informative_terms(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    train = cut_lineage(train)
    model, a, _ = S.featurize(train, test, UNIGRAMS)
    fitted = C.BY_NAME["LogisticRegression"].build(train.count(), 100).fit(a)
    vocab = spark.createDataFrame(list(enumerate(model.stages[1].vocabulary)), "idx int, term string")
    return S.most_informative(S.coefficients(fitted, vocab), labels=("other", "english"))


@query("one_vs_rest_curve")
def one_vs_rest_curve(spark, sf_dir):
    _, train, test = _features(spark, sf_dir, UNIGRAMS)
    model = C.BY_NAME["LinearSVC"].build(train.count(), 100).fit(train)
    return roc_curve(S.one_vs_rest_scores(model.transform(test), "LinearSVC"))


@query("detected_languages", f"""SELECT lang, count(*) AS test_rows, TRUE AS mostly_right FROM documents WHERE {sql_hashed('doc_id')} % 100 >= 50 GROUP BY lang""")
def detected_languages(spark, sf_dir):
    docs = V.split_train(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    model = LM.fit_language_model(docs.filter("is_train"))
    found = LM.detect_language(docs.filter("NOT is_train").select("doc_id", "lang", "text"), model)
    return found.groupBy("lang").agg(F.count("*").alias("test_rows"), (F.avg((F.col("language") == F.col("lang")).cast("int")) > 0.5).alias("mostly_right"))


@query("saved_scoring_model", _JUDGED)
def saved_scoring_model(spark, sf_dir):
    """One saved model from raw text to the vote of three classifiers, with spelling and stemming: fitted once, loaded the second time."""
    docs = V.split_train(table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("lang") == "en").cast("double").alias("label")))
    train, test = docs.filter("is_train").drop("is_train"), docs.filter("NOT is_train").drop("is_train")
    base = shared_dir(spark)

    def fit():
        dictionary = shared_dir(spark)
        stats.unigram_counts(computed(train, text=normalize_text(F.col("text")))).filter("n >= 4").write.parquet(dictionary)
        cleaner = ReviewCleaner("text", "clean", STOP_WORDS, dictionary=dictionary)
        cleaned = cut_lineage(cleaner.transform(train).drop("text"))
        model, a, _ = S.featurize(cleaned, cleaned, UNIGRAMS, text="clean")
        a = cut_lineage(a.select("doc_id", "label", "features"))
        voters = [C.BY_NAME[name].build(train.count(), 100).fit(a) for name in ("LogisticRegression", "MultinomialNB", "BernoulliNB")]
        return PipelineModel([cleaner, *model.stages, WeightedVote(voters)])

    S.fit_or_load(spark, base, {"model": "vote"}, train, fit)
    model = S.fit_or_load(spark, base, {"model": "vote"}, train, fit)
    return judged(model.transform(test))
