"""Queries of the evaluation operators: results tables, votes, confusion, curves, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.models.selection import stratified_folds, with_rank
from opinaria.operators import curves, results as R, voting
from opinaria.operators.stats import accuracy, misclassification
from opinaria.plans.registry import query
from opinaria.plans.views import sql_hashed, table
from opinaria.functions.tokens import bucket

RESULTS = """results AS (SELECT l_returnflag || l_linestatus AS v_name, 'clf.' || l_linenumber AS c_name,
  CASE WHEN l_tax > 0 THEN l_discount * l_quantity / 10 END AS accuracy, l_quantity / 7 AS train_time, l_tax * l_quantity AS predict_time
FROM lineitem)"""


def results(spark, sf_dir) -> DataFrame:
    """Line items read as a table of model results with many runs per cell."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("v_name"),
        F.concat(F.lit("clf."), F.col("l_linenumber").cast("string")).alias("c_name"),
        F.when(F.col("l_tax") > 0, F.col("l_discount") * q / 10).alias("accuracy"),
        (q / 7).alias("train_time"), (F.col("l_tax") * q).alias("predict_time"))


_MEANS = f"""{RESULTS}, means AS (SELECT CASE WHEN grouping(c_name) = 1 THEN 'Average' ELSE c_name END AS c_name,
  CASE WHEN grouping(v_name) = 1 THEN 'Average' ELSE v_name END AS v_name, round(avg(accuracy), 9) AS mean
FROM results WHERE accuracy IS NOT NULL GROUP BY CUBE (c_name, v_name))"""


def means(spark, sf_dir) -> DataFrame:
    return R.grouped_means(results(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


@query("results_means_with_margins", f"WITH {_MEANS} SELECT * FROM means")
def results_means_with_margins(spark, sf_dir):
    return means(spark, sf_dir)


V_NAMES = ("AF", "NF", "NO", "RF", "AO", "RO")


@query("results_pivot", f"""WITH {_MEANS} SELECT c_name, {', '.join(f"max(mean) FILTER (WHERE v_name = '{v}') AS {v}" for v in V_NAMES)},
  max(mean) FILTER (WHERE v_name = 'Average') AS Average FROM means GROUP BY c_name ORDER BY Average DESC, c_name""")
def results_pivot(spark, sf_dir):
    return R.pivot_means(means(spark, sf_dir), V_NAMES)


@query("results_pivot_without_margins", f"""WITH {_MEANS} SELECT c_name, {', '.join(f"max(mean) FILTER (WHERE v_name = '{v}') AS {v}" for v in V_NAMES)}
FROM means WHERE c_name <> 'Average' GROUP BY c_name""")
def results_pivot_without_margins(spark, sf_dir):
    return R.pivot_means(means(spark, sf_dir), V_NAMES, average=False)


@query("results_column_order", f"WITH {_MEANS} SELECT v_name, round(mean, 4) AS mean FROM means WHERE c_name = 'Average' ORDER BY 2, 1")
def results_column_order(spark, sf_dir):
    return R.column_order(means(spark, sf_dir))


_KEPT = f"""{_MEANS}, kept AS (SELECT CASE WHEN v_name = 'Average' THEN 'classifier' ELSE 'vectorizer' END AS kind,
  CASE WHEN v_name = 'Average' THEN replace(c_name, 'clf', 'aux') ELSE v_name END AS name FROM means
WHERE (v_name = 'Average') <> (c_name = 'Average') AND mean > (SELECT mean FROM means WHERE v_name = 'Average' AND c_name = 'Average'))"""


@query("options_above_average", f"WITH {_KEPT} SELECT kind, name FROM kept")
def options_above_average(spark, sf_dir):
    return R.above_average(results(spark, sf_dir), renamed={"clf": "aux"})


@query("options_kept", f"""WITH {_KEPT} SELECT name, rows FROM (SELECT v_name AS name, count(*) AS rows FROM results GROUP BY v_name)
SEMI JOIN (SELECT name FROM kept WHERE kind = 'vectorizer') USING (name)""")
def options_kept(spark, sf_dir):
    rows = results(spark, sf_dir)
    options = rows.groupBy(F.col("v_name").alias("name")).agg(F.count("*").alias("rows"))
    return R.keep_options(options, R.above_average(rows), "vectorizer")


@query("results_cell", f"WITH {RESULTS} SELECT v_name, c_name, accuracy, train_time, predict_time FROM results WHERE c_name = 'clf.3' AND v_name = 'RF'")
def results_cell(spark, sf_dir):
    return R.cell(results(spark, sf_dir), "clf.3", "RF")


@query("metric_range", f"WITH {RESULTS} SELECT min(accuracy) AS low, max(accuracy) AS high FROM results")
def metric_range(spark, sf_dir):
    return R.metric_range(results(spark, sf_dir), "accuracy")


@query("best_cell", f"""WITH {RESULTS} SELECT v_name, c_name, accuracy FROM results WHERE accuracy IS NOT NULL
ORDER BY accuracy DESC, v_name, c_name LIMIT 1""")
def best_cell(spark, sf_dir):
    return R.best_cell(results(spark, sf_dir))


@query("total_time", f"WITH {RESULTS} SELECT *, train_time + predict_time AS total_time FROM results")
def total_time(spark, sf_dir):
    return R.with_total_time(results(spark, sf_dir))


@query("flag_members", f"""WITH {RESULTS}, cells AS (SELECT v_name, c_name, max(accuracy) AS accuracy FROM results GROUP BY ALL)
SELECT v_name, c_name, accuracy, CASE WHEN v_name = 'NO' AND c_name IN ('clf.1', 'clf.2', 'clf.5') THEN '*' ELSE '' END AS flag FROM cells""")
def flag_members(spark, sf_dir):
    cells = results(spark, sf_dir).groupBy("v_name", "c_name").agg(F.max("accuracy").alias("accuracy"))
    chosen = cells.filter((F.col("v_name") == "NO") & F.col("c_name").isin("clf.1", "clf.2", "clf.5"))
    return R.flag_members(cells, chosen)


@query("best_by_weighted_accuracy", f"""WITH {RESULTS}, cells AS (SELECT v_name, c_name, avg(accuracy) AS new_acc, max(accuracy) AS old_acc FROM results GROUP BY ALL)
SELECT v_name, c_name, round((new_acc + 2 * old_acc) / 3, 6) AS weighted FROM cells ORDER BY round((new_acc + 2 * old_acc) / 3, 6) DESC, v_name, c_name LIMIT 1""")
def best_by_weighted_accuracy(spark, sf_dir):
    cells = results(spark, sf_dir).groupBy("v_name", "c_name").agg(F.avg("accuracy").alias("new"), F.max("accuracy").alias("old"))
    weighted = cells.select("v_name", "c_name", F.round(R.weighted_accuracy(F.col("new"), F.col("old")), 6).alias("weighted"))
    return R.best_cell(weighted, "weighted")


N_VOTERS = 7


def predictions(spark, sf_dir) -> DataFrame:
    """Seven voters per vector: does each of the first components exceed that voter's threshold?"""
    voters = F.array(*[F.struct(F.lit(i).alias("voter"), (F.get("embedding", F.lit(i)) > 0.02 * (i - 3)).cast("int").alias("pred"))
                       for i in range(N_VOTERS)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 2).alias("label"), F.inline(voters))


_PREDICTIONS = "predictions AS (" + " UNION ALL ".join(
    f"SELECT vec_id AS row_id, label % 2 AS label, {i} AS voter, (embedding[{i + 1}] > {0.02 * (i - 3)}::DOUBLE)::INT AS pred FROM embeddings"
    for i in range(N_VOTERS)) + ")"
_VOTES = f"""{_PREDICTIONS}, masks AS (SELECT unnest(range(1 << {N_VOTERS})) AS mask),
votes AS (SELECT mask, row_id, label, sum(pred) * 2 > count(*) AS vote FROM masks JOIN predictions ON (mask >> voter) & 1 = 1
  WHERE bit_count(mask) >= 3 GROUP BY mask, row_id, label),
scores AS (SELECT mask, avg(CASE WHEN vote::INT = label THEN 1 ELSE 0 END) AS accuracy FROM votes GROUP BY mask)"""


@query("vote_patterns", f"""WITH {_PREDICTIONS}, rows AS (SELECT row_id, label, sum(pred << voter)::BIGINT AS pattern FROM predictions GROUP BY row_id, label)
SELECT pattern, label, count(*) AS n FROM rows GROUP BY pattern, label""")
def vote_patterns(spark, sf_dir):
    return voting.vote_patterns(predictions(spark, sf_dir))


@query("vote_subsets", f"""WITH {_PREDICTIONS}, n AS (SELECT max(voter)::INT + 1 AS n FROM predictions)
SELECT mask FROM (SELECT unnest(range(1::BIGINT << n)) AS mask FROM n) WHERE bit_count(mask) >= 3""")
def vote_subsets(spark, sf_dir):
    """The subsets of as many voters as the predictions hold."""
    n_voters = predictions(spark, sf_dir).agg(F.max("voter")).first()[0] + 1
    return voting.with_subsets(spark.range(1), n_voters).select("mask")


@query("vote_subset_scores", f"WITH {_VOTES} SELECT mask, round(accuracy, 9) AS accuracy FROM scores")
def vote_subset_scores(spark, sf_dir):
    scores = voting.subset_scores(voting.vote_patterns(predictions(spark, sf_dir)), N_VOTERS)
    return scores.withColumn("accuracy", F.round("accuracy", 9))


@query("vote_finalists", f"""WITH {_VOTES} SELECT mask, round(accuracy, 9) AS accuracy FROM scores
WHERE round(accuracy, 9) >= (SELECT min(a) FROM (SELECT round(accuracy, 9) AS a FROM scores ORDER BY a DESC LIMIT 5))""")
def vote_finalists(spark, sf_dir):
    return voting.finalists(vote_subset_scores(spark, sf_dir))


@query("majority_vote", f"""WITH {_PREDICTIONS}, c AS (SELECT row_id, pred, count(*) AS n FROM predictions GROUP BY row_id, pred)
SELECT row_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, pred) AS r FROM c) WHERE r = 1""")
def majority_vote(spark, sf_dir):
    return voting.majority_vote(predictions(spark, sf_dir))


@query("accuracy_by_voter", f"""WITH {_PREDICTIONS} SELECT voter, round(avg((pred = label)::INT), 9) AS accuracy, round(avg((pred <> label)::INT), 9) AS error
FROM predictions GROUP BY voter""")
def accuracy_by_voter(spark, sf_dir):
    p, y = F.col("pred"), F.col("label")
    return predictions(spark, sf_dir).groupBy("voter").agg(F.round(accuracy(p, y), 9).alias("accuracy"),
                                                           F.round(misclassification(p, y), 9).alias("error"))


@query("predictions_with_truth", f"""WITH {_PREDICTIONS} SELECT p.row_id, p.pred, e.label % 2 AS label FROM predictions p JOIN embeddings e ON e.vec_id = p.row_id WHERE voter = 0""")
def predictions_with_truth(spark, sf_dir):
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 2).alias("label"))
    return predictions(spark, sf_dir).filter("voter = 0").select("row_id", "pred").join(truth, "row_id")


@query("confusion_matrix", f"""WITH {_PREDICTIONS}, c AS (SELECT label, pred FROM predictions WHERE voter = 2)
SELECT l.label, p.pred, count(c.label) AS n, count(c.label) / (SELECT count(*) FROM c) AS share
FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) p(pred) LEFT JOIN c ON c.label = l.label AND c.pred = p.pred GROUP BY l.label, p.pred""")
def confusion_matrix(spark, sf_dir):
    return R.confusion_matrix(predictions(spark, sf_dir).filter("voter = 2"), (0, 1))


@query("majority_baseline", f"""WITH s AS (SELECT label, {sql_hashed('vec_id')} % 100 < 50 AS tr FROM embeddings),
m AS (SELECT label FROM s WHERE tr GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT round(avg((s.label = m.label)::INT), 9) AS accuracy, any_value(m.label) AS majority FROM s, m WHERE NOT tr""")
def majority_baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", (bucket(F.col("vec_id")) < 50).alias("tr"))
    out = R.majority_baseline(rows.filter("tr"), rows.filter("NOT tr"))
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query("binarized_labels", "SELECT vec_id, " + ", ".join(f"(label = {c})::INT AS is_{c}" for c in range(10)) + " FROM embeddings")
def binarized_labels(spark, sf_dir):
    """All ten classes of the table."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", *[(F.col("label") == c).cast("int").alias(f"is_{c}") for c in range(10)])


@query("encoded_labels", "SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM documents")
def encoded_labels(spark, sf_dir):
    from pyspark.ml.feature import StringIndexer
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    coded = StringIndexer(inputCol="lang", outputCol="code", stringOrderType="alphabetAsc").fit(docs).transform(docs)
    return coded.select("doc_id", "lang", F.col("code").cast("bigint").alias("code"))


N_MODELS = 4


def scored(spark, sf_dir) -> DataFrame:
    """Scores of four models, rounded so that many rows tie."""
    cells = F.array(*[F.struct(F.lit(f"m{i}").alias("model"), F.round(F.get("embedding", F.lit(i)).cast("double"), 2).alias("score"))
                      for i in range(N_MODELS)])
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("label"), F.inline(cells))


_SCORED = "scored AS (" + " UNION ALL ".join(
    f"SELECT label % 2 AS label, 'm{i}' AS model, round(embedding[{i + 1}]::DOUBLE, 2) AS score FROM embeddings" for i in range(N_MODELS)) + ")"
_RANKED = f"""{_SCORED}, g AS (SELECT model, score AS threshold, sum(label)::BIGINT AS pos, count(*) - sum(label)::BIGINT AS neg FROM scored GROUP BY model, score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n,
  lead(pos) OVER (PARTITION BY model ORDER BY threshold DESC) AS npos, lead(neg) OVER (PARTITION BY model ORDER BY threshold DESC) AS nneg
  FROM g WINDOW w AS (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


def _round9(df: DataFrame, *columns: str) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.round(c, 9)), columns, df)


@query("roc_curve", f"""WITH {_RANKED} SELECT model, threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM c
WHERE npos IS NULL OR npos <> pos OR nneg <> neg UNION ALL SELECT DISTINCT model, NULL, 0, 0 FROM scored""")
def roc_curve(spark, sf_dir):
    return _round9(curves.roc_curve(scored(spark, sf_dir)), "fpr", "tpr")


@query("area_under_roc", """WITH {s}, a AS (SELECT model, score, label FROM scored)
SELECT p.model, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 9) AS auc
FROM a p JOIN a n ON p.model = n.model AND p.label = 1 AND n.label = 0 GROUP BY p.model""".format(s=_SCORED))
def area_under_roc(spark, sf_dir):
    return _round9(curves.area_under_roc(scored(spark, sf_dir)), "auc")


@query("roc_micro_average", """WITH {s}, a AS (SELECT score, label FROM scored)
SELECT 'all' AS model, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 9) AS auc
FROM a p JOIN a n ON p.label = 1 AND n.label = 0""".format(s=_SCORED))
def roc_micro_average(spark, sf_dir):
    return _round9(curves.area_under_roc(scored(spark, sf_dir).withColumn("model", F.lit("all"))), "auc")


@query("precision_recall_curve", f"""WITH {_RANKED} SELECT model, threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM c
WHERE tp - pos < p UNION ALL SELECT DISTINCT model, NULL, 1, 0 FROM scored""")
def precision_recall_curve(spark, sf_dir):
    return _round9(curves.precision_recall_curve(scored(spark, sf_dir)), "precision", "recall")


@query("stratified_folds", """WITH y AS (SELECT doc_id, quality AS label, row_number() OVER (ORDER BY quality, doc_id) - 1 AS pos,
  row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS r FROM labels),
a AS (SELECT label, count(*) FILTER (WHERE pos % 2 = 0) AS f0 FROM y GROUP BY label)
SELECT doc_id, label, CASE WHEN r < f0 THEN 0 ELSE 1 END AS fold FROM y JOIN a USING (label)""")
def folds(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return stratified_folds(rows)


@query("learning_curve_prefixes", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT percent, count(*) AS rows, max(doc_id) AS last_id FROM r JOIN (SELECT unnest(range(10, 101, 10)) AS percent) ON pos < floor(n * percent / 100) GROUP BY percent""")
def learning_curve_prefixes(spark, sf_dir):
    ranked = with_rank(table(spark, sf_dir, "documents").select("doc_id"), [], "doc_id")
    steps = F.filter(F.sequence(F.lit(10), F.lit(100), F.lit(10)), lambda p: F.col("_rank") < F.floor(F.col("_size") * p / 100))
    return ranked.select("doc_id", F.explode(steps).alias("percent")).groupBy(F.col("percent").cast("bigint").alias("percent")).agg(
        F.count("*").alias("rows"), F.max("doc_id").alias("last_id"))
