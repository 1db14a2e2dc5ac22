"""Folds, grid search, the two-pass comparison, vote search and fit-or-load."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from opinaria import schemas
from opinaria.models.classifiers import Classifier
from opinaria.models.ensembles import AdaBoost, Bagging, WeightedVote
from opinaria.models.stumps import StumpBoost
from opinaria.models.text_stages import TermExtractor
from opinaria.operators import voting
from opinaria.operators.quantiles import running_sums
from opinaria.operators.results import weighted_accuracy
from opinaria.operators.vectorize import Vectorizer, count_terms, fit_vocabulary, ml_stages, robust_scale, term_scales, tfidf
from opinaria.session import computed, cut_lineage, fits_broadcast

FOLDS = 2


def with_rank(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Adds ``_rank`` (0-based, ascending id within the keys) and ``_size``, through bucketed running
    sums: no task sorts a whole class. Ids are unique; those that are no numbers are put in the order of their hashes."""
    number = isinstance(df.schema[id_col].dataType, NumericType)
    order = F.col(id_col) if number else F.xxhash64(id_col)
    keyed = cut_lineage(df.select(*keys, id_col, order.alias("_order"), F.lit(1).cast("bigint").alias("one")))
    ranked = running_sums(keyed, keys, "_order", ["one"]).select(*keys, id_col, "cum_one")
    if keys:
        sizes = keyed.groupBy(*keys).agg(F.count("*").alias("_size"))
        ranked = ranked.join(F.broadcast(sizes), list(keys))
    else:
        ranked = ranked.withColumn("_size", keyed.agg(F.count("*")).scalar())
    ranks = ranked.select(id_col, "_size", (F.col("_size") - F.col("cum_one")).alias("_rank"))
    return df.join(ranks, id_col)


def stratified_folds(df: DataFrame, label: str = "label", id_col: str = "doc_id", folds: int = FOLDS) -> DataFrame:
    """Adds ``fold``: each class is cut, in id order, into runs whose sizes keep both the classes and the
    folds balanced. Labels are few."""
    ranked = with_rank(df, [label], id_col)
    before = df.groupBy(label).agg(F.count("*").alias("_n"))
    starts = {r[label]: r["_n"] for r in before.collect()}
    fold, start = None, 0
    for value in sorted(starts):
        n = starts[value]
        # class rows take positions start..start+n-1 of the sorted labels, dealt to folds in turn
        sizes = [len(range(start + (i - start) % folds, start + n, folds)) for i in range(folds)]
        upper, branch = 0, None
        for i, size in enumerate(sizes):
            upper += size
            cond = F.col("_rank") < upper
            branch = F.when(cond, i) if branch is None else branch.when(cond, i)
        cond = F.col(label) == value
        fold = F.when(cond, branch) if fold is None else fold.when(cond, branch)
        start += n
    return ranked.withColumn("fold", fold.cast("int")).drop("_rank", "_size")


def accuracy_of(predictions: DataFrame, label: str = "label") -> float:
    return predictions.agg(F.avg((F.col("prediction") == F.col(label)).cast("int"))).first()[0]


def balanced_accuracy_of(predictions: DataFrame, label: str = "label") -> float:
    per_class = predictions.groupBy(label).agg(F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("r"))
    return per_class.agg(F.avg("r")).first()[0]


def featurize(train: DataFrame, test: DataFrame, spec: Vectorizer, text: str = "text",
              id_col: str = "doc_id") -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit vocabulary and scaling on ``train``; transform both by shuffle-free ML stages."""
    terms = TermExtractor(text, "terms", spec.high, -1 if spec.skip is None else spec.skip)
    docs = terms.transform(train).select(id_col, "terms")
    vocab = cut_lineage(fit_vocabulary(docs, spec))
    n_docs = train.count()
    counts = count_terms(docs, vocab, id_col)
    long = tfidf(counts, vocab, F.lit(n_docs), id_col) if spec.tfidf else counts.withColumn("value", F.col("tf").cast("double"))
    scales = term_scales(cut_lineage(long.select("term", "value")), F.lit(n_docs))
    model = PipelineModel([terms, *ml_stages(vocab, spec, n_docs, scales)])
    return model, model.transform(train), model.transform(test)


def long_features(train: DataFrame, test: DataFrame, spec: Vectorizer, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, training cells, test cells) in long form: id, term, value, scaled as :func:`featurize` scales, for models that are counts."""
    def docs(df: DataFrame) -> DataFrame:
        return computed(df.select(id_col, text), terms=spec.terms(F.col(text))).select(id_col, "terms")

    vocab = cut_lineage(fit_vocabulary(docs(train), spec))
    n_docs = F.lit(train.count())
    small = fits_broadcast(vocab)

    def cells(df: DataFrame) -> DataFrame:
        counts = count_terms(docs(df), vocab, id_col, bounded=small)
        return tfidf(counts, vocab, n_docs, id_col) if spec.tfidf else counts.withColumn("value", F.col("tf").cast("double"))

    seen = cut_lineage(cells(train).select(id_col, "term", "value"))
    scales = cut_lineage(term_scales(seen, n_docs))
    return vocab, cut_lineage(robust_scale(seen, scales)), cut_lineage(robust_scale(cells(test).select(id_col, "term", "value"), scales))


def compare(tables: dict[str, tuple[DataFrame, DataFrame]], classifiers: Sequence[Classifier], n_features: dict[str, int],
            params: dict[str, dict] | None = None, label: str = "label") -> list[dict]:
    """First pass: every classifier with default parameters on every (train, test) pair. A failing fit
    leaves a row without accuracy and with its error."""
    out = []
    for v_name, (train, test) in tables.items():
        n = train.count()
        for c in classifiers:
            row = {"v_name": v_name, "c_name": c.c_name, "accuracy": None, "train_time": -1.0, "predict_time": -1.0, "flag": ""}
            try:
                t = time.time()
                model = c.build(n, n_features[v_name], **(params or {}).get(c.name, {})).fit(train)
                row["train_time"] = time.time() - t
                t = time.time()
                row["accuracy"] = accuracy_of(model.transform(test), label)
                row["predict_time"] = time.time() - t
            except Exception as error:  # a classifier may not suit the features
                row["error"] = f"{type(error).__name__}: {error}"[:500]
            out.append(row)
    return out


def results_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The rows of ``compare`` with the message of a failed fit in ``error``."""
    schema = StructType([*schemas.RESULTS.fields, StructField("error", StringType())])
    return spark.createDataFrame([tuple(r.get(n) for n in schema.fieldNames()) for r in rows], schema)


def grid_search(train: DataFrame, c: Classifier, n_features: int, grid: dict[str, list] | None = None,
                fold_col: str = "fold", label: str = "label") -> tuple[Model, dict]:
    """Two-fold search over the classifier's grid; the winner is refitted on all of ``train``.

    Where every grid value is an estimator of its own (layers, base learners), the folds are
    scored one estimator at a time over the same cached table.
    """
    spec = c if grid is None else Classifier(c.family, c.name, c.build, grid)
    n = train.count()
    best, chosen = None, {}
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy", labelCol=label)
    for params in spec.combinations():
        estimator = spec.build(n, n_features, **params)
        score = _cross_score(estimator, train, fold_col, evaluator)
        if best is None or score > best:
            best, chosen = score, params
    return spec.build(n, n_features, **chosen).fit(train), chosen


def _cross_score(estimator: Estimator, train: DataFrame, fold_col: str, evaluator) -> float:
    if isinstance(estimator, CrossValidator):
        raise TypeError("pass the estimator, not a validator")
    if isinstance(estimator, (AdaBoost, Bagging, StumpBoost)):  # written in Python, which the validator cannot copy
        scores = []
        for i in range(FOLDS):
            model = estimator.fit(train.filter(F.col(fold_col) != i))
            scores.append(evaluator.evaluate(model.transform(train.filter(F.col(fold_col) == i))))
        return sum(scores) / len(scores)
    search = CrossValidator(estimator=estimator, estimatorParamMaps=[{}], evaluator=evaluator, numFolds=FOLDS,
                            foldCol=fold_col, parallelism=FOLDS)
    return search.fit(train).avgMetrics[0]


def vote_table(models: Sequence[Model], test: DataFrame, label: str = "label", id_col: str = "doc_id") -> DataFrame:
    """(row_id, label, voter, pred) of the fitted models."""
    voted = WeightedVote(models).votes(test)
    cells = F.array(*[F.struct(F.lit(i).alias("voter"), F.col(f"_vote{i}").cast("int").alias("pred")) for i in range(len(models))])
    return voted.select(F.col(id_col).alias("row_id"), F.col(label).cast("int").alias("label"), F.inline(cells))


def best_vote(models: Sequence[tuple[str, Callable[[], Estimator], Model]], train: DataFrame, test: DataFrame,
              label: str = "label", id_col: str = "doc_id") -> dict:
    """Score every subset of three or more voters in one query, refit the finalists, keep the one with
    the best weighted accuracy. A member of several finalists is refitted once: estimators are seeded."""
    n = len(models)
    voted = WeightedVote([m for _, _, m in models]).votes(test).withColumn("_label", F.col(label).cast("int"))
    patterns = cut_lineage(voting.pattern_counts(voted, [f"_vote{i}" for i in range(n)], "_label"))
    scores = voting.subset_scores(patterns, n, label="_label")
    top = voting.finalists(scores).orderBy(F.desc("accuracy"), "mask").collect()
    refits: dict[int, tuple[Model, float]] = {}
    for i in sorted({i for row in top for i in range(n) if row["mask"] >> i & 1}):
        start = time.time()
        model = models[i][1]().fit(train)
        refits[i] = (model, time.time() - start)
    best: dict = {"weighted": -1.0}
    for row in top:
        members = [i for i in range(n) if row["mask"] >> i & 1]
        start = time.time()
        vote = WeightedVote([refits[i][0] for i in members])
        weighted = weighted_accuracy(accuracy_of(vote.transform(test), label), row["accuracy"])
        if weighted > best["weighted"]:
            best = {"weighted": weighted, "accuracy": row["accuracy"], "model": vote, "members": [models[i][0] for i in members],
                    "train_time": sum(refits[i][1] for i in members), "predict_time": time.time() - start}
    return best


def learning_curve(train: DataFrame, test: DataFrame, estimator: Estimator, steps: int = 10, label: str = "label",
                   id_col: str = "doc_id") -> DataFrame:
    """Test error after fitting on the first 1/steps, 2/steps, ... of the training rows, for any estimator; naive Bayes needs no
    refits (``bayes.learning_curve``)."""
    ranked = cut_lineage(with_rank(train, [], id_col))
    rows = []
    for i in range(1, steps + 1):
        part = ranked.filter(F.col("_rank") < F.floor(F.col("_size") * i / steps)).drop("_rank", "_size")
        error = 1.0 - accuracy_of(estimator.fit(part).transform(test), label)
        rows.append((100 * i // steps, error))
    return train.sparkSession.createDataFrame(rows, "percent int, error double")


def one_vs_rest_scores(scored: DataFrame, model_name: str, raw: str = "rawPrediction", label: str = "label") -> DataFrame:
    """(model, score, label) of a binary classifier, for the curves."""
    return scored.select(F.lit(model_name).alias("model"), vector_to_array(raw)[1].alias("score"), F.col(label).cast("int").alias("label"))


def coefficients(model: Model, vocab: DataFrame) -> DataFrame:
    """(term, coefficient) of a linear model; as many rows as features."""
    values = [(i, float(c)) for i, c in enumerate(model.coefficients.toArray())]
    table = vocab.sparkSession.createDataFrame(values, "idx int, coefficient double")
    return vocab.select("term", "idx").join(F.broadcast(table), "idx").select("term", "coefficient")


def most_informative(coefs: DataFrame, n: int = 10, labels: Sequence[str] = ("negative", "positive")) -> DataFrame:
    """The ``n`` lowest and ``n`` highest coefficients, as words of the two classes."""
    low = coefs.orderBy("coefficient", "term").limit(n).select(F.lit(labels[0]).alias("class"), "*")
    high = coefs.orderBy(F.desc("coefficient"), "term").limit(n).select(F.lit(labels[1]).alias("class"), "*")
    return low.unionByName(high)


def fingerprint(df: DataFrame) -> Column:
    """Order-free digest of all rows."""
    # The sum tells apart what the exclusive or cancels: rows that occur an even number of times.
    cells = [F.to_json(c) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in df.columns]
    row = F.xxhash64(*cells)
    return df.agg(F.concat_ws("/", F.count("*").cast("string"), F.bit_xor(row).cast("string"),
                              F.sum(row.cast("decimal(20,0)")).cast("string")).alias("f")).first()["f"]


def fit_or_load(spark: SparkSession, base: str, params: dict, data: DataFrame, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The model saved for these parameters and this data, or a new fit saved under that key."""
    key = hashlib.sha256((json.dumps(params, sort_keys=True, default=str) + fingerprint(data)).encode()).hexdigest()
    path = f"{base}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return PipelineModel.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model
