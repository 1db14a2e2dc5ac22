import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from opinaria.models import classifiers as C, selection as S
from opinaria.models.ensembles import AdaBoost, Bagging, WeightedVote
from opinaria.models.language import detect_language, fit_language_model
from opinaria.models.text_stages import ReviewCleaner
from opinaria.operators import vectorize as V
from opinaria.plans.reviews import Settings, review_table
from opinaria.session import cut_lineage, shared_dir
from opinaria.sources.dictionaries import boosters, negations

GOOD = ["produto muito bom recomendo para todos", "otimo produto chegou rapido adorei", "excelente qualidade recomendo muito bom",
        "adorei comprar aqui tudo perfeito", "superou minhas expectativas produto perfeito"]
BAD = ["produto ruim chegou quebrado nao funciona", "pessimo atendimento nao recomendo ruim", "terrivel demorou muito veio quebrado",
       "nao funciona pessima qualidade ruim demais", "acabamento ruim nao vale pena quebrado"]


def sentences(spark, copies=6):
    rows = [(i * 10 + j, f"{text} {'sim' if i % 2 else 'claro'}", float(label)) for i in range(copies)
            for j, (text, label) in enumerate([(t, 1) for t in GOOD] + [(t, 0) for t in BAD])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label double")


@pytest.fixture(scope="module")
def features(spark):
    rows = sentences(spark)
    spec = V.Vectorizer("Unigram", min_df=2, max_df=1.0)
    model, train, test = S.featurize(rows, rows, spec)
    return model, cut_lineage(train.select("doc_id", "label", "features")), cut_lineage(test.select("doc_id", "label", "features"))


@pytest.mark.parametrize("name", ["LogisticRegression", "RidgeClassifier", "MultinomialNB", "BernoulliNB", "LinearSVC",
                                  "DecisionTreeClassifier", "KerasClassifier"])
def test_classifiers_beat_the_majority(features, name):
    _, train, test = features
    model = C.BY_NAME[name].build(train.count(), len(train.first()["features"])).fit(train)
    assert S.accuracy_of(model.transform(test)) > 0.9


def test_ensembles(spark, features):
    _, train, test = features
    bag = Bagging(LogisticRegression(maxIter=10), 3).fit(train)
    boost = AdaBoost(DecisionTreeClassifier(maxDepth=1), 4).fit(train)
    assert S.accuracy_of(bag.transform(test)) > 0.9 and S.accuracy_of(boost.transform(test)) > 0.7
    path = shared_dir(spark)
    PipelineModel([bag]).save(path)
    again = PipelineModel.load(path)
    assert again.stages[0].weights == bag.weights and again.stages[0].uid == bag.uid
    assert [r["prediction"] for r in again.transform(test).orderBy("doc_id").collect()] == [
        r["prediction"] for r in bag.transform(test).orderBy("doc_id").collect()]


def test_boosting_say(spark):
    rows = [(Vectors.dense([float(x)]), float(y)) for x, y in [(0, 0), (1, 0), (2, 1), (3, 1), (4, 0)]]
    df = spark.createDataFrame(rows, ["features", "label"])
    model = AdaBoost(DecisionTreeClassifier(maxDepth=1, seed=0), 1).fit(df)
    from math import log
    assert model.weights == pytest.approx([log(0.8 / 0.2)])


def test_stratified_folds_and_grid_search(spark, features):
    _, train, _ = features
    folded = S.stratified_folds(train)
    sizes = {(r["label"], r["fold"]): r["count"] for r in folded.groupBy("label", "fold").count().collect()}
    assert sizes == {(0.0, 0): 15, (0.0, 1): 15, (1.0, 0): 15, (1.0, 1): 15}
    model, chosen = S.grid_search(cut_lineage(folded), C.BY_NAME["MultinomialNB"], 1, {"alpha": [0.5, 1.0]})
    assert chosen["alpha"] in (0.5, 1.0) and S.accuracy_of(model.transform(train)) > 0.9


def test_comparison_keeps_failures(spark, features):
    _, train, test = features
    broken = C.Classifier("x", "Broken", lambda n, d: LogisticRegression(featuresCol="nothing"), {})
    rows = S.compare({"Unigram": (train, test)}, [broken, C.BY_NAME["MultinomialNB"]], {"Unigram": 1})
    assert rows[0]["accuracy"] is None and rows[1]["accuracy"] > 0.9
    assert S.results_frame(spark, rows).count() == 2


def test_vote_search(features):
    _, train, test = features
    n, d = train.count(), len(train.first()["features"])
    voters = []
    for name in ("LogisticRegression", "MultinomialNB", "BernoulliNB"):
        estimator = C.BY_NAME[name].build(n, d)
        voters.append((name, lambda e=estimator: e, estimator.fit(train)))
    best = S.best_vote(voters, train, test)
    assert len(best["members"]) == 3 and best["weighted"] > 0.9


def test_saved_model_scores_raw_sentences(spark):
    rows = sentences(spark)
    cleaner = ReviewCleaner("text", "clean", ["para", "aqui"])
    cleaned = cut_lineage(cleaner.transform(rows).drop("text"))
    model, train, _ = S.featurize(cleaned, cleaned, V.Vectorizer("TF-IDF Bigram", high=2, tfidf=True, min_df=2, max_df=1.0), text="clean")
    whole = PipelineModel([cleaner, *model.stages, LogisticRegression(maxIter=20).fit(train)])
    calls = []

    def fit():
        calls.append(1)
        return whole
    base = shared_dir(spark)
    for data in (rows, rows, rows.filter("doc_id > 3")):
        loaded = S.fit_or_load(spark, base, {"m": 1}, data, fit)
    assert len(calls) == 2                                   # other rows, other key
    new = spark.createDataFrame([(1, "Produto MUITO bom, adorei! Recomendo."), (2, "Péssimo, veio quebrado e não funciona")], "doc_id bigint, text string")
    assert [r["prediction"] for r in loaded.transform(new).orderBy("doc_id").collect()] == [1.0, 0.0]


def test_ml_stages_equal_the_long_form(spark):
    rows = sentences(spark)
    spec = V.Vectorizer("TF-IDF Bigram", high=2, tfidf=True, min_df=2, max_df=0.9)
    docs = rows.select("doc_id", spec.terms(F.col("text")).alias("terms"))
    vocab = cut_lineage(V.fit_vocabulary(docs, spec))
    long = V.tfidf(V.count_terms(docs, vocab), vocab, F.lit(rows.count())).join(vocab.select("term", "idx"), "term")
    want = {(r["doc_id"], r["idx"]): r["value"] for r in long.collect()}
    vectors = PipelineModel(V.ml_stages(vocab, spec, rows.count())).transform(docs).collect()
    got = {(r["doc_id"], int(i)): float(v) for r in vectors for i, v in zip(r["features"].indices, r["features"].values)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_language(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the house and the garden", "en"), ("what is that thing", "en"), ("la maison et le jardin", "fr"),
                                                   ("que est ce que tu fais", "fr")] * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit_language_model(df)
    new = spark.createDataFrame([(1, "the thing and the house"), (2, "le jardin et la maison"), (3, "the house amei")], "doc_id bigint, text string")
    assert [r["language"] for r in detect_language(new, model).orderBy("doc_id").collect()] == ["en", "fr", "pt"]


def test_review_table(spark):
    rows = [(1, "B2W", "Bom", "produto muito bom adorei recomendo demais mesmo", 5.0), (2, "B2W", "Bom", "produto muito bom adorei recomendo demais mesmo", 5.0),
            (3, "ReclameAqui", None, "atendimento ruim produto quebrado entrega demorada pessima", 4.0), (4, "B2W", "x", "curto", 1.0)]
    reviews = spark.createDataFrame(rows, "doc_id bigint, source string, title string, text string, rating double")
    lexicon = spark.createDataFrame([("bom", 2.0), ("ruim", -2.0), ("quebrado", -1.5)], "word string, measure double")
    out = review_table(reviews, lexicon, boosters(spark), negations(spark), settings=Settings(stop_words=["muito"]),
                       detect=lambda d: d.withColumn("language", F.lit("pt"))).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["sentiment"], r["leia"], r["language"]) for r in out] == [(1, "positive", "positive", "pt"), (3, "negative", "negative", "pt")]
    assert out[0]["length"] == len(out[0]["text"]) and "muit" not in out[0]["text"]


def test_bayes_from_counts_equals_the_estimator(spark):
    import random

    from pyspark.ml.classification import NaiveBayes

    from opinaria.models import bayes as B
    draw = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(draw.choices(words[: 9 + 3 * (i % 2)], k=draw.randint(1, 8))), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    train, test = df.filter("doc_id < 80"), df.filter("doc_id >= 80")
    spec = V.Vectorizer("Unigram", min_df=1, max_df=1.0)
    vocab, seen, new = S.long_features(train, test, spec)
    model, a, b = S.featurize(train, test, spec)
    parts = cut_lineage(train.select("doc_id", "label", (F.floor(F.col("doc_id") / 2) % 2).cast("int").alias("part")))
    for bernoulli in (False, True):
        above = 0.0 if bernoulli else None
        stats = B.statistics(seen, parts, vocab, 2, present_above=above)
        trials = [B.Trial((0, 1), 1.0), B.Trial((0,), 0.25), B.Trial((1,), 0.0)]
        found = B.predictions(new, test.select("doc_id", "label"), *B.log_weights(stats, trials, bernoulli), present_above=above)
        got = {r["doc_id"]: (r["scores"], r["preds"]) for r in found.collect()}
        for k, t in enumerate(trials):
            rows_of = a.filter((F.floor(F.col("doc_id") / 2) % 2).isin(*t.parts)).withColumn("label", F.col("label").cast("double"))
            name = "BernoulliNB" if bernoulli else "MultinomialNB"
            scored = C.BY_NAME[name].build(1, 1, alpha=t.alpha).fit(rows_of).transform(b)
            for r in scored.collect():
                scores, preds = got[r["doc_id"]]
                assert preds[k] == r["prediction"] or abs(scores[2 * k] - scores[2 * k + 1]) < 1e-9
                assert scores[2 * k : 2 * k + 2] == pytest.approx(list(r["rawPrediction"]), abs=1e-6)


def test_grid_and_curve_from_counts_equal_refits(spark):
    import random

    from opinaria.models import bayes as B
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choices([f"w{k}" for k in range(8 + 4 * (i % 2))], k=6)), i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    train, test = cut_lineage(df.filter("doc_id < 100")), cut_lineage(df.filter("doc_id >= 100"))
    spec = V.Vectorizer("Unigram", min_df=1, max_df=1.0)
    vocab, seen, new = S.long_features(train, test, spec)
    folded = cut_lineage(S.stratified_folds(train))
    _, a, b = S.featurize(train, test, spec)
    a = cut_lineage(a.withColumn("label", F.col("label").cast("double")).join(folded.select("doc_id", "fold"), "doc_id").select("doc_id", "label", "fold", "features"))
    b = cut_lineage(b.withColumn("label", F.col("label").cast("double")).select("doc_id", "label", "features"))
    alphas = [0.01, 1.0]
    got = B.grid_scores(seen, folded.select("doc_id", "label", "fold"), vocab, alphas)
    for alpha, accuracy in zip(alphas, got):
        refits = [S.accuracy_of(C.BY_NAME["MultinomialNB"].build(1, 1, alpha=alpha).fit(a.filter(F.col("fold") != f)).transform(a.filter(F.col("fold") == f))) for f in (0, 1)]
        assert accuracy == pytest.approx(sum(refits) / 2)
    ranked = cut_lineage(S.with_rank(train.select("doc_id", "label"), [], "doc_id"))
    curve = {r["percent"]: r["error"] for r in B.learning_curve(seen, ranked, new, test, vocab, steps=4).collect()}
    want = {r["percent"]: r["error"] for r in S.learning_curve(a, b, C.BY_NAME["MultinomialNB"].build(1, 1), steps=4).collect()}
    assert curve == pytest.approx(want)


def test_stumps_equal_a_scan_of_all_splits(spark):
    import random
    from math import exp, log

    from opinaria.models import stumps as ST
    draw = random.Random(11)
    data = [([float(draw.choice([0, 0, 0, 1, 2, -1])) for _ in range(5)], draw.randint(0, 1)) for _ in range(60)]
    data = [(x, int(x[2] > 0) if draw.random() < 0.8 else y) for x, y in data]
    df = spark.createDataFrame([(k, Vectors.dense(x), float(y)) for k, (x, y) in enumerate(data)], ["doc_id", "features", "label"])
    w, want = [1 / len(data)] * len(data), []
    for _ in range(13):
        best = None
        for i in range(5):
            values = sorted({x[i] for x, _ in data})
            for lo, hi in zip(values, values[1:]):
                sides = [[sum(v for v, (x, y) in zip(w, data) if (x[i] <= lo) == below and y == label) for label in (0, 1)] for below in (True, False)]
                gini = sum(a * b / (a + b) if a + b > 0 else 0 for a, b in sides)
                found = (round(gini, 10), i, (lo + hi) / 2, [int(b > a) for a, b in sides], sum(min(s) for s in sides))
                best = min(best or found, found)
        _, i, cut, (below, above), error = best
        say = log((1 - error) / error)
        want.append((i, cut, below, above, pytest.approx(say)))
        w = [v * exp(say) if (below if x[i] <= cut else above) != y else v for v, (x, y) in zip(w, data)]
        w = [v / sum(w) for v in w]
    rows = df.select("doc_id", F.col("label").cast("int").alias("label"), ST.cells_of().alias("cells"))
    stumps, weighted = ST.boost(rows, 13)
    assert [(s.feature, s.threshold, s.below, s.above, s.say) for s in stumps] == want
    assert [r["w"] for r in weighted.orderBy("doc_id").collect()] == pytest.approx(w)
    model = ST.StumpBoost(13).fit(df)
    path = shared_dir(spark)
    model.save(path)
    again = ST.StumpVote.load(path)
    for x, r in zip([x for x, _ in data], again.transform(df).orderBy("doc_id").collect()):
        votes = sum((1 if (b if x[i] <= t else a) else -1) * s.say for (i, t, b, a, _), s in zip(want, stumps))
        assert r["prediction"] == float(votes > 1e-12)


def test_stumps_of_pure_and_constant_rows(spark):
    from opinaria.models import stumps as ST
    pure = spark.createDataFrame([(Vectors.dense([1.0]), 1.0)] * 4, ["features", "label"])
    assert [(s.feature, s.below, s.error) for s in ST.boost(pure.select(F.col("label").cast("int").alias("label"), ST.cells_of().alias("cells")), 5)[0]] == [(-1, 1, 0.0)]
    even = spark.createDataFrame([(Vectors.dense([0.0]), float(k % 2)) for k in range(6)], ["features", "label"])
    assert {r["prediction"] for r in ST.StumpBoost(5).fit(even).transform(even).collect()} == {0.0}


def test_search_goes_on_where_it_was(spark, monkeypatch):
    from opinaria.models import search as SE
    rows = sentences(spark, copies=8)
    train, test = rows.filter("doc_id % 4 < 3"), rows.filter("doc_id % 4 = 3")
    specs = [V.Vectorizer("Unigram", min_df=2, max_df=1.0), V.Vectorizer("One", min_df=2, max_df=1.0, max_features=1)]
    constant = C.Classifier("x", "Shrunk", lambda n, d, C=1e-9: LogisticRegression(regParam=1 / C, elasticNetParam=1.0, threshold=0.99), {"C": [1e-9]})
    broken = C.Classifier("x", "Broken", lambda n, d: LogisticRegression(featuresCol="nothing"), {})
    small = C.Classifier("linear_model", "LogisticRegression", C.BY_NAME["LogisticRegression"].build, {"C": [0.5, 1.0]})
    tried = [small, C.BY_NAME["MultinomialNB"], C.BY_NAME["BernoulliNB"], constant, broken]
    folder = shared_dir(spark)
    fits = []
    real = SE._fit_and_score
    monkeypatch.setattr(SE, "_fit_and_score", lambda c, f, p: fits.append(c.name) or real(c, f, p))

    def lost(*_):
        raise KeyboardInterrupt
    vote = SE._vote
    monkeypatch.setattr(SE, "_vote", lost)
    with pytest.raises(KeyboardInterrupt):
        SE.model_search(train, test, specs, tried, folder)
    before = len(fits)
    assert before >= 2 * 5 + 3
    monkeypatch.setattr(SE, "_vote", vote)
    out = SE.model_search(train, test, specs, tried, folder).collect()
    first = [r for r in out if r["phase"] == "first"]
    assert len(first) == 10 and {r["c_name"] for r in first if r["accuracy"] is None} == {"x.Broken"}
    assert all("IllegalArgument" in r["error"] or "nothing" in r["error"] for r in first if r["c_name"] == "x.Broken")
    final = {(r["v_name"], r["c_name"]): r for r in out if r["phase"] == "final"}
    names = {"linear_model.LogisticRegression", "naive_bayes.MultinomialNB", "naive_bayes.BernoulliNB"}
    assert {c for _, c in final} == names
    grids = {(r["v_name"], r["c_name"], r["params"]): r["accuracy"] for r in out if r["phase"] == "grid"}
    votes = [r for r in out if r["phase"] == "vote"]
    assert {r["v_name"] for r in votes} == {v for v, _ in final} and all(r["accuracy"] > 0.9 for r in votes)
    for (v, c), r in final.items():
        assert grids[v, c, r["params"]] == max(a for (w, d, _), a in grids.items() if (w, d) == (v, c))
        assert r["flag"] == "*"
    done = len(fits)
    again = SE.model_search(train, test, specs, tried, folder).collect()
    assert sorted(again) == sorted(out) and len(fits) == done


def test_search_trains_on_all_rows(spark, monkeypatch):
    """Only the 20,000 rows with the smallest hashes were kept (F21)."""
    from opinaria.models import search as SE
    rows = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), (F.col("id") % 2).cast("double").alias("label"))
    seen = []

    def stopped(state, spec, train, test, contamination):
        seen.append((train.count(), train.select("doc_id").distinct().count(), test.count()))
        raise KeyboardInterrupt
    monkeypatch.setattr(SE, "features_of", stopped)
    with pytest.raises(KeyboardInterrupt):
        SE.model_search(rows, rows.limit(3), [V.Vectorizer("Unigram")], [C.BY_NAME["MultinomialNB"]], shared_dir(spark))
    assert seen == [(20_500, 20_500, 3)]


def test_search_drops_outliers_before_training(spark):
    from opinaria.models import search as SE
    rows = [(i, [0, 1], [1.0 + (i % 3), 2.0]) for i in range(60)] + [(99, [5, 6], [40.0, 50.0])]
    train = spark.createDataFrame([(r[0], 0.0) for r in rows], "doc_id bigint, label double")
    cells = spark.createDataFrame([(i, k, v) for i, idx, val in rows for k, v in zip(idx, val)], "doc_id bigint, idx int, value double")
    kept = {r["doc_id"] for r in SE.inlying(train, cells, contamination=0.02).collect()}
    assert 99 not in kept and len(kept) >= 59


def test_char_grams_are_all_substrings(spark):
    from opinaria.models.language import char_grams

    texts = ["", "a", "Äb", "😀 aé\nB", "xyz" * 40_000]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "i int, text string").select("i", char_grams(F.col("text")).alias("g")).collect()
    for r in rows:
        t = (texts[r.i] if r.i < 9 else "").lower()
        assert r.g == [t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)]


def test_vocabulary_by_lengths_is_that_of_all_terms(spark):
    """Longer terms are counted only where their parts are frequent; the vocabulary is that of counting every term."""
    from itertools import combinations
    from collections import Counter

    said = [[f"w{int((k * 7919 + i * i * 31) ** 0.5 * 10) % (3 + i % 9)}" for i in range(5 + k % 23)] for k in range(120)] + [[], ["w0"], None]
    rows = spark.createDataFrame([(k, None if t is None else " ".join(t)) for k, t in enumerate(said)], "doc_id int, text string")
    for spec in (V.Vectorizer("a", 3, min_df=3, max_features=40), V.Vectorizer("b", 3, skip=2, min_df=3, max_features=40),
                 V.Vectorizer("c", 2, skip=2, min_df=3, max_features=4000), V.Vectorizer("d", 3, min_df=2, max_df=0.2, max_features=25)):
        tf, df = Counter(), Counter()
        for t in said:
            grams = []
            for n in range(1, spec.high + 1):
                for i in range(len(t or []) - n + 1):
                    grams += [" ".join(t[j] for j in (i, *rest)) for rest in combinations(range(i + 1, min(i + n + (spec.skip or 0), len(t))), n - 1)]
            tf.update(grams)
            df.update(set(grams))
        kept = sorted((g for g in tf if spec.min_df <= df[g] <= spec.max_df * len(said)), key=lambda g: (-tf[g], g))[:spec.max_features]
        wanted = [(g, i, df[g], tf[g]) for i, g in enumerate(sorted(kept))]
        terms = rows.select(spec.terms(F.col("text")).alias("terms"))
        assert sorted(map(tuple, V.fit_vocabulary(terms, spec).collect())) == wanted, spec
        assert any(" " in g for g in kept)


def test_rare_terms_do_not_leave_their_row(spark, monkeypatch):
    """Of 4,000 different pairs and triples only those of frequent words are counted."""
    rows = spark.createDataFrame([("alpha beta gamma " + " ".join(f"rare{k}x{i}" for i in range(40)),) for k in range(50)], "text string")
    counted, made = V._counted, []

    def seen(docs, terms, with_rows):
        out = counted(docs, terms, with_rows)
        made.append(out.count())
        return out

    monkeypatch.setattr(V, "_counted", seen)
    spec = V.Vectorizer("t", 3, max_df=1.0, max_features=3)
    found = V.fit_vocabulary(rows.select(spec.terms(F.col("text")).alias("terms")), spec)
    assert [r.term for r in found.orderBy("term").collect()] == ["alpha", "alpha beta", "alpha beta gamma"] and sum(made[1:]) < 100


def test_block_sums_equal_sums_over_rows(spark, monkeypatch):
    from math import exp

    from opinaria.models import stumps as ST

    monkeypatch.setattr(ST, "BLOCK", 7)
    made = [(i % 2 if i % 9 else None, [(f, float((i * f) % 4 - 1)) for f in (0, 2, 5) if (i * f) % 4 != 1 and (i + f) % 3]) for i in range(60)] + [(1, []), (0, None), (1, None)]
    rows = spark.createDataFrame(made, "label int, cells array<struct<i int, v double>>").repartition(3)
    pairs = ST.Pairs.of(rows, len(made))
    stumps = [ST.Stump(2, -0.5, 0, 1, 0.3, 0.7), ST.Stump(5, 1.0, 1, 0, 0.3, 0.4), ST.Stump(-1, 0.0, 1, 1, 0.3, 0.2)]
    w1, w0 = ST.sums_of(ST.in_blocks(rows, pairs), pairs, stumps, 0.5, 2.0)
    want = {}
    for label, cells in made:
        held = dict(cells or [])
        votes = [s.below if s.feature < 0 or held.get(s.feature, 0.0) <= s.threshold else s.above for s in stumps]
        weight = 0.25 * exp(sum(s.say for s, vote in zip(stumps, votes) if label is not None and vote != label))
        for cell in held.items():
            want.setdefault(cell, [0.0, 0.0])[0 if label == 1 else 1] += weight
    assert list(zip(pairs.i.tolist(), pairs.v.tolist())) == sorted(want)
    for k, cell in enumerate(sorted(want)):
        assert (w1[k], w0[k]) == pytest.approx(want[cell])
    by_rows = rows.withColumn("w", F.lit(0.5)).withColumn("w", ST.weight_of(stumps, 2.0))
    assert sum(r["w"] for r in by_rows.collect()) > 0
