import numpy as np

from opinaria.llm.toxicity import best_threshold, features_of, fit_chain, fit_linear, Rows, score, train

SF = "/root/testdata/sf0.1"
MARKED = {"stupid", "disgusting", "clown", "trash", "moron", "worthless", "scum", "pathetic", "idiot", "loser"}


def test_features_are_distinct_words():
    assert len(features_of("A b a-B, É é".encode())) == 4 and len(features_of(None)) == 0
    assert len(features_of(b"abcdefg abcdxyz ABCDEFG")) == 2 + 1 + 2


def test_linear_model_finds_the_word():
    draw = np.random.default_rng(0)
    cells = [(r, f) for r in range(600) for f in draw.choice(50, 8, replace=False)]
    row, feature = map(np.array, zip(*cells))
    y = np.zeros(600)
    y[row[feature == 7]] = 1
    model = fit_linear(Rows(row, feature, 600, 50), np.zeros((600, 0)), y)
    p = model.predict(Rows(row, feature, 600, 50), np.zeros((600, 0)))
    assert model.weights[7] > 3 * np.abs(np.delete(model.weights, 7)).max() and ((p > 0.5) == y).all()
    assert 0.5 <= best_threshold(y, p) < 0.7 and best_threshold(np.zeros(3), np.zeros(3)) == 0.5


def sparse_rows(n, width, seed):
    draw = np.random.default_rng(seed)
    cells = [(r, f) for r in range(n) for f in sorted(draw.choice(width, 6, replace=False))]
    row, feature = map(np.array, zip(*cells))
    return Rows(row, feature, n, width), draw


def test_linear_model_meets_the_conditions_of_its_minimum():
    rows, draw = sparse_rows(400, 30, 1)
    dense = np.zeros((400, 30))
    dense[rows.row, rows.feature] = 1
    earlier = draw.random((400, 1))
    y = (dense[:, 3] + earlier[:, 0] + draw.normal(0, 0.4, 400) > 0.8).astype(float)
    l1 = 5e-3
    model = fit_linear(rows, earlier, y, l1=l1, rounds=6000)
    rarity = np.log(401 / (1 + dense.sum(axis=0)))
    w = model.weights / rarity
    p = 1 / (1 + np.exp(-((dense * rarity) @ w + earlier @ model.chained + model.bias)))
    slope = (dense * rarity).T @ (p - y) / 400
    assert (w != 0).any() and (w == 0).any()
    assert np.abs(slope[w != 0] + l1 * np.sign(w[w != 0])).max() < 1e-5
    assert np.abs(slope[w == 0]).max() < l1 + 1e-5
    assert abs((p - y).mean()) < 1e-5 and np.abs(earlier.T @ (p - y) / 400).max() < 1e-5


def test_chain_equals_a_plain_restatement():
    rows, draw = sparse_rows(300, 20, 2)
    has = np.zeros((300, 20), bool)
    has[rows.row, rows.feature] = True
    first = (has[:, 2] | has[:, 5]).astype(float)
    second = np.where(draw.random(300) < 0.2, np.nan, (has[:, 2] & (draw.random(300) < 0.9)).astype(float))
    labels, fold = np.column_stack([first, second]), np.arange(300) % 5
    words = np.sort(draw.integers(1, 1 << 60, 20).astype(np.uint64))
    chain = fit_chain(words, rows, labels, fold, ["a", "b"], 5)

    none, unseen = np.zeros((300, 0)), np.zeros(300)
    for part in range(5):  # each row's probability comes from a model that has not seen the row
        others = fit_linear(rows.take(fold != part), none[fold != part], first[fold != part])
        unseen[fold == part] = others.predict(rows.take(fold == part), none[fold == part])
    known = ~np.isnan(second)
    want = [fit_linear(rows, none, first), fit_linear(rows.take(known), unseen[known, None], second[known])]
    kept = np.any([m.weights != 0 for m in want], axis=0)
    for got, model in zip(chain.models, want):
        assert np.allclose(got.weights, model.weights[kept]) and np.allclose(got.chained, model.chained) and np.isclose(got.bias, model.bias)
    assert chain.thresholds[0] == best_threshold(first, unseen)

    scores = chain.scores([words[has[r]] for r in range(300)])
    for r in range(300):
        earlier = []
        for model in want:
            z = sum(model.weights[f] for f in range(20) if has[r, f]) + sum(c * p for c, p in zip(model.chained, earlier)) + model.bias
            earlier.append(1 / (1 + np.exp(-z)))
        assert np.allclose(scores[r], earlier)


def test_a_later_category_uses_the_earlier_one(spark):
    rows = [(k, "good words " + ("bad" if k % 3 == 0 else "fine") + f" w{k % 7}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 == 0)) for k in range(0, 300, 2)], "doc_id long, a int, b int")
    chain = train(docs, labels, ["a", "b"])
    assert chain.models[1].chained[0] > 0
    assert all(r.is_b == (r.doc_id % 3 == 0) for r in score(docs, chain).collect())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = train(docs, labels.where("doc_id % 3 <> 0"), ["quality", "toxic"])
    held = score(docs.join(labels, "doc_id").where("doc_id % 3 = 0"), chain).collect()
    marked = [bool(MARKED & set(r.text.lower().replace(".", " ").replace(",", " ").split())) for r in held]
    caught = [r.is_toxic for r, m in zip(held, marked) if m]
    false = [r.is_toxic for r, m in zip(held, marked) if not m and not r.toxic]
    assert np.mean(caught) > 0.97 and np.mean(false) < 0.01, (np.mean(caught), np.mean(false), len(caught), chain.thresholds)


def test_nulls_clashes_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "x y", 0.1)], "doc_id long, text string, p_toxic double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score(docs, train(docs, none, ["toxic"])).collect()
    assert len(got) == 3 and all(r.p_toxic < 0.01 and not r.is_toxic for r in got)
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    assert score(docs, train(docs, one, ["toxic"])).count() == 3
    assert score(docs.limit(0), train(docs.limit(0), one, ["toxic"])).collect() == []
