from math import sqrt

import pytest
from pyspark.sql import functions as F

from opinaria.operators import lexicon as L
from opinaria.sources.dictionaries import boosters, negations

WORDS = [("bom", 2.0), ("otimo", 3.0), ("ruim", -2.0), ("pessimo", -3.0), ("quebrado", -1.5), ("util", 1.0), ("demais", 1.0)]


def compound(total):
    return total / sqrt(total * total + 15)


def run(spark, texts, rules=L.Rules(), emoji=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lexicon = spark.createDataFrame(WORDS, "word string, measure double")
    out = L.score_sentiment(docs, lexicon, boosters(spark), negations(spark), rules=rules, emoji=emoji)
    return [r for r in out.orderBy("doc_id").collect()]


CASES = {
    "produto bom": 2.0,
    "super bom": 2.293,
    "super ruim": -2.293,
    "quase bom": 2 - 0.293,
    "super lindo bom": 2 + 0.293 * 0.95,
    "super lindo novo bom": 2 + 0.293 * 0.9,
    "nao bom": 2 * -0.74,
    "nao muito bom": 2 * -0.74,
    "nao foi muito bom": 2 * -0.74,
    "nao foi assim muito bom": 2.0,
    "BOM produto": 2 + 0.733,
    "BOM PRODUTO": 2.0,                                     # all capitals carry no emphasis
    "SUPER bom": 2 + 0.293 + 0.733,
    "nunca este bom": 2 * 1.25,
    "uma coisa este bom": 2 * 1.25,                         # the word before counts alone at distance three
    "um dois muito mais bom": 2 + 0.293,                   # two-word booster, seen at distance three
    "bom!!": 2 + 0.584,
    "bom !!!!!!": 2 + 4 * 0.292,
    "bom ??": 2 + 0.36,
    "bom ?????": 2 + 0.96,
    "ruim!": -2 - 0.292,
    "bom mas ruim": 2 * 0.5 - 2 * 1.5,
    "bom entretanto ruim": 0.0,                             # only the first conjunction is looked for
    "bom xx yy zz nao bom": 2 + 2,                          # a repeated word takes its first neighbours
    "otimo, bom.": 5.0,
    "demais": 0.0,                                          # a booster scores nothing itself
    "produto": 0.0,
    "": 0.0,
}


@pytest.mark.parametrize("text", list(CASES))
def test_compound(spark, results, text):
    assert results[text]["raw_compound"] == pytest.approx(compound(CASES[text]), abs=1e-12)


@pytest.fixture(scope="module")
def results(spark):
    return dict(zip(CASES, run(spark, list(CASES))))


def test_shares(results):
    row = results["produto bom"]
    assert (row["pos"], row["neg"], row["neu"]) == (0.75, 0.0, 0.25)
    row = results[""]
    assert (row["compound"], row["pos"], row["neg"], row["neu"]) == (0.0, 0.0, 0.0, 0.0)
    assert results["produto bom"]["compound"] == 0.4588


def test_contrast_by_value(spark):
    # 2 and 1 before the conjunction: halving 2 gives another 1, and the next step finds that one first
    text = "bom util mas ruim"
    by_value = run(spark, [text])[0]["raw_compound"]
    plain = run(spark, [text], L.Rules(contrast_by_value=False))[0]["raw_compound"]
    assert by_value == pytest.approx(compound(2 * 0.5 * 0.5 + 1 - 3))
    assert plain == pytest.approx(compound(1 + 0.5 - 3))


def test_all_conjunctions_on_request(spark):
    row = run(spark, ["bom todavia ruim"], L.Rules(contrast=L.ALL_CONTRASTS))[0]
    assert row["raw_compound"] == pytest.approx(compound(1 - 3))


def test_emoji(spark):
    emoji = spark.createDataFrame([("😀", "muito bom"), (":-)", "bom")], "emoji string, description string")
    texts = ["produto 😀", "produto :-)"]
    late = [r["raw_compound"] for r in run(spark, texts, emoji=emoji)]
    early = [r["raw_compound"] for r in run(spark, texts, L.Rules(emoji_before_folding=True), emoji)]
    assert late == pytest.approx([0.0, compound(2)])
    assert early == pytest.approx([compound(2), compound(2)])


def test_label(spark):
    rows = spark.createDataFrame([(0.0,), (-0.1,), (0.2,)], "c double")
    assert [r[0] for r in rows.select(L.lexicon_label(rows["c"])).collect()] == ["positive", "negative", "positive"]


def test_scaling_by_value_equals_a_scan_from_the_left():
    import random

    from opinaria.operators.lexicon import scaled_by_value

    def slow(values, factors):
        state = list(values)
        for k in range(len(state)):
            first = state.index(state[k])
            state[first] *= factors[first]
        return state

    draw = random.Random(3)
    for _ in range(500):
        n = draw.randint(0, 40)
        at = draw.randint(0, n + 1)
        values = [draw.choice([2.0, 1.0, 0.5, 3.0, 1.5, -2.0, -1.0, 0.0]) for _ in range(n)]
        factors = [0.5 if k < at else 1.5 if k > at else 1.0 for k in range(n)]
        assert scaled_by_value(values, factors) == slow(values, factors)
    long = [draw.choice([1.0, 2.0, 0.5]) for _ in range(200_000)]
    assert len(scaled_by_value(long, [0.5] * 100_000 + [1.5] * 100_000)) == 200_000


def test_bucket_test_lets_every_known_word_through(spark):
    from pyspark.sql import functions as F

    from opinaria.operators.lexicon import bucket_test

    words = spark.range(3000).selectExpr("concat('word', id) as w")
    test = bucket_test(words, "w")
    assert words.filter(test(F.col("w"))).count() == 3000
    assert spark.range(5000).selectExpr("concat('other', id) as w").filter(test(F.col("w"))).count() < 200


def test_bucket_test_sends_bitmaps_to_the_driver(spark, monkeypatch):
    """A table that fills the buckets is a few rows at the driver, whose test lets the same words through as a set of buckets."""
    from opinaria.operators import lexicon as L

    words = spark.range(20_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
    kind, rows = type(words), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: rows.append(collect(self)) or rows[-1])
    test = L.bucket_test(words, "w")
    assert sum(map(len, rows)) <= 16
    monkeypatch.undo()
    bucket = F.pmod(F.xxhash64("w"), F.lit(L.KNOWN_BUCKETS))
    held = {r["b"] for r in words.select(bucket.alias("b")).distinct().collect()}
    others = spark.range(50_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("w"))
    for r in words.unionByName(others).select(test(F.col("w")).alias("t"), bucket.alias("b")).collect():
        assert r["t"] == (r["b"] in held)


def _random_texts(n):
    import random

    draw = random.Random(7)
    said = [w for w, _ in WORDS] + ["BOM", "RUIM", "SUPER", "super", "quase", "nao", "nunca", "entao", "este", "sem", "muito", "mais", "um", "pouco", "ou", "menos",
                                    "so", "o", "necessario", "mas", "dificilmente", "xx", "YY", "bom!", "?", "bem pouco", "a"]
    return ["".join(draw.choice(said) + draw.choice([" ", " ", "  ", "\n", ", "]) for _ in range(draw.randrange(25))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize("by_value", [True, False])
def test_workers_find_what_joins_find(spark, by_value, monkeypatch):
    """Hits went through a shuffle for each look-up, several times the texts (F1, F6-F10, F20). Rows that share an id, or have none, are one text."""
    texts = _random_texts(300)
    ids = [None, None, 3, 3, 3, 5, 5] + list(range(10, 10 + len(texts) - 7))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    lists = (spark.createDataFrame([*WORDS, ("super", 1.5)], "word string, measure double"), boosters(spark), negations(spark))
    rules = L.Rules(contrast_by_value=by_value)
    assert L._lists(*lists).paths is not None
    keep = ["doc_id", "emphasis", "n_words", "contrast_at", "pos", "word", "valence"]
    key = lambda rows: sorted(map(repr, rows))
    found = L.token_valences(docs, *lists, rules=rules).select(keep).collect()
    scored = L.score_sentiment(docs, *lists, rules=rules).selectExpr("doc_id", "round(raw_compound, 9)", "round(raw_pos, 9)", "round(raw_neg, 9)", "round(raw_neu, 9)").collect()
    monkeypatch.setattr(L, "WORKER_ROWS", 0)
    assert L._lists(*lists).paths is None
    assert key(found) == key(L.token_valences(docs, *lists, rules=rules).select(keep).collect()) and len(found) > 1000
    joined = L.score_sentiment(docs, *lists, rules=rules).selectExpr("doc_id", "round(raw_compound, 9)", "round(raw_pos, 9)", "round(raw_neg, 9)", "round(raw_neu, 9)").collect()
    assert key(scored) == key(joined)


def test_scores_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "super bom"), (2, "ruim mas bom")], "doc_id bigint, text string")
    lexicon = spark.createDataFrame(WORDS, "word string, measure double")
    plan = L.score_sentiment(docs, lexicon, boosters(spark), negations(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_batch_without_hits_scores_zero(spark):
    docs = spark.createDataFrame([(1, "xx yy!"), (2, "")], "doc_id bigint, text string").coalesce(1)
    lists = (spark.createDataFrame(WORDS, "word string, measure double"), boosters(spark), negations(spark))
    rows = L.score_sentiment(docs, *lists).orderBy("doc_id").collect()
    assert [(r["compound"], r["pos"], r["neg"], r["neu"]) for r in rows] == [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0)]
    assert [r["pos"] for r in L.token_valences(docs, *lists).collect()] == [-1, -1]


def test_a_word_with_two_measures_is_two_rows(spark):
    docs = spark.createDataFrame([(1, "bom")], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([("bom", 2.0), ("bom", 1.0)], "word string, measure double")
    rows = L.token_valences(docs, lexicon, boosters(spark), negations(spark)).filter("pos >= 0").collect()
    assert sorted(r["valence"] for r in rows) == [1.0, 2.0]


@pytest.mark.parametrize("held", [50, 1 << 22])
def test_frequent_pairs_equal_a_count_of_all_pairs(spark, monkeypatch, held):
    """All pairs of all texts were shuffled to find the few that are frequent (F1, F6-F10, F20)."""
    from collections import Counter

    from opinaria.operators import frequent

    import random

    draw = random.Random(2)
    rows = [[draw.choice("abcdefghijklmnopq") * draw.randrange(1, 3) for _ in range(draw.randrange(40))] for _ in range(120)] + [None, [], ["a"]]
    monkeypatch.setattr(frequent, "HELD", held)
    counts = Counter((a, b) for r in rows if r for a, b in zip(r, r[1:]))
    tokens = spark.createDataFrame([(r,) for r in rows], "w array<string>").repartition(3)
    found = {(r["w1"], r["w2"]): r["n"] for r in frequent.frequent_pairs(tokens, "w", 4).collect()}
    assert found == {k: n for k, n in counts.items() if n >= 4} and found
    some = frequent.frequent_pairs(tokens, "w", 4, lambda a, b: a < b).collect()
    assert {(r["w1"], r["w2"]) for r in some} == {k for k in found if k[0] < k[1]}
    assert frequent.frequent_pairs(tokens, "w", 10_000).count() == 0
