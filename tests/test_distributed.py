"""Bucketed order statistics, neighbours, votes and joins against brute force, hot keys included."""

import itertools
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinaria.operators import curves, neighbors, quantiles, spelling, stats, voting
from opinaria.session import lookup


def test_exact_quantiles_with_a_hot_value(spark):
    rng = random.Random(3)
    rows = [("a", float(rng.randint(0, 9)) if rng.random() < 0.5 else 4.0) for _ in range(3000)]
    rows += [("b", rng.random()) for _ in range(101)] + [("c", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["q0"], r["q1"], r["q2"]) for r in quantiles.exact_quantiles(df, ["k"], "v", (0.25, 0.5, 0.93), buckets=8).collect()}
    for key in "abc":
        values = [v for k, v in rows if k == key]
        assert got[key] == pytest.approx(tuple(np.percentile(values, [25, 50, 93])))


def test_quantiles_with_left_out_zeros(spark):
    values = [1.0, 2.0, 3.0, 5.0]
    df = spark.createDataFrame([("t", v) for v in values], "k string, v double")
    for total in (4, 5, 6, 16, 40):
        totals = spark.createDataFrame([("t", total)], "k string, total bigint")
        row = quantiles.exact_quantiles(df, ["k"], "v", (0.25, 0.75), totals).first()
        full = [0.0] * (total - 4) + values
        assert (row["q0"], row["q1"]) == pytest.approx(tuple(np.percentile(full, [25, 75])))


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(k, float(i), rng.randint(0, 5)) for k in "xy" for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, o double, n int")
    got = quantiles.running_sums(df, ["k"], "o", ["n"], buckets=7).collect()
    assert len(got) == 600
    for key in "xy":
        total, ordered = 0, sorted([r for r in rows if r[0] == key], key=lambda r: -r[1])
        mine = {r["o"]: (r["cum_n"], r["next_n"]) for r in got if r["k"] == key}
        for i, (_, o, n) in enumerate(ordered):
            total += n
            assert mine[o] == (total, ordered[i + 1][2] if i + 1 < len(ordered) else None)


@pytest.mark.parametrize("pivots, chunk", [(1, 1000), (6, 17), (9, 5)])
def test_neighbours_in_many_small_blocks(spark, pivots, chunk):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.1, (50, 3)), rng.normal(5, 0.1, (40, 3)), np.ones((6, 3))])  # two clusters and copies
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id bigint, vec array<double>")
    got = {}
    for r in neighbors.k_nearest(df, 4, n_pivots=pivots, chunk=chunk).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nid"]))
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = sorted((d[j], j) for j in range(len(x)) if j != i)[:4]
        assert [n for _, n in sorted(got[i])] == [j for _, j in want]


def test_votes_against_brute_force(spark):
    rng = random.Random(6)
    n = 6
    rows = [[rng.randint(0, 1) for _ in range(n)] + [rng.randint(0, 1)] for _ in range(200)]
    df = spark.createDataFrame([(i, v, r[v], r[n]) for i, r in enumerate(rows) for v in range(n)], "row_id int, voter int, pred int, label int")
    scores = {r["mask"]: r["accuracy"] for r in voting.subset_scores(voting.vote_patterns(df), n).collect()}
    assert len(scores) == 42
    for size in range(3, n + 1):
        for subset in combinations(range(n), size):
            hits = sum(int(2 * sum(r[i] for i in subset) > size) == r[n] for r in rows)
            assert scores[sum(1 << i for i in subset)] == pytest.approx(hits / 200)


def test_area_equals_pair_count(spark):
    rng = random.Random(7)
    rows = [("m", round(rng.random(), 1), rng.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "model string, score double, label int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert curves.area_under_roc(df).first()["auc"] == pytest.approx(want)
    points = {(r["fpr"], r["tpr"]) for r in curves.roc_curve(df).collect()}
    assert (0.0, 0.0) in points and (1.0, 1.0) in points
    ends = curves.precision_recall_curve(df).filter("threshold IS NULL").first()
    assert (ends["precision"], ends["recall"]) == (1.0, 0.0)


def damerau(a, b):
    """Unrestricted distance with neighbouring exchanges, by breadth over edits of at most two."""
    letters = set(a + b)

    def edits(w):
        out = {w[:i] + w[i + 1:] for i in range(len(w))}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        return out | {w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)}
    if a == b:
        return 0
    first = edits(a)
    if b in first:
        return 1
    return 2 if any(b in edits(w) for w in first) else None


def test_candidates_are_exactly_the_words_within_two_edits(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(120)})
    longer = ["recomendamos" + w for w in words[:10]]
    tokens, terms = words[::2] + longer[::2], words[1::2] + longer[1::2]
    unknown = spark.createDataFrame([(t,) for t in tokens], "token string")
    dictionary = spark.createDataFrame([(t, i + 1) for i, t in enumerate(terms)], "term string, n bigint")
    got = {(r["token"], r["term"]): r["distance"] for r in spelling.candidates(unknown, dictionary).collect()}
    want = {(a, b): damerau(a, b) for a in tokens for b in terms if damerau(a, b) is not None}
    assert got == want


def test_spell_check(spark):
    docs = spark.createDataFrame([(1, "prodtuo muito bom"), (2, "produtobom xyzxyz"), (3, "")], "doc_id bigint, text string")
    dictionary = spark.createDataFrame([("produto", 50), ("muito", 90), ("bom", 70), ("bota", 1)], "term string, n bigint")
    bigrams = spark.createDataFrame([("produto", "bom", 5)], "w1 string, w2 string, n bigint")
    got = [r["text"] for r in spelling.spell_check(docs, dictionary, bigrams).orderBy("doc_id").collect()]
    assert got == ["produto muito bom", "produto bom xyzxyz", ""]


def test_lookup_keeps_every_row_of_a_hot_key(spark):
    stream = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("4", 2)], "k string, v int")
    for bounded in (True, False):
        out = lookup(stream, dim, "k", salt=F.col("id"), bounded=bounded)
        assert (out.count(), out.filter("v = 1").count(), out.filter("v = 2").count()) == (3000, 1000, 1)


@pytest.mark.parametrize("chunk", [7, 40, 2048])
def test_sparse_neighbours_equal_all_pairs(spark, chunk):
    rng = random.Random(12)
    rows = []
    for i in range(90):
        cells = {rng.randrange(30): float(rng.randint(1, 3)) for _ in range(rng.choice([0, 1, 4, 9]))}
        rows.append((i, list(cells), list(cells.values())))
    df = spark.createDataFrame(rows, "id bigint, idx array<int>, val array<double>")

    def distance(a, b):
        x, y = dict(zip(a[1], a[2])), dict(zip(b[1], b[2]))
        return sum((x.get(t, 0) - y.get(t, 0)) ** 2 for t in x.keys() | y.keys()) ** 0.5

    got = {}
    for r in neighbors.sparse_k_nearest(df, 4, chunk=chunk).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["nid"], round(r["dist"], 9))
    for a in rows:
        want = sorted((distance(a, b), b[0]) for b in rows if b[0] != a[0])[:4]
        assert got[a[0]] == {k + 1: (b, round(d, 9)) for k, (d, b) in enumerate(want)}
    assert neighbors.sparse_k_nearest(df.limit(0), 4).collect() == []


def test_second_round_skips_cells_out_of_reach(spark):
    rng = random.Random(13)
    rows = [(i, [c + rng.random(), c - rng.random()]) for i in range(400) for c in [1000.0 * (i % 4)]]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    got = {(r["id"], r["rank"]): r["nid"] for r in neighbors.k_nearest(df, 3, n_pivots=12, chunk=30).collect()}
    for i, v in rows:
        near = sorted(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2, j) for j, w in rows if j != i)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in near]


def all_paths(tokens, fixes, joins, counts):
    """The best path by trying all."""
    from opinaria.operators import compound as CO

    def go(at):
        if at == len(tokens):
            yield 0, "", []
            return
        for kind, taken, price, said in CO.edges(tokens, at, fixes, joins):
            for p, k, w in go(at + taken):
                yield price + p, str(kind) + k, said + w

    rank = lambda p: (p[0], -sum(counts.get(pair, 0).bit_length() for pair in zip(p[2], p[2][1:])), p[1])
    return min(go(0), key=rank)[2]


def test_best_path_equals_all_paths():
    from opinaria.operators import compound as CO
    rng = random.Random(21)
    names = [f"w{k}" for k in range(6)]
    for _ in range(400):
        fixes = {w: (rng.choice([None, "x", "y"]), rng.choice([1, 2]), rng.choice([None, "a b", "x y"])) for w in names[:4]}
        tokens = [rng.choice(names) for _ in range(rng.randint(0, 8))]
        joins = {p: rng.choice("pq") for p in zip(tokens, tokens[1:]) if rng.random() < 0.4}
        counts = {p: rng.choice([1, 3, 9]) for p in itertools.product([*names, *"xyabpq"], repeat=2) if rng.random() < 0.3}
        seen = {p: n for p, n in counts.items() if p in CO.competing_pairs(tokens, fixes, joins)}
        assert CO.best_path(tokens, fixes, joins, seen) == all_paths(tokens, fixes, joins, counts), (tokens, fixes, joins)
    assert len(CO.best_path(["w0", "w5"] * 20_000, {"w0": ("x", 1, "a b")}, {}, {})) >= 40_000


def test_words_written_apart_and_together(spark):
    from opinaria.operators.compound import spell_check_compound
    docs = spark.createDataFrame([(1, "pro duto muito bom"), (2, "produtobom  muito"), (3, "muitto bom xyzxyz"), (4, "muito bom"), (5, ""), (6, None)], "doc_id bigint, text string")
    dictionary = spark.createDataFrame([("produto", 50), ("muito", 90), ("bom", 70), ("pro", 2)], "term string, n bigint")
    bigrams = spark.createDataFrame([("produto", "bom", 5), ("produto", "muito", 9)], "w1 string, w2 string, n bigint")
    got = {r["doc_id"]: r["text"] for r in spell_check_compound(docs, dictionary, bigrams).collect()}
    assert got == {1: "produto muito bom", 2: "produto bom muito", 3: "muito bom xyzxyz", 4: "muito bom", 5: "", 6: None} or got[6] in (None, "")
    assert [got[k] for k in (1, 2, 3, 4, 5)] == ["produto muito bom", "produto bom muito", "muito bom xyzxyz", "muito bom", ""]
    assert spell_check_compound(docs.limit(0), dictionary, bigrams).collect() == []


def test_counted_terms_keep_their_partitions(spark):
    """Narrow rows are few compressed bytes; merged by these, a task's memory grew with the table."""
    from opinaria.operators import vectorize as V

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.lit("ab"), F.lit("ab"), F.concat(F.lit("c"), F.col("id").cast("string"))).alias("terms"))
    vocab = spark.createDataFrame([("ab", 0)], "term string, idx int")
    counts = V.count_terms(docs, vocab)
    assert {tuple(r) for r in counts.collect()} == {(i, "ab", 2) for i in range(40)}
    assert counts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_visitors_bring_back_only_what_is_within_their_bound():
    import numpy as np
    import pandas as pd

    data = pd.DataFrame({"id": [1, 2, 3, 4], "vec": [[0.0], [1.0], [2.0], [9.0]]})
    query = pd.DataFrame({"id": [3, 10, 11], "vec": [[2.0], [1.5], [20.0]], "bound": [1.0, np.inf, 5.0]})
    found = neighbors.dense_block(2)(query, data)
    assert list(found.itertuples(index=False, name=None)) == [(3, 2, 1.0), (10, 2, 0.5), (10, 3, 0.5)]
    sparse = lambda df: df.assign(idx=[[0]] * len(df), val=df["vec"])
    assert neighbors.sparse_block(2)(sparse(query), sparse(data)).equals(found)


def test_neighbouring_cells_share_a_group_while_they_fit_a_chunk():
    import numpy as np

    groups = neighbors._neighbouring(np.array([[9.0, 0], [0, 0], [5, 0], [1, 0], [np.inf, 0]]), np.array([3, 2, 7, 2, 0]), 7)
    assert groups[1] == groups[3] != groups[2] != groups[0] and groups[0] != groups[1]


def test_repeated_ids_find_no_more_than_k(spark):
    df = spark.range(300).selectExpr("id", "array(cast(id * 7 % 300 as double), cast(id * 11 % 13 as double)) as vec")
    assert neighbors.k_nearest(df.unionByName(df), 4, n_pivots=12).groupBy("id").count().filter("count <> 4").collect() == []


def test_only_pairs_that_are_asked_for_are_counted(spark, monkeypatch):
    """Every pair of every text was counted and shuffled, and every word met a long table in a shuffle (F5, F2, F4)."""
    from opinaria.operators import compound as CO, frequent, spelling as SP
    from opinaria import session
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["produto", "pro", "duto", "muito", "mui", "to", "bom", "produtobom", "muitto", "xyzxyz", "bomm"]) for _ in range(rng.randrange(9))) for _ in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "pro duto"), (3, "mui to bom"), (90, None)], "doc_id bigint, text string").repartition(3)
    dictionary = spark.createDataFrame([("produto", 50), ("muito", 90), ("bom", 70), ("pro", 2)], "term string, n bigint")
    tokens = docs.selectExpr("split(text, ' ') as _t")
    every = stats.bigram_counts(docs)
    some = {(r["w1"], r["w2"]): r["n"] for r in frequent.counted_pairs(tokens, "_t", every.filter("w1 < 'n'").select("w1", "w2")).collect()}
    counts = {(r["w1"], r["w2"]): r["n"] for r in every.collect()}
    assert {k: n for k, n in some.items() if k[0] < "n"} == {k: n for k, n in counts.items() if k[0] < "n"} and len(some) < len(counts)
    joined = {tuple(r) for r in frequent.joined_pairs(tokens, "_t", dictionary).collect()}
    assert joined == {k for k in counts if k[0] + k[1] in ("produto", "muito", "bom", "pro")} and joined
    key = lambda rows: sorted(map(repr, rows))
    before = key(CO.spell_check_compound(docs, dictionary, every).collect())
    plain = key(SP.spell_check(docs, dictionary).collect())
    ask = lambda pairs: frequent.counted_pairs(tokens, "_t", pairs)
    assert key(CO.spell_check_compound(docs, dictionary, ask).collect()) == before
    monkeypatch.setattr(frequent, "fits_broadcast", lambda dim: False)
    hits, small = frequent.exploded_hits(docs.selectExpr("doc_id", "split(text, ' ') as _t"), "doc_id", F.col("_t"), dictionary, "term")
    assert not small and {r["term"] for r in hits.collect()} == {"produto", "muito", "bom", "pro"}
    assert hits.count() == docs.selectExpr("explode(split(text, ' ')) as t").filter("t in ('produto', 'muito', 'bom', 'pro')").count()
    assert key(CO.spell_check_compound(docs, dictionary, ask).collect()) == before and key(SP.spell_check(docs, dictionary).collect()) == plain
    assert session.fits_broadcast(dictionary)
