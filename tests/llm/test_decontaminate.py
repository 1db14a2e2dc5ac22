import re

from opinaria.llm.decontaminate import benchmark_matches, hit_words


def brute(docs, items, width, within):
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(str(i), w[k : k + width]) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - width + 1))]
    out = []
    for doc, text in docs:
        words, hit, found, near = split(text), set(), set(), set()
        for item, win in windows:
            for at in range(len(words) - len(win) + 1):
                if words[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    found.add(item)
            if any(set(win) <= set(words[p : p + within]) for p in range(len(words))):
                near.add(item)
        out.append((doc, len(words), len(hit), sorted(found), sorted(near)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), list(r.near_items)) for r in df.withColumn("n_hit", hit_words()).collect()), key=str)


DOCS = [(1, "x Alpha, beta gamma! delta-eps y alpha beta gamma delta"), (2, None), (3, ""), (4, "delta gamma beta alpha"),
        (5, "alpha beta"), (5, "alpha beta"), (6, "Ünder ß x one two three four five"), (7, "gamma delta eps alpha beta gamma delta eps " * 40),
        (8, "alpha " + "q " * 50 + "beta gamma delta"), (None, "one two three")]
ITEMS = [(10, "alpha beta gamma delta eps"), (11, "ünder ß x"), (12, "one two three"), (13, None), (14, "..."), (9, "beta gamma delta eps zeta"),
         (10, "alpha beta gamma delta eps")]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' as items", "1 as spans", "0 as n_words")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_equals_brute_force(spark):
    docs, items = frames(spark)
    for width, within in ((4, 6), (3, 2), (10, 20)):
        assert found(benchmark_matches(docs.coalesce(1), items, width=width, within=within)) == brute(DOCS, ITEMS, width, within)


def test_blocks_of_the_benchmark_give_the_same_rows(spark):
    docs, items = frames(spark)
    whole = found(benchmark_matches(docs, items, width=4, within=6))
    assert found(benchmark_matches(docs, items, width=4, within=6, block_words=5)) == whole


def test_unequal_rows_under_one_id_stay_apart_over_blocks(spark):
    rows = [(1, "a b c d"), (1, "x y z w q"), (None, "a b c"), (None, "clean text"), (1, "a b c d")]
    items = [(10, "a b c"), (11, "x y z")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(benchmark_matches(docs, benchmark, width=3, within=4, block_words=3)) == brute(rows, items, 3, 4)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert found(benchmark_matches(docs.limit(0), items)) == []
    assert all(r[2:] == (0, [], []) for r in found(benchmark_matches(docs, items.limit(0))))
