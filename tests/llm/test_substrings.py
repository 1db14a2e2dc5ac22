import numpy as np

from opinaria.llm.substrings import GEAR, boundaries, gear_hash, repeated_passages, without_repeats


def text(words, seed):
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefghijklmnopqrstuvwxyzéß"), draw.integers(1, 9))) for _ in range(words))


def test_gear_hash_rolls_over_sixteen_bytes():
    data = np.random.default_rng(1).integers(0, 256, 100, dtype=np.uint8)
    rolled, h = gear_hash(data), 0
    for k, b in enumerate(data):
        h = ((h << 2) + int(GEAR[b])) % (1 << 32)
        assert rolled[k] == h


def test_boundaries_resist_insertions():
    data = np.frombuffer(text(2000, 2).encode(), np.uint8)
    cuts = boundaries(data)
    assert cuts[0] == 0 and cuts[-1] == len(data) and (np.diff(cuts) > 0).all() and np.diff(cuts)[1:-1].min() > 20
    shifted = boundaries(np.concatenate([data[:500], np.frombuffer(b"inserted", np.uint8), data[500:]]))
    assert set((shifted[shifted > 600] - 8).tolist()) == set(cuts[cuts > 592].tolist())
    assert (np.diff(boundaries(np.zeros(5000, np.uint8))) <= 1023).all()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, digest string, start int")


def test_passages_are_found_and_cut(spark):
    passage, short, other = text(60, 10), text(30, 11), text(200, 12)
    rows = [(k, f"{text(80, 100 + k)} {passage if k % 3 == 0 else short} {text(80, 500 + k)}") for k in range(30)]
    rows += [(40, other), (41, "x " + other + " y"), (42, None), (43, ""), (44, "a"), (None, passage), (45, "same words " * 400), (46, "same words " * 400)]
    docs = frame(spark, rows)
    found = repeated_passages(docs).collect()
    texts = dict(rows)
    assert {r.doc_id for r in found} == {k for k in range(3, 30, 3)} | {41, 46, None}
    for r in found:
        assert texts[r.doc_id].encode()[r.start : r.end].decode().strip()
        if r.doc_id is not None and r.doc_id < 30:
            part = texts[r.doc_id].encode()[r.start : r.end].decode()
            assert r.first_doc == 0 and part == passage and r.words == 60
    cut = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert len(cut) == len(rows) and cut[41].text.split() == ["x", "y"] and cut[None].text == ""
    for k, t in rows:
        if k not in {r.doc_id for r in found}:
            assert cut[k].text == t and cut[k].digest == "x"
        elif k is not None and k < 30:
            assert cut[k].text.split() == t.replace(passage, "").split()
    assert without_repeats(docs).columns == docs.columns


def test_longest_common_runs_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    seen, want = {}, set()
    for doc, t in sorted(rows):
        words = t.split()
        grams = {" ".join(words[k : k + 60]) for k in range(len(words) - 59)}
        if any(seen.get(g, doc) != doc for g in grams):
            want.add(doc)
        for g in grams:
            seen.setdefault(g, doc)
    rows_found = repeated_passages(frame(spark, rows)).collect()
    found = {r.doc_id for r in rows_found}
    assert want and want <= found
    # And the other way: the words of every span stand in a text with a smaller id, but for joints of runs from several texts.
    texts, held = dict(rows), {}
    for doc, t in sorted(rows):
        words = t.split()
        for k in range(len(words) - 11):
            held.setdefault(" ".join(words[k : k + 12]), doc)
    for r in rows_found:
        words = texts[r.doc_id].encode()[r.start : r.end].decode().split()
        assert len(words) == r.words >= 48
        known = [held[" ".join(words[k : k + 12])] < r.doc_id for k in range(len(words) - 11)]
        assert sum(known) >= 0.7 * len(known)


def test_repeated_rows_and_empty_table(spark):
    t = text(100, 3)
    docs = frame(spark, [(1, t), (1, t), (2, t), (2, t), (2, "z " + t)])
    assert sorted(r.doc_id for r in repeated_passages(docs).collect()) == [2, 2, 2]
    twice = frame(spark, [(5, text(400, 30)), (6, f"a {text(400, 30)} b"), (6, f"a {text(400, 30)} b")])
    assert [(r.doc_id, r.words, r.first_doc) for r in repeated_passages(twice).collect()] == [(6, 400, 5)] * 2
    bare = [(None, f"{text(90, 40 + k)} {text(400, 31)}") for k in range(3)]
    found = repeated_passages(frame(spark, bare)).collect()
    assert [(r.doc_id, r.words, r.first_doc) for r in found] == [(None, 400, None)] * 2
    assert sum(len(r.text.split()) == 90 for r in without_repeats(frame(spark, bare)).collect()) == 2
    assert repeated_passages(docs.limit(0)).collect() == [] and without_repeats(docs.limit(0)).collect() == []
