import numpy as np
import pytest

from opinaria.llm.neighbours import Tables, nearest

SF = "/root/testdata/sf0.1/embeddings.parquet"


def brute(rows, queries, k):
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i, v in zip(ids, vectors):
        if queries(i):
            d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_probes_come_in_success_order():
    tables = Tables(8, 1.0, 1, 3, 1.5)
    place = tables.places(np.ones((1, 8)))[0, 0]
    cells = tables.probes(place, 0.95)
    assert cells[0] == tables.cells(np.floor(place)) or len(cells) > 1
    assert len(set(cells.tolist())) == len(cells) and len(tables.probes(place, 0.5)) < len(cells)
    draw = np.random.default_rng(5)
    near = tables.cells(np.floor(tables.places(np.ones(8) + draw.standard_normal((4000, 8)) / np.sqrt(8))))[:, 0]
    assert np.isin(near, cells).mean() > 0.9


def test_recall_against_brute_force(spark):
    df = spark.read.parquet(SF)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute(rows, lambda i: i % 20 == 0, 10), found(nearest(df, "vec_id % 20 = 0"))
    assert want.keys() == got.keys() and all(len(x) == 10 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    exact = {q: dict(x) for q, x in brute(rows, lambda i: i % 20 == 0, len(rows)).items()}
    for q, hits in got.items():
        assert [(i, pytest.approx(exact[q][i], abs=1e-12)) for i, _ in hits] == hits
        assert hits == sorted(hits, key=lambda x: (x[1], x[0]))


def test_exact_when_all_cells_are_visited_and_copies(spark):
    draw = np.random.default_rng(3)
    rows = [(k, draw.standard_normal(4).tolist()) for k in range(60)] + [(k, [1.0, 1.0, 1.0, 1.0]) for k in range(100, 400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    want = brute(rows, lambda i: i % 50 == 0, 10)
    for options in ({"success": 0.999, "parts": 3}, {"success": 0.999, "max_queries": 2, "max_rows": 20}):
        got = found(nearest(df, "vec_id % 50 = 0", **options))
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_short_results_are_completed_and_odd_vectors_left_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [100.0, 0.0]), (2, [0.0, 100.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]),
            (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (1, [100.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(nearest(df, "vec_id % 4 = 0"))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {0: [1, 2]}
    assert nearest(df.limit(0), "vec_id % 4 = 0").collect() == []
