import re

import numpy as np
import pytest
import xxhash

from opinaria.llm.common import components
from opinaria.llm.simhash import PivotTable, bucket_links, fingerprint, links, near_duplicates, one_per_group


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_the_definition():
    for text in (None, "", " \t\n", "One", "one TWO", "a b c", "a b c d a b c", "É x\x0by z\x1cq \x85 Ä", "w " * 3000):
        assert fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


@pytest.mark.parametrize("words, bucket", [(6, 2000), (5, 3)])
def test_links_lose_nothing(spark, words, bucket):
    draw = np.random.default_rng(7)
    centres = draw.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in draw.choice(63, draw.integers(0, 6), replace=False)) for c in centres for _ in range(40)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = [(r.a, r.b) for r in links(frame, 3, PivotTable(words), bucket).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    ordered = sorted(fps)
    want = [(a, b) for k, a in enumerate(ordered) for b in ordered[:k] if (a ^ b).bit_count() <= 3]
    assert slow_components(fps, got) == slow_components(fps, want)


def test_bucket_links_is_a_forest():
    fps = np.array([0, 1, 3, 7, 15, 31, 15 << 40], np.int64)
    assert len(bucket_links(fps, PivotTable(), 3)) == 5


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 300)] + [(400, 400), (500, 501), (501, 500), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 300)), [400], [500, 501]]
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_documents_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(9001, None), (9000, ""), (9002, " "), (9003, docs[0][1]), (9003, docs[0][1]), (None, docs[1][1])]
    frame = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, fp string, key int")
    prints = {d: slow_fingerprint(t) for d, t in docs if d is not None}
    ids = sorted(prints)
    want = slow_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = near_duplicates(frame).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp % (1 << 64), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert near_duplicates(frame.limit(0)).collect() == []


def test_one_per_group_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c", 7, 1, 2, 3), (1, "a b c", 7, 1, 2, 3), (2, "a b c", 7, 1, 2, 3), (3, "q r s t", 7, 1, 2, 3), (None, "lone words", 7, 1, 2, 3), (None, "lone words", 7, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_id int, rep int, fp int, _id int")
    got = one_per_group(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
