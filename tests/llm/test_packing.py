import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from opinaria.llm.packing import pack
from opinaria.llm.queries import tokenizer_path
from opinaria.llm.wordpieces import WordIds

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_cached_ids_equal_the_tokenizer(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet(DOCUMENTS).select("text").collect()]
    texts += ["", "  \n\t", "Don't they'LL stop??? 12.5% <|endoftext|>x <|startoftext|> \x1c a\x85b\xa0c", "Ünïcode façade ß İstanbul ΣΑΣ ς",
              "éclair café, 日本語 текст 😀👍🏽", "a" * 5000 + "!", "snake_case x--y ''s 's", "½ ² Ⅷ ٣"]
    table = WordIds(tokenizer_path(), max_bytes=100_000)
    for text in texts:
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(array("I", table.encode(text.encode()))) == expected, text[:60]


def check(rows, texts, tokenizer, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // capacity)
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length
            assert r.ids_crc32 == zlib.crc32(array("I", part).tobytes())
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity, parts", [(2048, 1), (64, 13)])
def test_packing_is_complete_and_tight(spark, tokenizer, capacity, parts):
    docs = spark.read.parquet(DOCUMENTS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack(docs.repartition(parts, "doc_id"), tokenizer_path(), capacity=capacity, fan_in=3).collect()
    used = check(rows, texts, tokenizer, capacity)
    assert used <= -(-sum(r.length for r in rows) // capacity) * 1.01 + 1


def test_tree_merges_underfull_bins(spark, tokenizer):
    docs = spark.range(0, 40, 1, 20).select(F.col("id").alias("doc_id"), F.lit("word " * 9).alias("text"))
    rows = pack(docs, tokenizer_path(), capacity=80, fan_in=2).collect()
    assert check(rows, {k: "word " * 9 for k in range(40)}, tokenizer, 80) == 5


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string, bin long, leaf string, offset int"
    docs = spark.createDataFrame([(1, None, 1, "x", 2), (1, None, 1, "x", 2), (None, "a b", 0, None, None), (2, "", 1, "", 1)], schema)
    rows = pack(docs.coalesce(1), tokenizer_path()).collect()
    assert sorted(r.length for r in rows) == [1, 1, 1, 3] and len({r.sequence_id for r in rows}) == 1
    assert sorted(r.offset for r in rows) == [0, 3, 4, 5]
    assert pack(docs.limit(0), tokenizer_path()).collect() == []
