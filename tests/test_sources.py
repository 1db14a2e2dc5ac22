import json

from opinaria import schemas
from opinaria.session import shared_dir
from opinaria.sources import dictionaries as D, page_ids, payloads, reviews as S
from opinaria.streaming.ingest import ingest

REVIEWS = [("b2w", {"Results": [{"Title": "t", "ReviewText": "bom\n produto", "Rating": 5}], "TotalResults": 1}),
           ("b2w", {"TotalResults": 0}),
           ("extra", {"avaliacao": {"quantidadeAvaliacoes": 1, "avaliacoes": [{"titulo": "a", "descricao": "b", "nota": 2}]}}),
           ("extra", {"avaliacao": {"quantidadeAvaliacoes": None, "avaliacoes": [{"titulo": "a", "descricao": "b", "nota": 2}]}}),
           ("magalu", {"data": {"pages": 1, "objects": [{"title": "x", "review_text": "y", "rating": 4}]}}),
           ("reclame_aqui", {"complainResult": {"complains": {"data": [{"evaluation": "e", "description": "d", "score": 7}]}}}),
           ("zomato", {"entities": {"REVIEWS": {"1": {"reviewText": "z", "rating": {"entities": [{"entity_ids": [9]}]}}},
                                    "RATING": {"9": {"rating": 3.5}}}}),
           ("zomato", {"page_data": {}})]
EXPECTED = [("B2W", "t", "bom\n produto", 5.0), ("Extra", "a", "b", 2.0), ("Magalu", "x", "y", 4.0), ("ReclameAqui", "e", "d", 7.0), ("Zomato", "", "z", 3.5)]


def payload_rows(spark):
    rows = [(site, json.dumps(body)) for site, body in REVIEWS] + [("magalu", "<html>not json")]
    return spark.createDataFrame(rows, "site string, payload string")


def test_payloads(spark):
    got = sorted(tuple(r) for r in payloads.parse_payloads(payload_rows(spark)).select("source", "title", "text", "rating").collect())
    assert got == EXPECTED
    schemas.require(payloads.parse_payloads(payload_rows(spark)), schemas.REVIEW)


def test_stream_equals_batch_and_counts_files_once(spark):
    base = shared_dir(spark)
    rows = payload_rows(spark)
    rows.write.json(f"{base}/in")
    batch = sorted(tuple(r) for r in S.cleaned_reviews(payloads.parse_payloads(rows)).collect())
    for expected in (batch, batch):
        ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
        assert sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect()) == expected
    rows.limit(1).write.mode("append").json(f"{base}/in")
    ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == len(batch) + 1


def test_csv_keeps_quotes_and_line_breaks(spark):
    path = shared_dir(spark)
    rows = [("s", 'say "hi"', "ends with \\", 1.5), ("s", "", "a, b", 2.0)]
    S.append_reviews_csv(spark.createDataFrame(rows, schemas.REVIEW), path)
    S.append_reviews_csv(spark.createDataFrame([("s", "x", "line\nbreak", 3.0)], schemas.REVIEW), path)
    got = sorted(tuple(r) for r in S.read_reviews_csv(spark, path).fillna("").collect())
    assert got == sorted([*rows, ("s", "x", "line break", 3.0)])


def test_page_ids(spark):
    html = ('<script type="application/ld+json">{"sku": "123"}</script><script type="application/ld+json">{"sku": </script>'
            '<script type="text/javascript">x;\nsiteMetadata = {"page":{"listItems":[{"idProduct":7},{"idProduct":8}]}}; </script>'
            '<li class="a js-search-result-li" data-res_id="55"><li class="js-search-result-li-x" data-res_id="56">')
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r["product_id"] for r in page_ids.json_ld_skus(df).collect()] == ["123"]
    assert [r["product_id"] for r in page_ids.metadata_product_ids(df).collect()] == ["7", "8"]
    assert [r["value"] for r in page_ids.attribute_values(df, "js-search-result-li", "data-res_id").collect()] == ["55"]


def test_lexicon_last_line_wins(spark):
    path = shared_dir(spark)
    spark.createDataFrame([("bom\t1.0\tx",), ("ruim\t-2",), ("bom\t3.0",)], "value string").coalesce(1).write.text(path)
    assert {r["word"]: r["measure"] for r in D.read_lexicon(spark, path).collect()} == {"bom": 3.0, "ruim": -2.0}


def test_stop_words_keep_the_mandatory_ones(spark):
    words = {r["word"] for r in D.portuguese_stop_words(spark, ["Bom", "Não", "pouco", "DECR", "decr", "super", "INCR", "Você"]).collect()}
    assert "voce" in words and "incr" in words and "decr" in words
    assert not words & {"bom", "nao", "pouco", "super", "mais", "muito"}


def test_fixed_lists(spark):
    assert D.boosters(spark).count() == 67 and D.negations(spark).count() == 47
    assert {r["boost"] for r in D.boosters(spark).collect()} == {0.293, -0.293}
