import re

import corpus_pipeline
from opinaria.llm.common import table
from test_packing import check
from test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    from opinaria.llm.queries import tokenizer_path

    docs, inputs = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    packed = out.collect()

    def kept(name, after):
        return {r.doc_id for r in inputs[name]}, {r.doc_id for r in inputs[after]}

    before, after = kept("toxicity", "near_duplicates")
    assert after < before and len(after) > 0.8 * len(before)

    texts = {r.doc_id: r.text for r in inputs["near_duplicates"]}
    prints = {d: slow_fingerprint(t) for d, t in texts.items()}
    ids = sorted(texts)
    roots = slow_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 3])
    before, after = kept("near_duplicates", "substring_dedup")
    assert after == set(roots.values())

    old, new = ({r.doc_id: r for r in inputs[n]} for n in ("substring_dedup", "decontamination"))
    assert old.keys() == new.keys() and all(len(new[d].text) <= len(old[d].text) and new[d].n_chars == len(new[d].text) for d in old)

    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)}
    clean = {d for d, r in new.items() if not any(tuple(w[k : k + 10]) in grams for w in [words(r.text)] for k in range(len(w) - 9))}
    assert {r.doc_id for r in inputs["packing"]} == clean

    check(packed, {r.doc_id: r.text for r in inputs["packing"]}, Tokenizer.from_file(tokenizer_path()), 2048)
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_repeated_rows_and_missing_ids_in_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d", None, "s", 7), (1, "a b c d", None, "s", 7), (None, "a b c d", None, None, None), (None, "q r s t", None, None, 1),
            (None, "q r s t", None, None, 1), (2, None, None, "s", 0), (3, "", "en", "s", 0), (4, "u v w x " * 3000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "near_duplicates":
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a b c d"), (None, "q r s t"), (2, None), (4, rows[-1][1])], key=str)
        elif name != "packing":
            assert out.count() == len(rows)
