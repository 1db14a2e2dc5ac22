import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# Columns that each query returns at least, and the table that gives it a row each.
CONTRACTS = {
    "op1": ({"doc_id", "fingerprint", "component_id"}, "documents"),
    "op2": ({"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, None),
    "op3": ({"doc_id", "held_out", "lang_pred", "score"}, "documents"),
    "op4": ({"page_id", "host", "path", "rule", "verdict"}, "pages"),
    "op5": ({"query_id", "rank", "vec_id", "score"}, None),
    "op6": ({"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "documents"),
    "op7": ({"doc_id", "p_toxic", "is_toxic"}, "documents"),
    "op8": ({"doc_id", "start", "end", "first_doc"}, None),
    "op9": ({"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}, None),
    "op10": ({"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "documents"),
    "op11": ({"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"}, None),
    "op12": ({"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "pages"),
    "op13": ({"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}, "documents"),
}


def test_one_query_per_operator_and_the_pipeline():
    numbered = sorted(n.split("_")[0] for n in entry.queries() if n[:2] == "op" and n[2].isdigit())
    assert numbered == sorted(CONTRACTS) and "pipeline" in entry.queries()


@pytest.mark.parametrize("number", CONTRACTS)
def test_contract(spark, number):
    name = next(n for n in entry.queries() if n.startswith(f"{number}_"))
    columns, source = CONTRACTS[number]
    got = entry.queries()[name](spark, SF)
    assert columns <= set(got.columns)
    rows = got.count()
    assert rows == spark.read.parquet(f"{SF}/{source}.parquet").count() if source else rows > 0
