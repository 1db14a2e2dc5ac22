import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = ["review_summary", "word_frequencies", "lexicon_scores", "tfidf_bigram", "robust_scales", "local_outlier_factor", "roc_curve",
          "vote_finalists", "results_pivot", "spell_checked_texts", "stem_vocabulary", "stratified_folds", "all_payloads", "csv_round_trip"]


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, connection, name):
    message, _, good = compare(spark, connection, name, SF)
    assert good, message


def test_entry_works_without_the_optional_folder():
    import subprocess
    import sys
    from pathlib import Path

    code = ("import sys; sys.modules['opinaria.llm'] = None\n"
            "import __spark_entry__ as e\n"
            "assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()) and len(e.queries()) > 100")
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
