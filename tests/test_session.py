import pytest
from pyspark.sql import functions as F

from opinaria import session as S
from opinaria.models import classifiers as C
from opinaria.models import selection as M
from opinaria.operators import spelling, voting
from opinaria.sources import dictionaries as D


class Cluster:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    with pytest.raises(ValueError):
        S.shared_dir(Cluster)
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert S.shared_dir(spark) != S.shared_dir(spark) and spark.conf.get("spark.checkpoint.dir", None) == before


def test_broadcast_needs_few_rows_and_bytes(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array("id").alias("a"))
    assert S.fits_broadcast(rows) and not S.fits_broadcast(rows, max_rows=99) and not S.fits_broadcast(rows, max_bytes=50_000)
    with pytest.raises(TypeError):
        S.lookup(rows, rows, "id")


def test_digest_sees_rows_that_cancel(spark):
    def twice(x):
        return M.fingerprint(spark.createDataFrame([(x, {"k": x}), (x, {"k": x})], "a string, m map<string,string>"))

    assert twice("x") != twice("y")


def test_ranks_of_text_ids(spark):
    rows = spark.createDataFrame([(f"id{k}", k % 2) for k in range(50)], "doc_id string, label int")
    ranked = M.with_rank(rows, ["label"], "doc_id").collect()
    for label in (0, 1):
        assert sorted(r["_rank"] for r in ranked if r.label == label) == list(range(25))


def test_no_smoothing_is_a_little(spark):
    from pyspark.ml.linalg import Vectors
    rows = spark.createDataFrame([(1.0, Vectors.dense(1, 0, 1)), (0.0, Vectors.dense(0, 1, 1)), (1.0, Vectors.dense(2, 0, 1))], ["label", "features"])
    model = C.BY_NAME["MultinomialNB"].build(3, 3, alpha=0).fit(rows)
    mixed = spark.createDataFrame([(Vectors.dense(3, 1, 0),)], ["features"])
    assert model.transform(mixed).first().prediction == 1.0


def test_limits_raise():
    with pytest.raises(ValueError):
        C.BY_NAME["DecisionTreeClassifier"].build(1, 1, max_depth=31)
    with pytest.raises(ValueError):
        voting.with_subsets(None, 23)


def test_failed_fits_keep_their_message(spark):
    rows = M.results_frame(spark, [{"v_name": "v", "c_name": "c", "flag": "", "error": "ValueError: no"}, {"v_name": "v", "c_name": "d", "accuracy": 0.5, "flag": ""}])
    assert {r.c_name: r.error for r in rows.collect()} == {"c": "ValueError: no", "d": None}


def test_lines_of_several_lexicon_files_count_by_file_name(spark, tmp_path):
    # the larger file would be read first by size; its name comes first too, so the other one's line must win
    (tmp_path / "a.txt").write_text("bom\t1.0\n" + "filler\t0.5\n" * 500)
    (tmp_path / "b.txt").write_text("bom\t2.0\nbom\t3.0\n")
    assert {r.word: r.measure for r in D.read_lexicon(spark, str(tmp_path)).collect()} == {"bom": 3.0, "filler": 0.5}


def _joins(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_replicas_and_deletion_keys_are_not_broadcast_for_small_files(spark, tmp_path):
    """A few kilobytes of file stand for sixteen replicas of every row, or for all deletion keys of every word."""
    words = [f"{a}{b}{c}ord" for a in "abcd" for b in "efgh" for c in "ijkl"]
    spark.createDataFrame([(w, k) for k, w in enumerate(words)], "term string, n int").write.parquet(f"{tmp_path}/words")
    terms = spark.read.parquet(f"{tmp_path}/words")
    rows = terms.select("term", F.col("n").alias("id"))
    found = S.lookup(rows, terms, "term", salt=F.col("id"), bounded=False)
    assert "Broadcast" not in _joins(found) and found.filter("id = n").count() == len(words)
    pairs = spelling.candidates(spark.createDataFrame([("aeiorx",)], "token string"), terms)
    assert "Broadcast" not in _joins(pairs) and ("aeiord", 1) in {(r.term, r.distance) for r in pairs.collect()}
    assert "Broadcast" in _joins(rows.join(S.sized(terms), "term"))


def test_sides_of_many_bytes_are_shuffled(spark):
    """Held once the side is 20 MB, but a driver holds a broadcast several times."""
    rows = spark.range(20_000).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert not S.fits_broadcast(rows) and S.fits_broadcast(rows.limit(5000))
    joined = spark.range(30_000).join(S.sized(rows), "id", "left")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 30_000
