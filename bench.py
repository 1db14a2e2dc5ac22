"""Time the headline queries; prints one JSON line.

Every query runs to the end over all its columns (no-op sink) after one warm-up query; the
value is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from opinaria.plans.catalog import QUERIES  # noqa: E402
from opinaria.session import build_session  # noqa: E402

HEADLINE = (
    "exact_dedup", "normalize_documents", "review_summary", "word_frequencies", "bigram_counts", "stem_vocabulary",
    "lexicon_scores", "spell_checked_texts", "vocabulary_bigram", "vocabulary_skip_trigram", "tfidf_unigram",
    "information_gain_top20", "robust_scaled_counts", "local_outlier_factor", "results_pivot", "vote_subset_scores",
    "roc_curve", "all_payloads", "multinomial_naive_bayes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["language_head"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
