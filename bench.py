"""Seconds per headline query on whole tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexiloom.plans.catalog import all_queries  # noqa: E402
from lexiloom.session import local_session  # noqa: E402

# The headline queries: encoding whole columns and texts, exact splits, one model fit.
HEADLINE = (
    "category_counts", "char_ngrams", "word_tfidf", "hashed_ngrams", "hashed_ngrams_texts", "ngram_tfidf", "minhash",
    "minhash_rows", "minhash_texts", "one_hot", "target_mean", "loo_target_train", "class_frequency", "similarity",
    "fisher_kernel_count_uniform", "pretrained_vectors", "multinomial_mixture", "gamma_poisson_step",
    "gamma_poisson_texts", "gaussian_projection", "truncated_svd", "sample_n", "shuffle_split", "stratified_split",
    "average_precision", "left_join_required", "minhash_stream",
)


def run(query, spark, sf_dir: str) -> float:
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # Start the JVM's hot paths and the Python workers before any clock runs.
    for warm in ("category_counts", "hashed_ngrams"):
        run(queries[warm], spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir)
    seconds = {n: round(statistics.median(run(queries[n], spark, sf_dir) for _ in range(repeats)), 3) for n in names}
    spark.stop()
    print(json.dumps({"metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
