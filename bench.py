"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Every query is run to
the end (all columns, all rows) and none is given results of another.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelloom.operators.features import fit_vocabulary, vectorize  # noqa: E402
from labelloom.operators.models import train_linear_svm  # noqa: E402
from labelloom.plans import catalog  # noqa: E402
from labelloom.plans.staging import stage  # noqa: E402

HEADLINE = (
    "label_text_profile",
    "clean_text",
    "light_clean_pages",
    "content_tokens",
    "lemmatize",
    "ngrams",
    "encode_fixed_length",
    "term_stats",
    "fit_vocabulary",
    "tfidf",
    "tfidf_joined",
    "stratified_split",
    "random_oversample",
    "confusion_matrix",
    "per_class_report",
    "weighted_cross_entropy",
    "compare_models",
    "remove_stopwords_table",
    "train_logistic",
    "train_and_compare",
    "score_stream",
)


def train_svm(spark, sf):
    """Vocabulary, vectors and the one-vs-rest SVM on the whole corpus."""
    docs = catalog.corpus_terms(spark, sf)
    vectors = vectorize(docs, fit_vocabulary(docs, "terms"), "terms")
    data = stage(vectors.select("doc_id", "class", "features"))
    return train_linear_svm(data, "class").transform(data).select("doc_id", "class", "prediction")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("labelloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="labelloom-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(build) -> float:
        start = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(catalog.QUERIES["label_text_profile"])  # start-up of the JVM and its workers
    seconds = {name: run(catalog.QUERIES[name]) for name in HEADLINE}
    seconds["train_linear_svm"] = run(train_svm)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
