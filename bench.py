"""Times the headline jobs: ``python bench.py`` prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every job writes all its rows
to a sink that discards them; the best of ``BENCH_RUNS`` runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from checks.tables import seed_lines, split_corpus  # noqa: E402
from seedsift.plans.bounded import scratch_path, settle  # noqa: E402
from seedsift.plans.experiment import one_vs_rest  # noqa: E402
from seedsift.plans.search import search_by_example  # noqa: E402
from seedsift.sources.index import build_index  # noqa: E402
from seedsift.sources.seeds import parse_seeds  # noqa: E402

HEADLINE = (
    "postings_build",
    "term_counts",
    "model_local",
    "feature_best_50",
    "model_sequential",
    "score_postings_50",
    "score_docs_all",
    "search_top20",
    "break_even_points",
)


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seedsift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["label_sizes"](spark, sf_dir).collect()

    def best(job) -> float:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        return round(min(times), 3)

    seconds = {}
    docs = split_corpus(spark, sf_dir)
    index = None

    def store_index():
        nonlocal index
        index = build_index(docs, scratch_path(spark, "bench-index"))

    seconds["index_build"] = best(store_index)
    plain = parse_seeds(seed_lines(spark, sf_dir))
    seeds = plain.selectExpr("klass", "concat('training/', id) AS id")
    seconds["index_search_top20"] = best(lambda: discard(search_by_example(index, seeds)))
    seconds["index_one_vs_rest"] = best(lambda: discard(one_vs_rest(index.docs, index.searchable())))
    for name in HEADLINE:
        seconds[name] = best(lambda: discard(QUERIES[name](spark, sf_dir)))

    lexicon = index.stored.text.document_frequency()
    frequent = settle(lexicon.orderBy(F.desc("df"), "term").limit(51).select("term"), "terms")
    total = index.text.count()
    reach = index.stored.text.reach(frequent)
    visited = reach.of(index.stored.text.rows, "part", "term").count()
    parts = index.stored.text.rows.select("part").distinct().count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]),
                "postings": total,
                "postings_of_51_most_frequent_terms": visited,
                "parts": parts,
                "parts_opened": len(reach.parts),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
