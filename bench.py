"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Index tables are built first and reported on their own; each query is then timed
over its whole result, written to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from facetloom.plans import QUERIES
from facetloom.plans import ranking_queries as R
from facetloom.session import configure
from facetloom.sources.tables import Tables

# Queries faster than this (seconds) run a second time, warm.
WARM_BELOW = 10.0

HEADLINE = (
    "attribute_facts", "facet_filter", "and_intersect_rollback", "rebuild_candidates",
    "context_features", "score_fm", "rank_candidates", "session_target_rank", "session_metrics",
    "question_entropy", "bm25_search", "cosine_topk", "hybrid_rank", "fold_edits_batch",
    "template_extract",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("facetloom-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    tables = Tables(spark, folder)

    def timed(name: str, run) -> None:
        started = time.time()
        run()
        times[name] = round(time.time() - started, 3)

    for name in ("catalog", "products", "profile", "facts", "session_profiles"):
        timed(f"build_{name}", lambda name=name: getattr(tables, name))
    for build in (R.items, R.context_rows, R.survivors, R.contexts, R.crosses, R.scored, R.kept_index):
        timed(f"build_{build.__name__}", lambda build=build: build(tables))

    def whole(name: str) -> None:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    for name in HEADLINE:
        timed(name, lambda name=name: whole(name))
    total = sum(times.values())
    # Once more with compiled code; the total stays that of the first run.
    warm: dict[str, float] = {}
    for name in HEADLINE:
        if times[name] < WARM_BELOW:
            started = time.time()
            whole(name)
            warm[name] = round(time.time() - started, 3)
    asked = R.contexts(tables).count()
    rate = round(asked / warm["hybrid_rank"], 1) if "hybrid_rank" in warm else None
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(total, 3), "unit": "sec",
                "queries": times, "warm": warm, "hybrid_queries_per_sec": rate, "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
