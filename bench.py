"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of local threads, ``BENCH_RUNS`` how often each
query is run (by default three times, after one run of a query to warm up; its time is the median).  After
``BENCH_SECONDS`` in all (by default 600) the rest is run once.  Each query is run to its last row (the rows are counted
by a sink that drops them).
"""

import json
import os
import sys
import time
from statistics import median

from opinionloom.plans.queries import QUERIES
from opinionloom.plans.session import build_session

HEADLINES = (
    "clean_documents", "reject_meaningless", "dedupe_per_model", "score_lexicon", "score_plugged", "absa_rows",
    "clause_aspects", "insight_lines", "aspect_pivot", "aspect_crosstab_top8", "vocabulary_matches", "model_stats",
    "model_keywords", "top_keywords_overall", "kpi_row", "feedback_report", "bi_payload", "bi_summary",
    "training_split", "embed_reviews", "vector_topk", "vector_search", "upsert_vectors", "live_kpi",
    "full_run", "csv_numbered", "stream_upsert",
)


def main(names):
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__opinionloom__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text))").collect()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    seconds = {}

    def run(name):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        spark.catalog.clearCache()
        return took

    began = time.perf_counter()
    run(HEADLINES[0])
    for name in names or HEADLINES:
        late = time.perf_counter() - began > float(os.environ.get("BENCH_SECONDS", "600"))
        seconds[name] = round(median(run(name) for _ in range(1 if late else runs)), 3)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "documents": documents, "cpus": int(cpus), "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
