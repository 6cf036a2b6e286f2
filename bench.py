"""Times the headline queries and prints one JSON line. Warm: each kind of plan has run once before,
and the index that ``engine_search`` searches is stored before its time is taken (``index`` says how
long that took)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docweave.queries import QUERIES, table_engine
from docweave.session import session

HEADLINE = "dense_topk dense_weighted_merge bm25_term_stats bm25_topk rrf_hybrid rrf_multi_corpus hybrid_with_floor heading_split chunk_packing section_aggregate toc_tree collapse_documents incremental_upsert html_to_markdown pdf_stitch eval_recall_mrr engine_search".split()
WARM = "rrf_hybrid section_aggregate pdf_stitch".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus), **{"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run) -> float:
        began = time.perf_counter()
        run()
        return round(time.perf_counter() - began, 3)

    def write(name: str) -> None:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()

    for name in WARM:
        write(name)
    index = timed(lambda: table_engine(spark, sf))
    took = {name: timed(lambda name=name: write(name)) for name in HEADLINE}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "index": index}))


if __name__ == "__main__":
    main()
