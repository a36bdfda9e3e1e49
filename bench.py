"""Headline queries, timed. Prints one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default: all)
    BENCH_QUERIES  comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "keyword_topk", "keyword_topk_batch", "lexical_cover_topk", "vector_topk", "hybrid_rrf",
    "chunk_overlap", "session_score", "session_classify", "catalog_documents", "catalog_upsert",
    "text_normalise", "page_metrics", "question_summary", "intent_tag",
    "console_cards", "org_tree", "effective_permissions", "routing_match",
    "price_asof", "usage_cost_daily", "consecutive_errors", "carry_forward",
    "funnel_rates", "kpi_rollup", "kpi_rank", "ads_crm_outer",
    "dq_range", "dq_unique", "dq_fk", "stream_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    wanted = os.environ.get("BENCH_QUERIES", "")

    from opsloom.catalogue import registry
    from opsloom.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    known = registry.callables()
    names = list(known) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    # Start the engine and its Python workers before the clock runs.
    known["funnel_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    known["vector_topk"](spark, folder).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
