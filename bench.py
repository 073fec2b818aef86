"""Time the headline queries; prints one JSON line.

Every query writes all its columns to the no-op sink, so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from filigree.plans.registry import REGISTRY  # noqa: E402
from filigree.session import build_session  # noqa: E402

HEADLINE = [
    "list_filings", "pick_primary_document", "latest_filings", "write_chunks", "ingest_stream", "html_to_text",
    "extract_sections", "chunk_text", "chunk_counts", "process_filing", "extract_years", "lexical_search",
    "retrieve_sections", "knn_search", "knn_filtered", "assemble_context", "dedupe_citations", "agent_citations",
    "trace_profile", "fallback_citations", "route_query", "tag_topics", "match_rules", "last_n_messages",
    "history_profile", "priority_topics", "drop_asked_questions", "suggest_followups", "suggest_agent_followups",
    "build_agent_prompt", "build_rag_prompt", "ask", "pivot_facts", "yoy_trend", "compare_texts", "compare_weights",
    "summarize_extractive",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and Python's workers outside of the measured time.
    for name in ("chunk_text", "knn_search"):
        run(spark, sf_dir, name)
    times = {name: round(run(spark, sf_dir, name), 3) for name in HEADLINE}
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
