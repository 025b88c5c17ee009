"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpuskit.checks import load  # noqa: E402
from corpuskit.session import local_session  # noqa: E402

HEADLINE = [
    "pattern_counts", "scan_patterns", "redact_patterns", "residual_check", "build_index", "search", "update_index",
    "find_text", "tokenize", "diff_pairs", "diff_summary", "compare_documents", "align_pages", "bates_number",
    "split_by_size", "move_pages", "unique_names", "dedupe_content", "classify_pages", "size_report", "with_formulas",
    "html_blocks", "html_links", "sentences", "layout_lines", "extract_tables", "heading_outline", "coalesce_edits",
    "rate_limit", "otsu_threshold",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    spark.read.parquet(f"{folder}/nation.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"\n{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


main()
