"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from proseloom.plans import registry
from proseloom.session import local_session

HEADLINE = [
    "style_reports", "agg1_document_metrics_raw", "agg2_pooled_fingerprint", "txt2_sentences_raw", "txt3_words",
    "txt7_four_grams", "txt9_passages", "sco9_combined_findings", "sco10_fidelity", "src4_html_markdown", "src9_redaction",
    "cls4_classification", "man1_chapters", "man6_conventions", "agg16_genre", "int3_findings", "ret1_matched_pairs",
    "ret3_exemplars", "con12_verdicts", "str4_progress_history", "str5_agent_status", "str6_stalls",
    "str4_stream_progress",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    registry.load()
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"))
    # One small job first, so the first query does not pay for start-up.
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
