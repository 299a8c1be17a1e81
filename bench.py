"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables and BENCH_CPUS
the local cores. Every query runs over whole tables and writes its full result
to the no-op sink; the sum of the seconds is the reported value.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from axiomloom import build_session  # noqa: E402
from axiomloom.plans import catalog, registry  # noqa: E402

HEADLINE = [
    "A03_binary_metrics", "A04_metrics_by_type", "A07_service_metrics", "A10_hard_consistency",
    "A13_dataset_model_summary", "A14_layer1_stats", "A16_layer3_stats", "A19_quality_rates",
    "C01_chunk_sections", "C02_chunk_pages", "C06_strip_references", "D01_extract_axioms",
    "D04_cap_per_type", "D06_replacement_negatives", "D14_expand_templates", "D18_flatten_axioms",
    "G08_semantic_summary", "J01_attach_context", "J05_layered_evidence", "J09_task_report",
    "L01_group_triples", "L03_vote_terms", "L05_rewrite_triples", "T19_parse_judgement_bilingual",
    "V03_validate_axioms", "W01_deep_page", "W03_latest_per_key", "W07_union_merge",
    "W10_degree_rank", "X01_running_task_counters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["A01_stats_long"](spark, folder).count()  # start the JVM's code paths
    registry.SPREAD_FILES = True
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "axiom_analytics_total_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "cpus": cpus,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
