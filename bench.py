"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores,
BENCH_QUERIES an optional comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import time

from rankaudit.plans.catalog import QUERIES
from rankaudit.session import drop_scratch, local_session

HEADLINE = (
    "domain_features", "score_modes_long", "blind_rank", "mode_sweep_summary", "ablation_summary", "baseline_score_rank",
    "digest_fragments", "priority_universe", "recovery_by_component", "percentile_components", "fusion_search",
    "two_stage_rerank", "frozen_recipe", "overlap_audit", "nearest_neighbor_audit", "suffix_sharing", "assay_metadata",
    "training_merge", "pwm_sites", "property_trace", "shuffle_zscore", "kmer_lm_score", "variants", "grouped_cv_fusion",
    "consensus", "contact_geometry",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("rankaudit-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}s", file=sys.stderr, flush=True)
    drop_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
