"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from emberlog.plans import catalog
from emberlog.session import local_session

HEADLINE = [
    "a1_session_totals", "a2_dps_timeline", "a14_stage_profile", "a14_stage_profile_overall", "c1_pixel_census", "c8_group_lines",
    "e1_e2_run_benchmark", "j1_temporal_support", "j2_seed_expansion", "j3_match_truth", "j4_label_by_truth", "j10_state_at", "k1_dedupe_values",
    "k2_stable_hits", "k4_vote_tracks", "k5_voting_hits", "k6_enemies", "p5_classify_documents", "p10_confidence", "w1_rolling_damage", "w2_running_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Warm-up on the smallest tables: session start-up and class generation are not throughput.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in names:
            catalog.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name:32s} {timings[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
