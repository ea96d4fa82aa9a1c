"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parityspark.plans import catalog
from parityspark.session import build_session

HEADLINE = [
    "entry_failed_shots", "agg1_xor_reduce", "jn1_measurements_to_events", "jn4_replay_errors", "jn6_score_predictions", "jn14_pair_hits_on_edges",
    "flt5_postselect_shots", "agg9_hamming_weight_histogram", "set2_xor_sets", "agg3_merge_duplicate_errors", "mdl5_edges_from_model", "agg18_joint_edge_probabilities",
    "src1_read_shots_01", "src2_read_shots_b8", "src5_read_shots_r8", "src9_read_task_stats", "set1_append_stats", "fn3_fit_binomial", "fn20_line_fit_curves",
    "srt1_natural_sort_key", "mdl1_flatten_model", "mdl13_components", "mdl15_pair_distances", "dec1_distinct_syndromes", "dec2_decode_exact",
    "dec6_predictions", "win6_round_differences", "win7_assign_windows", "win5_limit_collection", "str3_stream_combine",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(int(os.environ.get("BENCH_CPUS", "8")), memory="16g")
    builds = catalog.callables()
    names = sys.argv[1:] or HEADLINE
    # Warm-up, not timed: compiled code, and the Python processes that Spark starts once a session for a data source (about 13 s in all).
    for name in ("agg21_bit_columns_xor", "entry_failed_shots", "udtf1_decode_shot_file"):
        builds[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        builds[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
