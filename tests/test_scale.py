"""Plans and sources that must hold at cluster size."""

import pathlib
import re

import pytest

from parityspark.operators import blocks
from parityspark.operators import model as md
from parityspark.plans import catalog
from parityspark.plans.fixtures import Fixtures
from parityspark.plans.registry import ENTRIES
from parityspark.sources import text_models

SF_DIR = "/root/testdata/sf0.001"
PACKAGE = pathlib.Path(__file__).parent.parent / "parityspark"
SHOT_QUERIES = [
    "entry_failed_shots", "agg1_xor_reduce", "jn1_measurements_to_events", "jn2_apply_sweep", "jn4_replay_errors", "jn5_syndrome_of", "jn6_score_predictions",
    "jn10_lookup_detector", "jn11_route_two_level", "jn14_pair_hits_on_edges", "flt4_predict_discards", "flt5_postselect_shots", "agg9_hamming_weight_histogram",
    "set2_xor_sets", "win6_round_differences", "win7_assign_windows", "dec1_distinct_syndromes",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SHOT_QUERIES)
def test_shot_plans_stay_in_the_jvm_without_products(spark, name):
    text = plan(ENTRIES[name].build(Fixtures(spark, SF_DIR)))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInArrow", "MapInPandas"):
        assert bad not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(ENTRIES["agg1_xor_reduce"].build(Fixtures(spark, SF_DIR)))
    (schema,) = set(re.findall(r"ReadSchema: (\S+)", text))
    assert schema == "struct<l_orderkey:bigint,l_partkey:bigint>"
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan(Fixtures(spark, SF_DIR).fx_meas)


def test_parity_combines_before_the_shuffle(spark):
    text = plan(ENTRIES["agg1_xor_reduce"].build(Fixtures(spark, SF_DIR)))
    assert "partial_count" in text and text.count("Exchange hashpartitioning") == 1


def test_no_unbounded_shortcuts_in_the_package():
    for file in PACKAGE.rglob("*.py"):
        text = file.read_text()
        for bad in ("localCheckpoint", "crossJoin", "F.broadcast", ".toPandas(", "F.udf(", "coalesce(1)"):
            assert bad not in text, f"{bad} in {file.name}"


def test_every_query_has_an_operator_behind_it():
    assert len(catalog.callables()) == len(ENTRIES) > 170


def test_postselection_does_not_sort_the_hits(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(ENTRIES["flt5_postselect_shots"].build(Fixtures(spark, SF_DIR)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joined = [line for line in text.splitlines() if "[shot_id" in line and "Join" in line]
    assert joined and not [line for line in joined if "SortMergeJoin" in line]


def test_splitting_parity_sets_works_them_out_once(spark):
    fx = Fixtures(spark, SF_DIR)
    text = plan(ENTRIES["flt5_complement"].build(fx))
    # The halves meet shots and written tables; the measurements behind the sets are not read again.
    assert "o_orderkey" in text and "l_orderkey" not in text


def test_blocks_of_models_that_fit_a_task_need_one_shuffle_and_no_join(spark, monkeypatch):
    body = ["error(0.1) D0", "repeat 3 {", "shift_detectors(1, 2) 2", "repeat 2 {", "detector(1) D1", "shift_detectors(0, 1) 1", "}", "}", "repeat 2 {", "error(0.2) D0 D5", "}", "detector(0, 0) D0"]
    lines = spark.createDataFrame([(m, 2 * i, t) for m in range(3) for i, t in enumerate(body[m:] if m < 2 else body * 2)], "model_id int, seq bigint, line string")
    shown = lambda: [sorted(map(str, f(text_models.read_model_text(lines)).collect())) for f in (md.flatten_model, md.total_shift, md.model_counts)]
    u, _ = md.unroll_model(text_models.read_model_text(lines))
    assert u.depth == 2 and plan(u.rows).count("Exchange hashpartitioning") == 1 and "Join" not in plan(u.rows)
    near = shown()
    monkeypatch.setattr(blocks, "MAX_WINDOW_GROUP", 0)
    assert shown() == near and len(near[0]) > 30


def test_predictions_meet_the_truth_once(spark):
    assert plan(ENTRIES["pipe2_count_mistakes"].build(Fixtures(spark, SF_DIR))).count("FullOuter") == 1
