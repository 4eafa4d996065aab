"""Queries against their SQL twins on the smallest tables.

One query per operator family runs by default; STRIDEFRAME_ALL=1 runs every one.
"""

from __future__ import annotations

import os

import pytest
from compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
CORE = {
    "a03_hr_rows", "a13_written_results", "a14_user_day_replacement", "d07_merged_states", "e01_lag_difference", "e04_label_runs", "e11_row_numbers", "f10_corpus_duplicates", "f10_near_duplicates", "i16_step_changes", "i21_clock_offset", "j05_mode_smoothing",
    "j13_chunk_merge", "j14_window_merge", "j15_boundary_expansion", "k02_merge_predictions", "k13_side_by_side", "o01_hand_scores", "o12_key_frames", "a04_recognition_json", "a15_upsert_keep_old", "b09_threshold_ladders", "c05_exact_then_substring", "c07_window_label_by_overlap", "c15_nearest_in_time", "d06_mode_first_seen",
    "d11_percentile_95", "e05_gap_islands", "f08_anchor_frames", "h_s04_unique_slug", "i03_resample", "i07_segment_summary", "i14_flow_periodicity", "j06_short_run_fill", "j11_isolated_runs",
    "j12_group_consolidation", "k09_version_comparison", "l10_balance_score", "l15_trend_arrows", "l19_recovery", "m04_candidate_pool", "m08_nearest_documents", "m10_plan_checks", "n01_name_resolution",
    "n08_repair", "o05_frame_scores", "p05_tumbling_stream",
}
NAMES = sorted(oracle_sql()) if os.environ.get("STRIDEFRAME_ALL") else sorted(CORE)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert difference(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None


def test_entry_runs(spark, con):
    df = entry(spark)
    assert df.columns == ["user_id", "muscle", "score", "share_pct"] and not df.isEmpty()


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
