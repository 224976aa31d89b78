"""Catalog queries against their SQL; all of them with TAPELOOM_FULL=1."""

import os

import pytest

from tapeloom.catalog import load

from compare import duck, problem, sides

SF = os.environ.get("TAPELOOM_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
SOME = [
    "kept_time", "interval_merge_gap", "interval_subtract", "interval_intersect", "interval_overlaps_any", "grid_hop_windows", "grid_cut_windows",
    "label_identify", "label_drink_predicates", "evidence_texture_regions", "evidence_airflow_events", "evidence_soft_laughter", "transcript_classify_segments",
    "transcript_word_intervals", "frame_quiet_spans", "frame_longest_gesture", "signal_spectral_trace", "seam_levels", "timeline_source_to_output",
    "packet_assign", "packet_payload_digest", "chapter_list", "policy_union", "plan_quiet_cut", "score_missing", "retention_sweep", "stream_merge_spans",
]
NAMES = sorted(ORACLES) if os.environ.get("TAPELOOM_FULL") else SOME


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, tables, name):
    got, want, *rest = sides(spark, tables, SF, name, QUERIES, ORACLES)
    assert problem(got, want, *rest) is None


def test_every_query_is_registered_once():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 130
