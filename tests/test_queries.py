"""Registered queries against DuckDB; KNOWNDATE_ALL_QUERIES=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "j08_forward_label", "a03_censoring_inventory", "a01_submission_matrix", "w04_security_market_features",
    "j11_market_asof_security", "j12_security_interval_join", "w08_trailing_sequences", "m05_ranking_metrics",
    "k05_alert_budget", "j04_identity_master", "a04_ticker_coverage", "a09_corroboration", "s15_fixed_width_list",
    "s18_positioned_words", "s19_list_source_index", "g08_identifier_promotion", "w03_issuer_market_features",
    "f03_name_similarity", "j15_name_coverage", "a11_candidate_strength", "a12_discovery_comparison", "a18_tie_composition",
    "k01_k02_hard_case_discovery", "p16_depth_probe", "s21_document_text", "s25_cache_audit", "s26_snapshot_check",
    "f18_logits", "w12_document_selection", "g11_line_fidelity_gate_default", "a07_quarter_funnel",
    "m07_platt_calibration", "m07_isotonic_calibration", "m12_calibration_diagnostics", "m13_probability_evidence",
    "m02_scored_population", "m03_scored_population", "p08_p09_cohort_from_raw_facts", "f11_f12_identifier_context",
    "f21_pilot_evidence", "f07_f20_identifier_evidence", "m14_cluster_bootstrap", "m01_exact_quantiles", "m10_quantile_bins", "w10_security_master_audit",
]
NAMES = sorted(entry_points.oracle_sql()) if os.environ.get("KNOWNDATE_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ours, theirs, diff = differences(
        entry_points.queries()[name](spark, SF), con, entry_points.oracle_sql()[name]
    )
    assert ours is not None and ours == theirs and not diff[0] and not diff[1], diff


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
