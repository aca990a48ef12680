import os

import pytest

from oracle import compare, connect
from proofline import plans

SF_DIR = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# the quick run takes a few of each kind; PROOFLINE_ALL_QUERIES=1 takes all
QUICK = ("d1_diff_tables", "d2_diff_cells", "d6_diff_snapshots", "d11_classify_contract", "d14_setting_impact", "d15_variable_impact", "q15_test_suite",
         "q14_verify_constraints", "c2_audit_left_join", "c5_audit_unique_key", "c13_model_findings", "g3_closure_down", "g8_connectors", "g12_trace_to_source",
         "j11_interval_overlap", "j14_deepest_prefix", "j16_subset_containment", "m5_customers", "m6_orders", "m10_order_metrics", "m16_chronic_patients", "a7_payer_costs",
         "a9_dq_summary", "s1_read_seed_csv", "s3_read_catalog_nodes", "s5_read_change_hunks", "t2_merge_upsert", "t6_stream_upsert", "t7_stream_windows", "v1_csv_key",
         "v12_text_references", "w1_sequence_key")
NAMES = list(plans.QUERIES) if os.environ.get("PROOFLINE_ALL_QUERIES") else list(QUICK)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, plans.QUERIES[name], plans.ORACLES.get(name), SF_DIR)
    assert ok, note


def test_every_query_has_sql():
    assert set(plans.ORACLES) == set(plans.QUERIES)
