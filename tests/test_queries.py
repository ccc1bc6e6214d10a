"""Registered queries against their SQL. ``TIDEWRIGHT_ALL=1`` runs every one."""

import os

import pytest

from compare import compare, connect
from tidewright.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
CORE = (
    "usage_report", "category_report", "data_dictionary", "field_flags", "match_patterns", "extract_blocks", "fingerprints",
    "infer_name", "uniquify_names", "mine_access", "snippet_profile", "mine_rules", "apply_rule_lookup", "catalog_diff",
    "classify_by_catalog", "group_operations", "pairwise_overlap", "reference_closure", "reconcile", "expand_variants",
    "rewrite_operations", "confidence_score", "compare_snapshots", "diff_rows_with_ignores", "verify_repairs", "line_diff",
    "operation_health", "performance_trends", "percentile_ceil_rule", "arm_metrics", "rollout_state", "latest_checkpoint_as_of",
    "stream_health", "stream_last_samples",
)
NAMES = list(QUERIES) if os.environ.get("TIDEWRIGHT_ALL") else [n for n in CORE if n in QUERIES]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SF) is None


def test_every_core_name_is_registered():
    assert set(CORE) <= set(QUERIES)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
