"""A spread of registered queries against their SQL at the smallest scale (all of them: tests/oracle_check.py)."""

import pytest
from oracle_check import compare, connect

SAMPLE = ["group_report", "auroc_ties", "threshold_transfer", "rank01", "curate_frames_verified", "mask_low_confidence", "validate_labels",
          "concept_ppv", "pseudo_positive_mine", "rank_loss_hardest", "config_sweep", "bootstrap_challenge", "auroc_ci", "read_votes",
          "stream_label_monitor", "pool_tokens"]


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__ as e
    return e.queries(), e.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, entry, con, name):
    queries, sql = entry
    assert compare(queries[name](spark, sf_dir), con, sql[name]) is None


def test_every_sql_has_a_query(entry):
    queries, sql = entry
    assert set(sql) <= set(queries) and len(queries) > 150


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert {r["center"] for r in df.collect()} == {"POOLED", "center_1", "center_2"}
