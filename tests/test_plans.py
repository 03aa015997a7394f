"""Shape of the physical plans."""

import re

import pytest

from coreline.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Plans as at scale: no automatic broadcast."""
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield {
            name: plan(q(spark, FOLDER))
            for name, q in QUERIES.items()
            if name not in ("sink_roundtrip", "scan_csv_files", "join_saved_by_core")
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_no_python_on_survey_data(plans):
    for name, text in plans.items():
        assert not re.search(r"Python|Pandas|Arrow", text), name


def test_no_pairing_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_no_window_over_everything(plans):
    for name, text in plans.items():
        assert "SinglePartition, ENSURE" not in text.replace("ENSURE_REQUIREMENTS", "ENSURE") or (
            "Window" not in text
        ), name


def test_sites_are_broadcast_and_facts_are_not(plans):
    text = plans["stock_to_horizon"]
    assert text.count("BroadcastHashJoin") == 1  # the site dimension
    assert "SortMergeJoin [core_no" in text  # slices with cores


def test_stock_by_type_shuffles_each_side_once(plans):
    text = plans["stock_by_type"]
    # slices by core (pre-aggregated), orders and customers by customer, cores
    # by core, then types; the others order the 25-row site lookup
    keys = re.findall(r"Exchange hashpartitioning\((\w+)", text)
    facts = [k for k in keys if k not in ("n_regionkey", "site_no")]
    assert sorted(facts) == ["core_no", "core_no", "o_custkey", "o_custkey", "site_type"]
    # NaN counts as missing inside the sum
    assert re.search(r"partial_sum\((CASE WHEN NOT isnan\()?carbon_stock", text) and "partial_stddev_samp" in text


def test_scan_reads_only_needed_columns(plans):
    schema = re.search(r"ReadSchema: struct<(l_[^>]*)", plans["stock_by_type"]).group(1)
    assert "l_extendedprice" not in schema
    assert "Or(Not(EqualTo(l_returnflag,R))" in plans["stock_by_type"]


def test_horizon_stock_groups_without_another_shuffle(plans):
    keys = re.findall(r"Exchange hashpartitioning\((\w+)", plans["stock_to_horizon"])
    assert keys.count("core_no") == 2  # the two join sides; grouping by core reuses them


def test_tables_saved_by_core_meet_without_a_shuffle(spark):
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["join_saved_by_core"](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    # neither the join nor the grouping after it
    assert "SortMergeJoin [core_no" in text and "Exchange" not in text and text.count("Bucketed: true") == 2
