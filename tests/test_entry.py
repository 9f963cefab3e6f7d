"""Every registered query against its SQL twin, and plans that must hold at scale."""

import pytest

import __spark_entry__ as E
from compare import compare, database
from gatehouse.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, db, sf_dir, name):
    problem, _ = compare(spark, db, sf_dir, name)
    assert problem is None


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert not E.entry(spark).isEmpty()


def plan(spark, sf_dir, name):
    found = E.queries()[name](spark, sf_dir)
    return found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, columns",
    [
        ("count_by_decision", "event_id:bigint,event_type:string"),
        ("latency_by_tool", "event_id:bigint,event_type:string,value:double"),
        ("pii_report", "text:string,lang:string,source:string,doc_id:bigint"),
    ],
)
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    shown = plan(spark, sf_dir, name)
    schema = shown.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(schema.split(",")) == sorted(columns.split(","))


@pytest.mark.parametrize("name", ["injection_scan", "pii_redact", "egress_sanitize", "neutralize"])
def test_text_jobs_need_no_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(spark, sf_dir, name)


def test_since_filter_reaches_the_scan(spark, sf_dir):
    assert "GreaterThan(event_id,400)" in plan(spark, sf_dir, "events_since")


@pytest.mark.parametrize("name", ["governed_run_events", "policy_authorize", "chain_previous"])
def test_nothing_is_gathered_or_crossed(spark, sf_dir, name):
    """Joins are on keys, and no list of rows is collected."""
    shown = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in shown and "NestedLoopJoin" not in shown
    assert "collect_list" not in shown


def test_agents_are_joined_by_hash(spark, sf_dir):
    shown = plan(spark, sf_dir, "policy_authorize")
    assert "BroadcastHashJoin [agent" in shown
    assert "user_id:bigint" in shown and "value:double" not in shown
