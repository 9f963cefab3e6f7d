"""One session and one document with a third of all rows or more."""

import pytest
from pyspark.sql import functions as F

from gatehouse.operators.authorize import authorize
from gatehouse.plans.governed import govern
from gatehouse.sources.policy import DEFAULT_POLICY, policy_from_config

ROWS = 120_000
# Small enough for test data to count as skewed; joins must not turn into broadcasts.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "24",
}


@pytest.fixture
def small(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def final_plan(found):
    return found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def steps(spark):
    i = F.col("id")
    path = F.when(i % 7 < 3, "docs/1.txt").otherwise(F.concat(F.lit("docs/"), i % 900))
    return spark.range(ROWS, numPartitions=8).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), i * 7919 % 5000)).alias("session_id"),
        (i % 6).alias("step_no"),
        i.alias("call_no"),
        i.alias("seq"),
        F.lit("tool_call").alias("kind"),
        F.lit("summarizer").alias("agent"),
        F.lit("read_text_file").alias("tool"),
        F.array(F.struct(F.lit("path").alias("key"), path.alias("value"))).alias("args"),
        F.lit(None).cast("string").alias("text"),
        F.lit(5).alias("latency_ms"),
        F.lit(None).cast("string").alias("error"),
        F.sha2(i.cast("string"), 256).alias("ts"),
    )


def test_hot_session_is_split_in_the_quota_join(small):
    policy = policy_from_config(small, DEFAULT_POLICY)
    found = authorize(steps(small), policy).select("session_id", "seq", "ts", "allowed")
    rows = found.collect()
    assert "SortMergeJoin(skew=true)" in final_plan(found)
    first = sorted(r.seq for r in rows if r.session_id == "hot" and r.allowed)
    assert len(rows) == ROWS and first == list(range(0, 30, 3))


def test_stored_ends_spare_the_shuffle_of_calls(spark):
    policy = policy_from_config(spark, DEFAULT_POLICY)
    calls = steps(spark)
    found = authorize(calls, policy, store=True).select("session_id", "seq", "ts", "allowed")
    lazily = authorize(calls, policy).select("session_id", "seq", "ts", "allowed")
    assert found.exceptAll(lazily).isEmpty() and found.count() == ROWS
    found.collect()
    assert "Exchange hashpartitioning" not in final_plan(found)


def test_hot_session_and_document_are_split_in_a_governed_run(small):
    policy = policy_from_config(small, {"agents": {"summarizer": {}}})
    rows = steps(small).drop("seq", "agent")
    requests = rows.select("session_id").distinct().select(
        "session_id",
        F.lit("summarizer").alias("agent"),
        F.lit("x").alias("text"),
        F.lit("t").alias("ts"),
    )
    docs = small.range(900).select(
        F.concat(F.lit("docs/"), "id").alias("path"), F.lit("mail a@b.com").alias("text")
    ).union(small.createDataFrame([("docs/1.txt", "fine")], "path string, text string"))
    found = govern(requests, rows, docs, policy).calls.select("ts", "decision", "pii_redacted", "message")
    counts = {r.decision: r["count"] for r in found.groupBy("decision").count().collect()}
    assert counts == {"allow": ROWS}
    found.collect()
    plan = final_plan(found)
    assert plan.count("SortMergeJoin(skew=true)") == 2
