import random

import pytest
from pyspark.sql import functions as F
from test_streaming import batches

from gatehouse.operators import partials as P
from gatehouse.operators import reports
from gatehouse.schemas import AUDIT_EVENTS
from gatehouse.sources.audit_log import append_events, read_events
from gatehouse.streaming.audit import bucket_figures, write_buckets

DECISIONS = ["allow", "allow", "deny", "firewall", "egress", "error", "trace"]


def events(spark, days, n=200, seed=1, start=0):
    pick = random.Random(seed)
    rows = [
        (start + i, f"2026-03-{pick.choice(days):02d}T{pick.randrange(24):02d}:15:00+00:00", "a", "t", pick.choice(DECISIONS), "r",
         pick.choice([None, 0, 5, 12]), pick.choice([None, *(f"s{k}" for k in range(40))]), pick.choice([None, 0, 3]), None, None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, AUDIT_EVENTS)


def scanned(path, spark):
    return P.figures(P.read_partials(spark, path)).first()


def test_refresh_reads_grown_days_only(spark, folder):
    log, days = folder("log"), folder("days")
    append_events(events(spark, [1, 2, 3]), log)
    assert [str(d) for d in P.refresh(read_events(spark, log), days)] == ["2026-03-01", "2026-03-02", "2026-03-03"]
    assert P.refresh(read_events(spark, log), days) == []
    append_events(events(spark, [3, 4], seed=2, start=1000), log)
    rows = P.stale(read_events(spark, log), P.grown_days(read_events(spark, log), P.read_partials(spark, days)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and {f.split("event_date=")[1][:10] for f in rows.inputFiles()} >= {"2026-03-03", "2026-03-04"}
    assert {str(r[0]) for r in rows.select("event_date").distinct().collect()} == {"2026-03-03", "2026-03-04"}
    assert [str(d) for d in P.refresh(read_events(spark, log), days)] == ["2026-03-03", "2026-03-04"]
    full = reports.kpi_metrics(read_events(spark, log))
    assert scanned(days, spark).asDict() == full.first().asDict() and scanned(days, spark).__fields__ == full.columns


def test_figures_of_nothing(spark, folder):
    none = P.figures(P.read_partials(spark, folder("days"))).first()
    assert none.asDict() == reports.kpi_metrics(spark.createDataFrame([], AUDIT_EVENTS)).first().asDict()


def test_estimate_of_many_sessions(spark):
    log = spark.range(60_000).select(
        F.lit("allow").alias("decision"), F.lit(1).alias("latency_ms"), F.lit(0).alias("pii_redacted"), (F.col("id") % 30_000).cast("string").alias("session_id"), (F.col("id") % 9).alias("day")
    )
    found = P.figures(P.partial_figures(log, "day")).first()
    assert found.events == 60_000 and found.sessions == pytest.approx(30_000, rel=4 * 1.04 / 2**7)


def test_buckets_hold_every_event_however_late(spark, folder):
    def at(i, time):
        return (i, f"2026-01-{time}:30:00+00:00", "a", "t", DECISIONS[i % 7], "r", 10, "s", 1, None, None)

    parts = [[at(0, "01T08"), at(1, "01T09")], [at(2, "01T20"), at(3, "01T08")], [at(4, "01T08"), at(5, "01T19"), at(6, "02T01")]]
    tables = [spark.createDataFrame(p, AUDIT_EVENTS) for p in parts]
    log = reports.with_event_time(batches(spark, folder("log"), tables))
    path = folder("run")
    write_buckets(log, f"{path}/figures", f"{path}/state", delay="1 hour", available_now=True).awaitTermination()
    found = {(r.bucket.day, r.bucket.hour): (r.events, r.late) for r in bucket_figures(spark, f"{path}/figures").collect()}
    # Late in the third batch: 08:30 (20:30 had been seen), not 19:30, which is within the hour.
    assert found == {(1, 8): (3, 1), (1, 9): (1, 0), (1, 20): (1, 0), (1, 19): (1, 0), (2, 1): (1, 0)}
    whole = reports.kpi_metrics(tables[0].union(tables[1]).union(tables[2])).first()
    assert P.figures(bucket_figures(spark, f"{path}/figures")).first().asDict() == whole.asDict()
