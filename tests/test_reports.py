from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gatehouse.operators import reports as R
from gatehouse.schemas import AUDIT_EVENTS
from gatehouse.sources import audit_log as L
from gatehouse.sources.documents import join_blocks, read_documents

EVENTS = "id long, ts string, agent string, tool string, decision string, reason string, latency_ms int, session_id string, pii_redacted int"


def log(spark, rows):
    full = [
        (i, f"2026-01-01T10:00:{i:02d}+00:00", "summarizer", tool, decision, "r", ms, session, pii)
        for i, (tool, decision, ms, session, pii) in enumerate(rows)
    ]
    return R.with_event_time(spark.createDataFrame(full, EVENTS))


@pytest.fixture(scope="module")
def three(spark):
    return log(
        spark,
        [
            ("read_text_file", "allow", 120, "s1", 2),
            ("write_file", "deny", 0, "s1", 0),
            ("read_text_file", "firewall", 95, "s2", 0),
        ],
    )


def test_kpis(spark, three):
    row = R.kpi_metrics(three).first().asDict()
    assert row == {
        "events": 3,
        "actions_allowed": 1,
        "actions_denied": 1,
        "injections_blocked": 1,
        "egress_sanitized": 0,
        "errors": 0,
        "pii_redacted": 2,
        "sessions": 2,
        "avg_latency_ms": 120,
        "total_blocked": 2,
        "minutes_saved": 1.5,
    }


def test_kpis_of_an_empty_log(spark, three):
    assert set(R.kpi_metrics(three.filter("false")).first()) == {0}


@pytest.mark.parametrize("latencies, mean", [((1, 2), 2), ((2, 3), 2), ((0, 5), 5), ((0, 0), 0)])
def test_mean_latency_is_rounded_half_even(spark, latencies, mean):
    rows = log(spark, [("t", "allow", ms, "s", 0) for ms in latencies])
    assert R.kpi_metrics(rows).first().avg_latency_ms == mean


def test_charts(spark, three):
    counts = R.decision_counts(three).collect()
    assert [(r.decision, r.events, r.position, r.peak) for r in counts] == [
        ("allow", 1, 1, 1),
        ("deny", 1, 2, 1),
        ("firewall", 1, 3, 1),
    ]
    assert [tuple(r) for r in R.latency_by_tool(three).collect()] == [("read_text_file", 120.0)]
    places = R.timeline_positions(three).orderBy("id").collect()
    assert [r.position for r in places] == [0.0, 0.5, 1.0]
    one = R.timeline_positions(three.filter("id = 0")).first()
    assert one.position == 0.0
    assert R.decision_timeline(three).count() == 3


def test_security_feed_and_replay(spark):
    rows = log(
        spark,
        [
            ("user_request", "trace", 0, "s", 0),
            ("write_file", "deny", 0, "s", 0),
            ("x", "other", 0, "s", 0),
            ("final_answer", "trace", 0, "s", 0),
        ],
    )
    assert [r.label for r in R.security_feed(rows).collect()] == ["REFUSED BY POLICY"]
    assert [(r.id, r.label) for r in R.replay_view(rows).collect()] == [
        (1, "Refused by policy"),
        (2, "other"),
        (3, "ANSWER"),
    ]


def test_journal(spark):
    rows = log(
        spark,
        [("a", "allow", 5, "s1", 0), ("a", "deny", 0, None, 3), ("b", "allow", 0, "s2", 0)],
    )
    assert R.journal(rows).count() == 3
    assert [r.id for r in R.journal(rows, tools=["a"], sessions=["s2"]).collect()] == [1]
    assert [r.id for r in R.journal(rows, decisions=["allow"]).orderBy("id").collect()] == [0, 2]
    table = R.journal_table(rows).orderBy("id").collect()
    assert [(r.ms, r.session, r.pii) for r in table] == [("5", "s1", ""), ("", "", "3"), ("", "s2", "")]
    assert table[0].shown_at == "01 Jan 2026 10:00:00"
    options = [tuple(r) for r in R.filter_options(rows).collect()]
    assert options == [
        ("decision", "allow"),
        ("decision", "deny"),
        ("session", "s1"),
        ("session", "s2"),
        ("tool", "a"),
        ("tool", "b"),
    ]


def test_log_round_trip(spark, three, folder):
    path, again = folder("log"), folder("csv")
    L.append_events(three.drop("event_ts"), path)
    old = spark.createDataFrame(
        [(9, "t", "a", "read", "allow", "ok", 50)],
        "id long, ts string, agent string, tool string, decision string, reason string, latency_ms int",
    )
    L.append_events(old, path)
    stored = L.read_events(spark, path)
    assert L.count_events(stored).first().events == 4
    assert [r.id for r in L.newest_first(stored).collect()] == [9, 2, 1, 0]
    assert [r.id for r in L.events_since(stored, 0).collect()] == [1, 2, 9]
    kpis = R.kpi_metrics(stored).first()
    assert (kpis.actions_allowed, kpis.pii_redacted) == (2, 2)
    assert L.last_id(stored) == 9
    L.export_csv(R.journal(stored, decisions=["allow"]), again)
    assert spark.read.option("header", True).csv(again).count() == 2


def test_old_files_are_upgraded_on_read(spark, folder):
    path = folder("old")
    spark.createDataFrame(
        [(1, "t", "a", "read", "allow", "ok", 50)],
        "id long, ts string, agent string, tool string, decision string, reason string, latency_ms int",
    ).write.parquet(f"{path}/event_date=2020-01-01")
    row = L.read_events(spark, path).first()
    assert (row.session_id, row.pii_redacted, row.hash) == (None, 0, None)
    assert L.upgrade(spark.read.parquet(path)).columns[: len(L.COLUMNS)] == L.COLUMNS


def test_filters_reach_the_scan(spark, three, folder):
    path = folder("log")
    L.append_events(three.drop("event_ts"), path)
    later = L.events_since(L.read_events(spark, path), 1)
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan
    day = L.read_events(spark, path).filter(F.col("event_date") == "2026-01-01")
    plan = day.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_append_if_empty(spark, three, folder):
    path = folder("log")
    empty = spark.createDataFrame([], AUDIT_EVENTS)
    assert L.append_if_empty(empty, three.drop("event_ts"), path) is True
    assert L.append_if_empty(L.read_events(spark, path), three.drop("event_ts"), path) is False
    assert L.read_events(spark, path).count() == 3


def test_ids_follow_the_order(spark):
    rows = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("place")).repartition(7)
    found = L.with_ids(rows, ["place"], after=41).collect()
    assert len({r.id for r in found}) == 1000 and min(r.id for r in found) == 42
    assert [r.place for r in sorted(found, key=lambda r: r.id)] == list(range(1, 1001))


def test_documents(spark, tmp_path):
    (tmp_path / "workspace" / "sub dir").mkdir(parents=True)
    (tmp_path / "workspace" / "a.txt").write_text("one\ntwo")
    (tmp_path / "workspace" / "sub dir" / "b.txt").write_text("é")
    docs = read_documents(spark, str(tmp_path / "workspace"))
    assert sorted(map(tuple, docs.collect())) == [("a.txt", "one\ntwo"), ("sub dir/b.txt", "é")]


def test_text_blocks(spark):
    rows = spark.createDataFrame([(["a", None, "", "b"],), ([],)], "blocks array<string>")
    assert [r[0] for r in rows.select(join_blocks(F.col("blocks"))).collect()] == ["ab", ""]


def test_kpis_use_one_scan(spark, three, folder):
    path = folder("log")
    L.append_events(three.drop("event_ts"), path)
    plan = R.kpi_metrics(L.read_events(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_decimal_free(spark, three):
    assert not any(isinstance(v, Decimal) for v in R.kpi_metrics(three).first())
