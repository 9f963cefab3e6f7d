import random
import re

import pytest
from pyspark.sql import functions as F
from test_chain import event, frame, walk_seal

from gatehouse.operators import chain as C
from gatehouse.operators import key_chain as K

NAMES = ["id", "session_id", "prev_hash", "hash"]


def by_session(events):
    """Each session's events sealed one after the other."""
    sessions = {}
    for e in sorted(events):
        sessions.setdefault(e[7], []).append(e)
    return sorted(((r[0], r[7], r[9], r[10]) for own in sessions.values() for r in walk_seal(own)), key=str)


def events_of(sessions, n=400, seed=1):
    pick = random.Random(seed)
    return [event(i, session=pick.choice(sessions)) for i in range(n)]


@pytest.fixture
def as_cut(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("ranges", [1, 2, 5, 13, None])
@pytest.mark.parametrize(
    "sessions", [["a"], ["hot"] * 6 + list("abcdefgh"), [None, "", "None", "x"], [f"s{k}" for k in range(200)]], ids=["one", "hot", "odd", "many"]
)
def test_a_chain_per_session(spark, as_cut, sessions, ranges):
    events = events_of(sessions)
    rows = spark.createDataFrame([(*e, None, None) for e in events], frame(spark, []).schema).repartition(3)
    found = K.seal_chains(rows, "session_id", ranges=ranges)
    assert found.columns == rows.columns
    assert sorted((tuple(r) for r in found.select(*NAMES).collect()), key=str) == by_session(events)


@pytest.mark.parametrize("ranges", [1, 4, 11])
def test_one_chain_over_the_whole_log(spark, as_cut, ranges):
    events = events_of(["a", "b"], 300)
    found = K.seal_chains(frame(spark, [(*e, None, None) for e in events]), None, ranges=ranges)
    assert [tuple(r) for r in found.orderBy("id").collect()] == walk_seal(events)
    assert tuple(C.verify_chain(found).first()) == (True, 300, None)


def test_nothing_and_chains_that_go_on(spark, as_cut):
    empty = frame(spark, [])
    assert K.seal_chains(empty, "session_id").count() == 0 and K.anchor_heads(K.key_heads(empty, "session_id"), "session_id").count() == 0
    events = [(*e, None, None) for e in events_of(["hot"] * 4 + [None, "b", "c"], 300)]
    whole = K.seal_chains(frame(spark, events), "session_id", ranges=3)
    first = K.seal_chains(frame(spark, events[:120]), "session_id", ranges=3)
    rest = K.seal_chains(frame(spark, events[120:]), "session_id", heads=K.key_heads(first, "session_id"), ranges=4)
    assert sorted(first.unionByName(rest).collect(), key=str) == sorted(whole.collect(), key=str)


def test_a_hot_session_goes_round_by_round(spark, as_cut):
    """No task folds more than a range: a session over five ranges takes as many rounds."""
    rows = frame(spark, [(*e, None, None) for e in events_of(["hot"], 500)])
    found = K.seal_chains(rows, "session_id", ranges=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 6
    assert max(r["count"] for r in found.groupBy(F.input_file_name()).count().collect()) < 200


def kinds(log, anchored):
    return sorted((r.session_id, r.id, r.kind) for r in K.key_findings(log, anchored, "session_id").collect())


def test_damage_is_found(spark):
    rows = [(*event(i, session="abc"[i % 3]), None, None) for i in range(60)]
    log = spark.createDataFrame(K.seal_chains(frame(spark, rows), "session_id").collect(), frame(spark, []).schema)
    anchored = spark.createDataFrame(K.anchor_heads(K.key_heads(log, "session_id"), "session_id").collect())
    assert kinds(log, anchored) == []
    assert kinds(log.filter("id <> 31"), anchored) == [("b", 34, "edited")]
    assert kinds(log.filter("NOT (session_id = 'c' AND id > 40)"), anchored) == [("c", 59, "missing")]
    assert kinds(log.filter("session_id <> 'a'"), anchored) == [("a", 0, "missing")]
    assert kinds(log.withColumn("reason", F.when(F.col("id") == 9, "x").otherwise(F.col("reason"))), anchored) == [("a", 9, "edited")]
    assert kinds(log, anchored.filter("session_id <> 'b'"))[0] == ("b", 1, "unanchored")
    more = K.seal_chains(frame(spark, [(*event(60, session="a"), None, None)]), "session_id", heads=K.key_heads(log, "session_id"))
    assert kinds(log.unionByName(more), anchored) == [("a", 58, "unanchored")]
    forged = anchored.withColumn("head", F.when(F.col("session_id") == "b", F.sha2("head", 256)).otherwise(F.col("head")))
    assert {k for _, _, k in kinds(log, forged)} == {"edited", "anchor"}
    report = K.verify_keys(log.filter("id NOT IN (31, 59)"), anchored, "session_id").first()
    assert (report.ok, report.checked, report.first_bad_id, report.edited, report.missing) == (False, 58, 34, 1, 1)


def test_rows_are_shuffled_once_for_their_links_and_hashes_as_bytes(spark):
    texts = ["ab" * 32, "AB" * 32, "ab" * 31 + "a\n", "", "x", "\0", "0" * 32, bytes.fromhex("61" * 32).decode(), "61" * 32, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(K.packed(F.col("t")).alias("b")).collect()
    assert len({r.b and bytes(r.b) for r in rows}) == len(texts) and rows[-1].b is None and len(rows[0].b) == 32
    fields = ", ".join(f"cast({v} AS {t}) AS {n}" for n, t, v in (("id", "long", "id"), ("session_id", "string", "id % 3"), ("hash", "string", "id"), ("prev_hash", "string", "id")))
    log = spark.range(9).selectExpr(*fields.split(", "), *(f"'x' AS {n}" for n in ("ts", "agent", "tool", "decision", "reason")), "1 AS latency_ms", "0 AS pii_redacted")
    plan = K.with_key_check(log, "session_id")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Window \[.*windowspecdefinition\(_group#\d+, _block3#", plan)) == 1
