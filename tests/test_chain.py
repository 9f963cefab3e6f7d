import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from gatehouse.functions.event_hash import GENESIS
from gatehouse.operators import chain as C
from gatehouse.plans.audit_trail import append_sealed, open_anchors, open_log, verify
from gatehouse.schemas import AUDIT_EVENTS


def event(i, decision="allow", session="s1"):
    return (i, f"2024-01-01T00:00:{i % 60:02d}+00:00", "summarizer", "read_text_file", decision, "ok|x", i, session, i % 3)


def walk_seal(events, head=GENESIS):
    """Seals one event after the other."""
    out = []
    for e in events:
        text = "|".join(str(x) for x in (head, *e[1:]))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.append((*e, head, digest))
        head = digest
    return out


def walk_verify(rows):
    """Reads the sealed rows in order; tells the first that does not fit."""
    head = GENESIS
    for row in sorted(rows):
        text = "|".join(str(x) for x in (head, *row[1:9]))
        if row[9] != head or row[10] != hashlib.sha256(text.encode()).hexdigest():
            return row[0]
        head = row[10]
    return None


def frame(spark, rows):
    return spark.createDataFrame(rows, AUDIT_EVENTS)


def unsealed(spark, events):
    return frame(spark, [(*e, None, None) for e in events])


def report(log, **kw):
    row = C.verify_chain(log, **kw).first()
    return row.ok, row.checked, row.first_bad_id


EVENTS = [event(1), event(2, "deny", None), event(3)]


def test_seal_equals_the_sequential_chain(spark):
    found = C.seal(unsealed(spark, EVENTS)).orderBy("id").collect()
    assert [tuple(r) for r in found] == walk_seal(EVENTS)
    assert C.last_hash(C.seal(unsealed(spark, EVENTS))).first()[0] == walk_seal(EVENTS)[-1][10]
    assert C.last_hash(unsealed(spark, EVENTS)).first()[0] == GENESIS


@pytest.mark.parametrize("rows", [1, C.PIECE_ROWS, C.PIECE_ROWS + 1, 2 * C.PIECE_ROWS, 3 * C.PIECE_ROWS + 5])
def test_hashes_run_on_from_piece_to_piece(spark, rows):
    events = [event(i) for i in range(rows)]
    found = C.seal(unsealed(spark, events)).orderBy("id").collect()
    assert [tuple(r) for r in found] == walk_seal(events)


def test_no_rows_leave_the_start(spark):
    none = F.array().cast("array<struct<payload:string>>")
    assert spark.range(1).select(C.running_hashes(none, F.lit(GENESIS))).first()[0] == [GENESIS]


def test_a_row_of_a_long_segment_costs_what_one_of_a_short_costs(spark):
    """All hashes of a segment were copied for each of its rows: 20 times as many rows took 80 times as long or more."""
    log = spark.range(40_000, numPartitions=1).selectExpr(
        "id", "'t' AS ts", "'a' AS agent", "'x' AS tool", "'allow' AS decision", "'ok' AS reason",
        "1 AS latency_ms", "'s' AS session_id", "0 AS pii_redacted",
    )
    seconds = {}
    for segment_rows in (1_000, 1_000, 40_000):  # the first run starts things
        begin = time.perf_counter()
        C.seal(log, segment_rows=segment_rows).write.format("noop").mode("overwrite").save()
        seconds[segment_rows] = time.perf_counter() - begin
    assert seconds[40_000] < 4 * seconds[1_000] + 3, seconds


def test_intact_edited_and_deleted(spark):
    rows = walk_seal(EVENTS)
    assert report(frame(spark, rows)) == (True, 3, None)
    edited = [(*r[:4], "allow", *r[5:]) for r in rows]
    assert report(frame(spark, edited)) == (False, 3, 2)
    assert report(frame(spark, [rows[0], rows[2]])) == (False, 2, 3)
    assert report(frame(spark, rows[:2])) == (True, 2, None)
    assert report(frame(spark, [])) == (True, 0, None)


def test_rows_without_hash_are_skipped(spark):
    old = (*event(1), None, None)
    assert report(frame(spark, [old, *walk_seal([event(5)])])) == (True, 1, None)


@pytest.mark.parametrize("seed", range(2))
def test_random_tampering_of_unbroken_chains(spark, monkeypatch, seed):
    monkeypatch.setattr(C.with_previous, "__defaults__", (C.LEVELS, 7, None))
    pick = random.Random(seed)
    ids = sorted(pick.sample(range(5000), 300))
    rows = walk_seal([event(i) for i in ids])
    for how in ("none", "edit", "delete", "block", "first", "swap"):
        log = list(rows)
        at = pick.randrange(1, 298)
        if how == "edit":
            log[at] = (*log[at][:5], "changed", *log[at][6:])
        elif how == "delete":
            del log[at]
        elif how == "block":
            del log[at : at + 40]
        elif how == "first":
            del log[0]
        elif how == "swap":
            log[at], log[at + 1] = ((log[at][0], *log[at + 1][1:]), (log[at + 1][0], *log[at][1:]))
        bad = walk_verify(log)
        for parts in (1, 8):
            assert report(frame(spark, log).repartition(parts)) == (bad is None, len(log), bad), how


def test_segments(spark):
    events = [event(i) for i in range(2, 100) if i % 5]
    sealed = C.seal(unsealed(spark, events), segment_rows=10)
    assert report(sealed, segment_rows=10) == (True, len(events), None)
    for begin in range(0, 100, 10):
        part = [e for e in events if begin <= e[0] < begin + 10]
        found = sealed.filter(F.expr("id div 10") == begin // 10).orderBy("id").collect()
        assert [tuple(r) for r in found] == walk_seal(part)
    edited = sealed.withColumn("reason", F.when(F.col("id") == 43, "x").otherwise(F.col("reason")))
    assert report(edited, segment_rows=10) == (False, len(events), 43)
    cut = sealed.filter("id <> 51")
    assert report(cut, segment_rows=10)[2] == 52


def test_seal_continues_an_open_segment(spark, folder):
    events = [event(i) for i in range(25)]
    path = folder("log")
    C.seal(unsealed(spark, events[:14]), segment_rows=10).write.parquet(path)
    sealed = spark.read.parquet(path)
    more = C.seal(unsealed(spark, events[14:]), sealed, segment_rows=10)
    whole = C.seal(unsealed(spark, events), segment_rows=10)
    assert sorted(more.unionByName(sealed).collect()) == sorted(whole.collect())


def test_anchors_show_a_cut_tail(spark):
    sealed = C.seal(unsealed(spark, [event(i) for i in range(95)]), segment_rows=5)
    stored = C.anchors(sealed, segment_rows=5, fan=4)
    levels = {r.level: r["count"] for r in stored.groupBy("level").count().collect()}
    assert levels == {1: 19, 2: 5, 3: 2, 4: 1}
    root = stored.filter("level = 4").first()
    assert (root.rows, root.first_id, root.last_id) == (95, 0, 94)
    assert C.verify_anchors(sealed, stored, 5, 4).isEmpty()
    tail = sealed.filter("id < 93")
    assert C.verify_anchors(tail, stored, 5, 4).filter("level = 1").first().block == 18
    whole_segment = sealed.filter("id < 50 or id >= 55")
    bad = C.verify_anchors(whole_segment, stored, 5, 4).filter("level = 1").collect()
    assert [(r.block, r.found) for r in bad] == [(10, None)]


def test_expected_hash(spark):
    rows = walk_seal(EVENTS)
    assert C.hash_events(frame(spark, rows)).filter("hash <> expected_hash").isEmpty()


def test_no_window_runs_over_all_events(spark):
    log = frame(spark, walk_seal(EVENTS))
    plan = C.verify_chain(log)._jdf.queryExecution().executedPlan().toString()
    # The only unpartitioned window is the one over the last, bounded level.
    assert plan.count("Exchange SinglePartition") <= 2
    assert "hashpartitioning(_block3" in plan


def test_batches_are_sealed_onto_the_log(spark, folder):
    path = folder("log")
    names = ["ts", "agent", "tool", "decision", "reason", "latency_ms", "session_id", "pii_redacted"]
    for begin in (0, 30, 60):
        rows = [event(i)[1:] for i in range(begin, begin + 30)]
        batch = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(
            names, ["string"] * 5 + ["int", "string", "int"])))
        append_sealed(batch.repartition(3), ["latency_ms"], path, segment_rows=8)
    log = open_log(spark, path)
    assert report(log, segment_rows=8) == (True, 90, None)
    assert [r.latency_ms for r in log.orderBy("id").collect()] == list(range(90))
    assert sorted(r.id for r in log.collect()) == list(range(90))
    assert tuple(verify(spark, path, 8).first()) == (True, 90, None)
    anchored = open_anchors(spark, path)
    assert anchored.count() == 12 and anchored.agg(F.sum("rows")).first()[0] == 90


@pytest.mark.parametrize(
    "lost, kept, first",
    [
        ("id = 44", 94, 44),
        ("id = 49", 94, 49),  # the last of its segment
        ("id = 50", 94, 50),  # the first of the next
        ("id BETWEEN 47 AND 52", 89, 47),
        ("id BETWEEN 50 AND 54", 90, 50),  # a whole segment
        ("id >= 93", 93, 93),
        ("id >= 20", 20, 20),
        ("id = 0", 94, 0),
    ],
)
def test_every_lost_row_is_reported(spark, lost, kept, first):
    sealed = C.seal(unsealed(spark, [event(i) for i in range(95)]), segment_rows=5)
    anchored = C.segment_anchors(sealed, 5)
    assert C.findings(sealed, anchored, 5).isEmpty()
    rest = sealed.filter(f"NOT ({lost})")
    assert tuple(C.verify_log(rest, anchored, 5).first()) == (False, kept, first)


def test_every_edit_is_reported(spark):
    sealed = C.seal(unsealed(spark, [event(i) for i in range(95)]), segment_rows=5)
    anchored = C.segment_anchors(sealed, 5)
    reason = F.when(F.col("id").isin(3, 44), "x").otherwise(F.col("reason"))
    found = C.findings(sealed.withColumn("reason", reason), anchored, 5).collect()
    assert sorted(map(tuple, found)) == [(3, "edited"), (44, "edited")]
    # The last segment sealed anew with other contents: its chain is right, its head is not.
    forged = C.seal(unsealed(spark, [(90 + i, *event(7 * i)[1:]) for i in range(5)]), segment_rows=5)
    swapped = sealed.filter("id < 90").unionByName(forged.select(sealed.columns))
    assert sorted(map(tuple, C.findings(swapped, anchored, 5).collect())) == [(94, "edited")]
    more = C.seal(unsealed(spark, [event(i) for i in range(97)]), segment_rows=5)
    assert sorted(map(tuple, C.findings(more, anchored, 5).collect())) == [(95, "unanchored"), (96, "unanchored")]


def test_rows_without_hash_are_passed_over(spark):
    sealed = C.seal(unsealed(spark, [event(i) for i in range(10, 30)]), segment_rows=5)
    early = unsealed(spark, [event(i) for i in range(10)])
    log = sealed.unionByName(early, allowMissingColumns=True)
    assert tuple(C.verify_log(log, C.segment_anchors(sealed, 5), 5).first()) == (True, 20, None)
