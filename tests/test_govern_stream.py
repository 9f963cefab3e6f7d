import random

import pytest
from pyspark.sql import functions as F
from test_chain import walk_seal
from test_streaming import batches

from gatehouse.operators import key_chain as K
from gatehouse.settings import DEFAULT
from gatehouse.sources.policy import policy_from_config
from gatehouse.streaming import sealed_log as L
from gatehouse.streaming.files import read_stream
from gatehouse.streaming.govern import govern_stream

READ = "read_text_file"
POLICY = {"agents": {"a": {"allowed_tools": [READ], "max_calls_per_session": 4}, "b": {}}}
SCHEMA = "session_id string, seq long, agent string, tool string, args array<struct<key:string,value:string>>, opens boolean, ends boolean"


def call(session, seq, tool=READ, agent="a", opens=False, ends=False):
    return (session, seq, agent, tool, [], opens, ends)


def frames(spark, parts):
    return [spark.createDataFrame(p, SCHEMA).withColumn("ts", F.concat(F.lit("t"), "seq")) for p in parts]


def run(spark, parts, folder, name="run", **options):
    stream = batches(spark, folder(f"{name}-calls"), frames(spark, parts))
    events = govern_stream(stream, policy_from_config(spark, POLICY), **options)
    path = folder(name)
    L.write_log(events, f"{path}/log", f"{path}/state", available_now=True).awaitTermination()
    return f"{path}/log"


def one_by_one(parts):
    """Every call judged and sealed in the order of arrival."""
    sessions, used, chains, out = {}, {}, {}, {}
    for part in parts:
        for session, seq, agent, tool, _, opens, ends in sorted(part, key=lambda c: c[1]):
            name = session or ""
            if name not in sessions and opens:
                sessions[name], used[name], chains[name] = None, {}, []
            mine = used.get(name, {})
            late = False
            if name not in sessions:
                reason, chain, events = DEFAULT.messages.not_open, f"{session}#{seq}", []
            else:
                chain, events = name, chains[name]
                late = sessions[name] is not None and seq <= sessions[name]
                sessions[name] = max(seq, sessions[name] or seq)
                if agent == "a" and tool != READ:
                    reason = f"outil '{tool}' absent de l'allowlist"
                elif agent == "a" and mine.get("a", 0) >= 4:
                    reason = "quota de session atteint (4)"
                else:
                    reason, mine[agent] = "ok", mine.get(agent, 0) + 1
            decision = "allow" if reason == "ok" else "deny"
            events.append((seq, f"t{seq}", agent, tool, decision, reason, 0, session, 0))
            sealed = walk_seal(events)[-1]
            out[session, seq] = (decision, reason, chain, len(events) - 1, late, sealed[9], sealed[10])
            if ends and name in sessions:
                del sessions[name]
    return out


def rows_of(spark, path):
    log = L.read_log(spark, path)
    return {(r.session_id, r.id): (r.decision, r.reason, r.chain, r.place, r.late, r.prev_hash, r.hash) for r in log.collect()}


def test_arrival_order_over_batches(spark, folder):
    pick = random.Random(4)
    calls = [call(pick.choice(["hot"] * 3 + ["s1", "s2", "s3"]), k, pick.choice([READ] * 4 + ["x"]), pick.choice("aab"), ends=k in (50, 71)) for k in range(120)]
    first = set()
    parts = [[] for _ in range(6)]
    for k, c in enumerate(calls):
        parts[min(5, k // 20 + pick.choice([0, 0, 0, 1]))].append(c)
    for part in parts:
        for n, c in enumerate(sorted(part, key=lambda c: c[1])):
            if c[0] not in first and c[0] != "s3":
                first.add(c[0])
                part[part.index(c)] = (*c[:5], True, c[6])
    path = run(spark, parts, folder)
    assert rows_of(spark, path) == one_by_one(parts)
    assert any(v[4] for v in rows_of(spark, path).values())
    assert L.verify(spark, path).first().ok


def test_state_goes_with_the_session_and_a_quota_does_not_come_back(spark, folder):
    parts = [
        [call("s", k, opens=k == 0) for k in range(4)] + [call("t", 100, opens=True)],
        [call("s", 4), call("s", 5, ends=True)],
        [call("s", 6), call(None, 7), call("t", 101)],
    ]
    path = run(spark, parts, folder)
    found = {k: v[:3] for k, v in rows_of(spark, path).items()}
    closed = DEFAULT.messages.not_open
    assert [found["s", k][0] for k in range(4)] == ["allow"] * 4
    assert found["s", 4][1] == found["s", 5][1] == "quota de session atteint (4)"
    assert found["s", 6] == ("deny", closed, "s#6") and found[None, 7][1] == closed
    assert found["t", 101][0] == "allow" and open_sessions(spark, path) == 1


def test_sessions_share_the_state_of_a_bucket(spark, folder):
    parts = [[call(f"s{k % 9}" if k % 9 else None, k, opens=k < 9 and k != 4, ends=k in (23, 32)) for k in range(b * 20, b * 20 + 20)] for b in range(2)]
    path = run(spark, parts, folder, buckets=1)
    assert rows_of(spark, path) == one_by_one(parts)
    # All but s4, which was never opened, and s5, which has ended.
    assert open_sessions(spark, path) == 7
    states = spark.read.format("statestore").option("stateVarName", "session").option("flattenCollectionTypes", "false")
    assert states.load(path.replace("/log", "/state")).count() == 1


def open_sessions(spark, path):
    return spark.read.format("statestore").option("stateVarName", "session").load(path.replace("/log", "/state")).count()


def test_an_idle_session_stays_closed(spark, folder):
    parts = [[call("s", 0, opens=True)], [call("t", 1, opens=True)], [call("s", 2), call("t", 3)]]
    path = run(spark, parts, folder, idle_ms=0)
    found = {k: v[1] for k, v in rows_of(spark, path).items()}
    assert found["s", 0] == found["t", 1] == "ok"
    assert found["s", 2] == found["t", 3] == DEFAULT.messages.not_open and open_sessions(spark, path) == 0


def test_a_run_that_was_killed_half_way(spark, folder, monkeypatch):
    """Rows of a batch were written, its anchors not; the next run takes the batch again."""
    parts = [[call(f"s{k % 3}", k, opens=True) for k in range(b * 10, b * 10 + 10)] for b in range(4)]
    write = L.commit

    def killed(path):
        def commit(rows, batch):
            if batch == 2:
                rows.write.mode("overwrite").parquet(f"{path}/events/batch={batch}")
                raise RuntimeError("killed")
            write(path)(rows, batch)

        return commit

    monkeypatch.setattr(L, "commit", killed)
    with pytest.raises(Exception, match="killed"):
        run(spark, parts, folder)
    path = f"{folder('run')}/log"
    before = L.verify(spark, path).first()
    assert not before.ok and before.unanchored == 3
    monkeypatch.setattr(L, "commit", write)
    # The same source and checkpoint in a new query.
    calls = read_stream(spark, folder("run-calls"), frames(spark, parts)[0].schema, files_per_trigger=1)
    events = govern_stream(calls, policy_from_config(spark, POLICY))
    L.write_log(events, path, path.replace("/log", "/state"), available_now=True).awaitTermination()
    assert rows_of(spark, path) == one_by_one(parts)
    assert tuple(L.verify(spark, path).first())[:2] == (True, 40)


def test_lost_and_edited_rows_of_a_stream_log(spark, folder):
    parts = [[call(f"s{k % 3}", k, opens=True) for k in range(b * 12, b * 12 + 12)] for b in range(2)]
    path = run(spark, parts, folder)
    log, anchored = L.read_log(spark, path), L.newest_anchors(spark, path)
    assert anchored.count() == 3 and {r.rows for r in anchored.collect()} == {8}
    for rows, kind in ((log.filter("id <> 10"), "edited"), (log.filter("id < 20"), "missing"), (log.withColumn("tool", F.lit("x")), "edited")):
        assert {r.kind for r in K.key_findings(rows, anchored, "chain", "place").collect()} == {kind}
