import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gatehouse.operators import authorize as A
from gatehouse.operators import joins
from gatehouse.schemas import TOOL_CALLS
from gatehouse.settings import DEFAULT
from gatehouse.sources.policy import DEFAULT_POLICY, policy_from_config, read_policy

READ = "read_text_file"


@pytest.fixture(scope="module")
def policy(spark):
    return policy_from_config(spark, DEFAULT_POLICY)


def rows(spark, calls, session="s"):
    """Calls as (tool, path) or (tool, {name: value})."""
    out = []
    for seq, (tool, args) in enumerate(calls):
        args = args if isinstance(args, dict) else {"path": args}
        out.append((session, seq, "summarizer", tool, [(k, v) for k, v in args.items()]))
    return spark.createDataFrame(out, TOOL_CALLS)


def verdicts(spark, policy, calls):
    found = A.authorize(rows(spark, calls), policy).orderBy("seq").collect()
    return [(r.allowed, r.reason) for r in found]


def test_each_check(spark, policy):
    assert verdicts(
        spark,
        policy,
        [
            (READ, "docs/lifts.txt"),
            ("write_file", "docs/lifts.txt"),
            ("send_email", {"to": "nora.lind@mail.example"}),
            (READ, "docs/CONFIDENTIAL_budget.txt"),
            (READ, "docs/list..old.txt"),
        ],
    ) == [
        (True, "ok"),
        (False, "outil 'write_file' sur la liste interdite"),
        (False, "outil 'send_email' absent de l'allowlist"),
        (False, "acces aux donnees 'confidential' interdit"),
        (True, "ok"),
    ]


@pytest.mark.parametrize(
    "path", ["../../srv/keys", "docs/../../keys", "..", "a/..", "a\\..\\b", "..\n", '["a", "../keys"]', '[".."]']
)
def test_traversal(spark, policy, path):
    assert verdicts(spark, policy, [(READ, path)]) == [(False, "path traversal ('..') refuse")]


@pytest.mark.parametrize("path", ["a..b", "..\r", "...", "a/...", "..x/y", "[..", '["a..b", null, 3]', "[]"])
def test_no_traversal(spark, policy, path):
    assert verdicts(spark, policy, [(READ, path)]) == [(True, "ok")]


def test_quota_comes_before_traversal_and_tag(spark, policy):
    calls = [(READ, "a.txt")] * 11 + [(READ, "../x"), ("write_file", "x"), (READ, "confidential")]
    found = verdicts(spark, policy, calls)
    assert [ok for ok, _ in found] == [True] * 10 + [False] * 4
    assert [reason for _, reason in found[10:]] == [
        "quota de session atteint (10)",
        "quota de session atteint (10)",
        "outil 'write_file' sur la liste interdite",
        "quota de session atteint (10)",
    ]


def test_refused_calls_use_no_quota(spark, policy):
    calls = [("write_file", "x")] * 5 + [(READ, "../x")] * 5 + [(READ, "a")] * 10
    assert [ok for ok, _ in verdicts(spark, policy, calls)] == [False] * 10 + [True] * 10


def test_unknown_agent(spark, policy):
    calls = rows(spark, [(READ, "a")]).withColumn("agent", F.lit("nobody"))
    with pytest.raises(PySparkException, match="nobody"):
        A.authorize(calls, policy).collect()
    refused = A.authorize(calls, policy, strict=False).first()
    assert not refused.allowed and "nobody" in refused.reason
    assert A.unknown_agents(calls, policy).count() == 1


def test_first_tag_by_argument_then_tag(spark):
    config = {"agents": {"summarizer": {"deny_path_tags": ["Secret", "plan"]}}}
    policy = policy_from_config(spark, config)
    args = {"a": "the plan", "b": "a secret plan"}
    assert verdicts(spark, policy, [("any", args), ("any", {"b": "plan SECRET"})]) == [
        (False, "acces aux donnees 'plan' interdit"),
        (False, "acces aux donnees 'secret' interdit"),
    ]


def test_empty_policy_allows_everything(spark):
    policy = policy_from_config(spark, {"agents": {"summarizer": {}}})
    assert all(ok for ok, _ in verdicts(spark, policy, [("anything", "x")] * 30))


def test_quota_of_zero(spark):
    policy = policy_from_config(spark, {"agents": {"summarizer": {"max_calls_per_session": 0}}})
    assert verdicts(spark, policy, [("x", "y")]) == [(False, "quota de session atteint (0)")]


def test_read_policy(spark, folder):
    path = folder("policy")
    spark.createDataFrame([('{"agent": "a", "deny_path_tags": ["X"]}',)], "value string").write.text(path)
    row = read_policy(spark, path).first()
    assert (row.allowed_tools, row.deny_path_tags, row.max_calls_per_session) == ([], ["x"], None)


def sequential(calls, quotas):
    """What one call after the other would get, by session and agent."""
    used, out = {}, {}
    for session, seq, agent, tool, args in sorted(calls, key=lambda c: c[1]):
        path, quota = args[0][1], quotas[agent]
        key = (session, agent)
        if tool == "write_file":
            verdict = "denied"
        elif tool == "send_email":
            verdict = "unlisted"
        elif quota is not None and used.get(key, 0) >= quota:
            verdict = "quota"
        elif path == "..":
            verdict = "traversal"
        elif path == "confidential":
            verdict = "tag"
        else:
            verdict = "ok"
            used[key] = used.get(key, 0) + 1
        out[session, seq] = verdict
    return out


WORDS = {"interdite": "denied", "allowlist": "unlisted", "quota": "quota", "traversal": "traversal",
         "donnees": "tag", "ok": "ok"}


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as they are cut, however small."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("ranges, partitions", [(1, 1), (4, 8), (7, 3), (40, 20)])
def test_random_sessions_equal_the_sequential_walk(spark, many_ranges, ranges, partitions):
    many_ranges(ranges)
    pick = random.Random(ranges + partitions)
    quotas = {"a": 3, "b": 7, "c": None, "d": 0}
    config = {
        "agents": {
            name: {
                "allowed_tools": [READ],
                "denied_tools": ["write_file"],
                "max_calls_per_session": quota,
                "deny_path_tags": ["confidential"],
            }
            for name, quota in quotas.items()
        }
    }
    policy = policy_from_config(spark, config)
    calls = [
        (
            "hot" if pick.random() < 0.4 else f"s{pick.randrange(20)}",
            seq,
            pick.choice("abcd"),
            pick.choice([READ] * 4 + ["write_file", "send_email"]),
            [("path", pick.choice(["x", "y", "..", "confidential"]))],
        )
        for seq in range(800)
    ]
    frame = spark.createDataFrame(calls, TOOL_CALLS).repartition(partitions)
    found = {}
    for r in A.authorize(frame, policy).collect():
        found[r.session_id, r.seq] = next(v for k, v in WORDS.items() if k in r.reason)
    assert found == sequential(calls, quotas)


def test_no_task_holds_a_session(spark, policy, many_ranges):
    """A long session covers many ranges, and only one row for each of them meets the others."""
    many_ranges(8)
    checked = A.check_calls(rows(spark, [(READ, "a")] * 4000), A.prepare(policy))
    ends = A.last_allowed(checked, ["session_id", "agent"], ["seq"])
    assert [tuple(r) for r in ends.select("_last_allowed.seq").collect()] == [(9,)]
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan
    # Below the running sum, calls were counted: their own exchange carries partial counts.
    assert plan.index("Window") < plan.index("HashAggregate") < plan.rindex("Scan parquet")


@pytest.mark.parametrize("quota", [1, 1000, 1001, 5000, 11_999, 12_000])
def test_quota_of_any_size(spark, many_ranges, quota):
    many_ranges(6)
    policy = policy_from_config(spark, {"agents": {"a": {"max_calls_per_session": quota}}})
    calls = [("hot" if k % 7 else f"s{k % 5}", k, "a", READ, [("path", "..")] if k % 10 == 0 else []) for k in range(14_000)]
    found = A.authorize(spark.createDataFrame(calls, TOOL_CALLS).repartition(5), policy).collect()
    by_session = {}
    for r in sorted(found, key=lambda r: r.seq):
        by_session.setdefault(r.session_id, []).append(r)
    for own in by_session.values():
        allowed = 0
        for r in own:
            assert r.allowed == (allowed < quota and r.seq % 10 != 0)
            allowed += r.allowed
    assert {r.reason for r in found if not r.allowed and r.seq % 10} <= {f"quota de session atteint ({quota})"}


def test_reasons_are_settings(spark, policy):
    assert DEFAULT.messages.quota_reached.format(10) == "quota de session atteint (10)"


def test_a_tag_inside_a_list(spark, policy):
    found = verdicts(spark, policy, [(READ, '["docs/a.txt", "docs/Confidential/b.txt"]')])
    assert found == [(False, "acces aux donnees 'confidential' interdit")]


def test_two_lines_for_one_agent_are_an_error(spark, policy):
    with pytest.raises(ValueError, match="2 lines for 1 agents"):
        A.prepare(policy.union(policy))


def test_several_agents(spark):
    """An empty allow-list allows every tool, a missing quota any number of calls."""
    config = {
        "agents": {
            "open": {"denied_tools": ["write_file"], "max_calls_per_session": 2},
            "endless": {"allowed_tools": [READ]},
            "none": {"max_calls_per_session": 0},
        }
    }
    rules = policy_from_config(spark, config)
    made = [("s", n, agent, tool, []) for n, (agent, tool) in enumerate(
        [("open", "x"), ("open", "write_file"), ("endless", "x"), ("open", "y"), ("open", "z"), ("none", "x"), ("who", "x")]
        + [("endless", READ)] * 30
    )]
    found = A.authorize(spark.createDataFrame(made, TOOL_CALLS), rules, strict=False).orderBy("seq").collect()
    assert [r.allowed for r in found] == [True, False, False, True, False, False, False] + [True] * 30
    assert found[4].reason == "quota de session atteint (2)" and found[5].reason == "quota de session atteint (0)"


def test_a_wide_policy_is_not_broadcast(spark, policy, monkeypatch):
    def hinted():
        return "broadcast" in A.prepare(policy).table._jdf.queryExecution().logical().toString().lower()

    assert hinted()
    monkeypatch.setattr(joins, "SMALL_BYTES", 10)
    assert not hinted()
