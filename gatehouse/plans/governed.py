"""The governed run over whole tables of sessions.

Each tool call passes policy, document fetch, injection scan and masking in this order, and
the first stage that stops it decides its event. Answers are sanitised.

Calls are judged by the policy first. The paths that the allowed ones ask for then filter the
documents, by narrow keys, so only documents that are read are scanned and masked, once each, and no pattern
sees the others. Events take verdicts and counts from there; the shown texts join the transcript alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.policy_checks import argument
from gatehouse.functions.text import fill, first_chars
from gatehouse.operators.authorize import check_calls, decide, join_ends, prepare, quota_ends
from gatehouse.operators.egress import sanitize_egress
from gatehouse.operators.injection import scan_injection
from gatehouse.operators.joins import same_keys
from gatehouse.operators.pii import redact_pii
from gatehouse.session import stored
from gatehouse.settings import DEFAULT, Settings

# Place of an event within its session; the request comes first, the answer last.
PLACE = ["session_id", "step_no", "call_no", "phase"]

# Least number of scan tasks per core, so that none waits long for the last.
TASKS_PER_CORE = 4


@dataclass(frozen=True)
class GovernedRun:
    """Results of a run. Nothing is computed before one of them is used.

    Judged calls and judged documents are tables in the shared folder, written when a result first
    needs them, and shared by all results.
    """

    sessions: DataFrame
    steps: DataFrame
    documents: DataFrame
    policy: DataFrame
    limit: int
    strict: bool
    settings: Settings
    store: bool

    @cached_property
    def judged_calls(self) -> DataFrame:
        """Calls with the verdict of the policy and the path that they read, if any."""
        judged = judge_calls(
            self.steps, self.sessions, self.policy, self.limit, self.strict, self.settings, self.store
        )
        return stored(with_path(judged), "judged-calls")

    @cached_property
    def judged_documents(self) -> DataFrame:
        """Documents that a call reads, with what a model may see of them."""
        read = read_documents(self.documents, self.judged_calls)
        return stored(judge_documents(read, self.settings), "judged-documents")

    @cached_property
    def calls(self) -> DataFrame:
        found = fetch(self.judged_calls, self.judged_documents, self.settings)
        return stored(found, "calls") if self.store else found

    @cached_property
    def answers(self) -> DataFrame:
        found = final_answers(self.sessions, self.limit, self.settings)
        return stored(found, "answers") if self.store else found

    @cached_property
    def events(self) -> DataFrame:
        return call_events(self.calls).unionByName(session_events(self.answers, self.settings))

    @cached_property
    def transcript(self) -> DataFrame:
        return transcript(self.calls, self.answers, self.settings)


def with_session_label(requests: DataFrame, request_id: str) -> DataFrame:
    """Fills a missing `session_id` with eight hex digits, the same on every run."""
    made = F.substring(F.sha2(F.col(request_id).cast("string"), 256), 1, 8)
    return requests.withColumn("session_id", F.coalesce("session_id", made))


def session_ends(steps: DataFrame, max_steps: int) -> DataFrame:
    """The first answer or model failure of each session within the step limit."""
    # min_by is merged before the shuffle: one row per session and task moves.
    ends = steps.filter(
        F.col("kind").isin("answer", "llm_error") & (F.col("step_no") < max_steps)
    )
    return ends.groupBy("session_id").agg(
        F.min_by(
            F.struct("step_no", "kind", "text", "error"), F.struct("step_no", "call_no")
        ).alias("end")
    )


def govern(
    requests: DataFrame,
    steps: DataFrame,
    documents: DataFrame,
    policy: DataFrame,
    max_steps: int | None = None,
    strict: bool = True,
    settings: Settings = DEFAULT,
    store: bool = False,
) -> GovernedRun:
    """Schemas are in `schemas`; `requests` has one row per session.

    With `store`, the finished calls and the answers are written to the shared folder once too, and
    events and transcript are made from there. Worthwhile if more than one result is used.
    """
    limit = settings.max_steps if max_steps is None else max_steps
    sessions = requests.select(
        "session_id", "agent", F.col("text").alias("request"), F.col("ts").alias("request_ts")
    ).join(session_ends(steps, limit), "session_id", "left")
    return GovernedRun(sessions, steps, documents, policy, limit, strict, settings, store)


def judge_calls(
    steps: DataFrame,
    sessions: DataFrame,
    policy: DataFrame,
    limit: int,
    strict: bool,
    settings: Settings,
    store: bool,
) -> DataFrame:
    """Calls that were made before their session ended, with the policy's decision."""
    order = ["step_no", "call_no"]
    thin = sessions.select(
        F.col("session_id").alias("_session"),
        "agent",
        "request_ts",
        F.coalesce("end.step_no", F.lit(limit)).alias("_end"),
    )
    # Two passes over the calls. The first finds where quotas end and moves narrow rows only.
    # What it finds goes to the sessions, so that the second joins each call just once.
    rules = prepare(policy)
    ends = quota_ends(
        check_calls(calls_made(steps, thin, limit), rules),
        rules,
        ["session_id", "agent"],
        order,
        store,
    )
    thin = join_ends(thin, ends, {"session_id": "_session", "agent": "agent"})
    checked = check_calls(calls_made(steps, thin, limit), rules)
    return decide(checked, order, strict, settings).withColumnRenamed("reason", "policy_reason")


def calls_made(steps: DataFrame, thin: DataFrame, limit: int) -> DataFrame:
    """Calls proposed before the end of their session, with what is known of the session."""
    proposed = steps.filter((F.col("kind") == "tool_call") & (F.col("step_no") < limit))
    joined = proposed.join(thin, same_keys(proposed, thin, {"session_id": "_session"}), "left")
    # A session without a request has no agent; the policy check reports it.
    return (
        joined.filter(F.col("step_no") < F.coalesce("_end", F.lit(limit)))
        .withColumn("ts", F.coalesce("ts", "request_ts"))
        .drop("_session", "_end", "kind", "text", "request_ts")
    )


def with_path(calls: DataFrame) -> DataFrame:
    """Adds `_reads`, the path of a call that gets as far as its document."""
    asked = argument(F.col("args"), "path")
    return calls.withColumns(
        {"_asked": asked, "_reads": F.when(F.col("allowed") & F.col("error").isNull(), asked)}
    )


def read_documents(documents: DataFrame, calls: DataFrame) -> DataFrame:
    """The documents that a call reads. A path is a narrow key, and is sent once per task and path.

    Scanning a text costs far more than moving it, and files with few row groups would leave the scan to
    as few tasks. So the texts are dealt out anew, to some tasks per core at least. The number is given,
    because adaptive execution joins parts until there is hardly one per core, and a last one runs alone.
    """
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    paths = calls.filter(F.col("_reads").isNotNull()).select(F.col("_reads").alias("path")).distinct()
    return documents.join(paths, "path", "left_semi").repartition(parts, "path", "text")


def judge_documents(documents: DataFrame, settings: Settings) -> DataFrame:
    """What a model may see of each document, and why."""
    scanned = scan_injection(documents, settings=settings)
    masked = redact_pii(scanned, settings=settings)
    return masked.select(
        F.col("path").alias("_path"),
        F.col("safe").alias("_safe"),
        F.col("reason").alias("_scan_reason"),
        F.col("total").alias("_pii"),
        F.when(F.col("total") > 0, F.col("summary")).alias("_pii_summary"),
        F.when(F.col("safe"), F.col("text"))
        .otherwise(F.lit(settings.messages.withheld))
        .alias("_shown"),
    )


def fetch(calls: DataFrame, judged: DataFrame, settings: Settings) -> DataFrame:
    """Adds `decision`, `reason`, `pii_redacted` and `message`, the text the model gets."""
    texts = settings.messages
    # Refused calls fetch nothing. Their key matches no path and differs per call, so that
    # they spread over all tasks instead of meeting in the one for null.
    no_path = F.concat_ws("\0", F.lit(""), "session_id", "step_no", "call_no")
    keyed = calls.withColumn("_key", F.coalesce("_reads", no_path))
    joined = keyed.join(judged, F.col("_key") == F.col("_path"), "left")

    missing = fill(texts.missing_document, F.coalesce("_asked", F.lit("path")))
    failure = fill(
        texts.tool_failed,
        F.coalesce(F.col("error"), F.when(F.col("_path").isNull(), missing)),
    )
    decision = (
        F.when(~F.col("allowed"), "deny")
        .when(F.col("error").isNotNull() | F.col("_path").isNull(), "error")
        .when(~F.col("_safe"), "firewall")
        .otherwise("allow")
    )
    full_reason = by_decision(
        deny=F.col("policy_reason"),
        error=failure,
        firewall=F.col("_scan_reason"),
        allow=F.coalesce("_pii_summary", F.lit(texts.ok)),
    )
    full, shown = F.col("full_reason"), F.col("_shown")
    cut = first_chars(full, settings.trace_limit)
    return (
        joined.withColumn("decision", decision)
        .withColumn("full_reason", full_reason)
        .withColumns(
            {
                "reason": F.when(F.col("decision") == "error", cut).otherwise(full),
                "message": by_decision(
                    deny=fill(texts.blocked_message, full),
                    error=fill(texts.error_message, full),
                    firewall=shown,
                    allow=shown,
                ),
                "pii_redacted": by_decision(allow=F.col("_pii"), otherwise=F.lit(0)),
                "latency_ms": by_decision(
                    deny=F.lit(0), otherwise=F.coalesce("latency_ms", F.lit(0))
                ),
            }
        )
        .drop("_asked", "_reads", "_key", "_path", "_safe", "_scan_reason", "_pii", "_pii_summary", "_shown")
    )


def by_decision(otherwise: Column | None = None, **values: Column) -> Column:
    chosen = F.coalesce(
        *[F.when(F.col("decision") == name, value) for name, value in values.items()]
    )
    if otherwise is None:
        return chosen
    return F.when(F.col("decision").isin(*values), chosen).otherwise(otherwise)


def call_events(calls: DataFrame) -> DataFrame:
    return calls.select(
        "session_id",
        "step_no",
        "call_no",
        F.lit(1).alias("phase"),
        "ts",
        "agent",
        "tool",
        "decision",
        "reason",
        "latency_ms",
        "pii_redacted",
    )


def final_answers(sessions: DataFrame, limit: int, settings: Settings) -> DataFrame:
    """One sanitised answer per session, with how the session `ended`."""
    texts = settings.messages
    ended = F.coalesce(F.col("end.kind"), F.lit("max_steps"))
    given = (
        F.when(ended == "llm_error", F.lit(texts.aborted_answer))
        .when(ended == "max_steps", F.lit(texts.stopped_answer))
        .otherwise(F.coalesce(F.col("end.text"), F.lit("")))
    )
    return sanitize_egress(
        sessions.select(
            "session_id",
            "agent",
            "request",
            F.col("request_ts").alias("ts"),
            F.coalesce("end.step_no", F.lit(limit)).cast("bigint").alias("end_step"),
            ended.alias("ended"),
            F.col("end.error").alias("error"),
            given.alias("text"),
        ),
        settings=settings,
    )


def session_events(answers: DataFrame, settings: Settings) -> DataFrame:
    """Request, model failure, sanitising and answer, all made from one row per session."""
    texts, cut = settings.messages, settings.trace_limit

    def event(step, phase, tool, decision, reason, pii=None, when=None):
        made = F.struct(
            F.lit(step).cast("bigint").alias("step_no") if isinstance(step, int) else step.alias("step_no"),
            F.lit(0).cast("bigint").alias("call_no"),
            F.lit(phase).alias("phase"),
            F.lit(tool).alias("tool"),
            F.lit(decision).alias("decision"),
            reason.alias("reason"),
            (F.lit(0) if pii is None else pii).alias("pii_redacted"),
        )
        return made if when is None else F.when(when, made)

    end = F.col("end_step")
    failure = first_chars(fill(texts.model_failed, F.coalesce("error", F.lit(""))), cut)
    made = F.array(
        event(-1, 0, "user_request", "trace", first_chars(F.col("request"), cut)),
        event(end, 2, "llm_chat", "error", failure, when=F.col("ended") == "llm_error"),
        event(
            end,
            3,
            "final_answer",
            "egress",
            F.col("egress_summary"),
            F.col("pii_redacted"),
            when=~F.col("clean"),
        ),
        event(end, 4, "final_answer", "trace", first_chars(F.col("text"), cut)),
    )
    # The outer form: Spark would copy the sanitising into a filter on the inner one.
    return answers.select(
        "session_id",
        "ts",
        "agent",
        F.lit(0).alias("latency_ms"),
        F.inline_outer(F.array_compact(made)),
    )


def transcript(calls: DataFrame, answers: DataFrame, settings: Settings) -> DataFrame:
    """What the model was shown, message by message, in the order of (step_no, call_no)."""
    opening = answers.select(
        "session_id",
        F.inline_outer(
            F.array(
                _message(-2, "system", F.lit(settings.messages.system_prompt)),
                _message(-1, "user", F.col("request")),
            )
        ),
    )
    outputs = calls.select(
        "session_id",
        "step_no",
        "call_no",
        F.lit("tool").alias("role"),
        F.col("tool").alias("name"),
        F.col("message").alias("content"),
    )
    return opening.unionByName(outputs)


def _message(step: int, role: str, content: Column) -> Column:
    return F.struct(
        F.lit(step).cast("bigint").alias("step_no"),
        F.lit(0).cast("bigint").alias("call_no"),
        F.lit(role).alias("role"),
        F.lit(None).cast("string").alias("name"),
        content.alias("content"),
    )
