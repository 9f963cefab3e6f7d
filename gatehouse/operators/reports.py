"""Report queries over the audit log.

Groups are few (decisions, tools, hours) and Spark sums them before the shuffle, so a tool with a
third of all rows does no harm. Sorted lists are range-partitioned, never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.settings import DEFAULT, Settings

# The decisions shown in charts, in order, and those in the security feed.
DECISIONS = ("allow", "deny", "firewall", "egress")
SECURITY = ("deny", "firewall", "egress", "error")


def timed_allow() -> Column:
    return (F.col("decision") == "allow") & (F.col("latency_ms") > 0)


def with_event_time(log: DataFrame) -> DataFrame:
    """Adds `event_ts`, the time in the ISO text `ts`."""
    return log.withColumn("event_ts", F.to_timestamp("ts"))


def shown_time(column: str = "event_ts") -> Column:
    return F.date_format(column, "dd MMM yyyy HH:mm:ss")


def kpi_metrics(
    log: DataFrame, settings: Settings = DEFAULT, approximate: bool = False
) -> DataFrame:
    """One row of key figures, from one scan.

    `approximate` estimates the number of sessions, which spares the only large shuffle.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct

    def n(decision: str) -> Column:
        return F.count(F.when(F.col("decision") == decision, 1))

    latency = F.avg(F.when(timed_allow(), F.col("latency_ms")))
    return (
        log.agg(
            F.count("*").alias("events"),
            n("allow").alias("actions_allowed"),
            n("deny").alias("actions_denied"),
            n("firewall").alias("injections_blocked"),
            n("egress").alias("egress_sanitized"),
            n("error").alias("errors"),
            F.coalesce(F.sum("pii_redacted"), F.lit(0)).alias("pii_redacted"),
            distinct("session_id").alias("sessions"),
            F.bround(F.coalesce(latency, F.lit(0.0))).cast("bigint").alias("avg_latency_ms"),
        )
        .withColumn("total_blocked", F.col("actions_denied") + F.col("injections_blocked"))
        .withColumn(
            "minutes_saved",
            F.bround(F.col("actions_allowed") * settings.seconds_saved_per_action / 60, 1),
        )
    )


def count_by_decision(log: DataFrame) -> DataFrame:
    return log.groupBy("decision").agg(F.count("*").alias("events"))


def decision_counts(log: DataFrame) -> DataFrame:
    """Charted decisions in display order, with the highest count beside each."""
    counts = count_by_decision(log.filter(F.col("decision").isin(*DECISIONS)))
    order = F.array_position(F.array(*map(F.lit, DECISIONS)), F.col("decision"))
    # At most one row per charted decision is left for the window.
    peak = F.max("events").over(Window.partitionBy())
    return counts.withColumns({"position": order, "peak": peak}).orderBy("position")


def latency_by_tool(log: DataFrame) -> DataFrame:
    """Mean latency of allowed, timed calls; slowest tool first."""
    means = log.filter(timed_allow()).groupBy("tool").agg(F.avg("latency_ms").alias("latency_ms"))
    return means.orderBy(F.desc("latency_ms"), "tool")


def label(settings: Settings = DEFAULT) -> Column:
    pairs = [F.lit(text) for pair in settings.labels.items() for text in pair]
    return F.coalesce(F.create_map(*pairs)[F.col("decision")], F.col("decision"))


def security_feed(log: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Intercepted events with their label, newest first."""
    return (
        log.filter(F.col("decision").isin(*SECURITY))
        .withColumn("label", F.upper(label(settings)))
        .orderBy(F.desc("id"))
    )


def replay_view(log: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What happened in order, without the requests; a remaining trace is the answer."""
    is_trace = F.col("decision") == "trace"
    shown = F.when(is_trace, F.lit(settings.answer_label)).otherwise(label(settings))
    return (
        log.filter(~(is_trace & (F.col("tool") == "user_request")))
        .withColumn("label", shown)
        .orderBy("id")
    )


def journal(
    log: DataFrame,
    decisions: Sequence[str] | None = None,
    tools: Sequence[str] | None = None,
    sessions: Sequence[str] | None = None,
) -> DataFrame:
    """Rows that match every filter given; rows without a session pass the session filter."""
    if decisions is not None:
        log = log.filter(F.col("decision").isin(*decisions))
    if tools is not None:
        log = log.filter(F.col("tool").isin(*tools))
    if sessions is not None:
        log = log.filter(F.col("session_id").isin(*sessions) | F.col("session_id").isNull())
    return log


def blank_if_zero(column: str) -> Column:
    """Text of a value, empty for null and zero."""
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("0")), F.lit(""))


def journal_table(log: DataFrame) -> DataFrame:
    """The journal as it is shown."""
    return log.withColumns(
        {
            "shown_at": shown_time(),
            "ms": blank_if_zero("latency_ms"),
            "session": F.coalesce("session_id", F.lit("")),
            "pii": blank_if_zero("pii_redacted"),
        }
    )


def filter_options(log: DataFrame) -> DataFrame:
    """Distinct decisions, tools and sessions, as (`filter`, `value`)."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("filter"), F.col(column).alias("value"))
            for name, column in (
                ("decision", "decision"),
                ("tool", "tool"),
                ("session", "session_id"),
            )
        ]
    )
    # One scan; equal pairs are dropped before the shuffle.
    found = log.select(F.inline(pairs)).dropna().distinct()
    return found.orderBy("filter", "value")


def decisions_seen(log: DataFrame) -> DataFrame:
    """Distinct decisions other than traces."""
    return log.filter(~F.col("decision").isin("trace")).select("decision").distinct()


def covers(log: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row: whether every expected decision occurs."""
    wanted = F.when(F.col("decision").isin(*expected), F.col("decision"))
    return log.agg((F.count_distinct(wanted) == len(set(expected))).alias("covered"))


def decision_timeline(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per time bucket and charted decision."""
    return (
        log.filter(F.col("decision").isin(*DECISIONS))
        .groupBy(F.window("event_ts", width), "decision")
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("bucket"), "decision", "events")
    )


def timeline_extent(log: DataFrame) -> DataFrame:
    """First and last charted event."""
    return log.filter(F.col("decision").isin(*DECISIONS)).agg(
        F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts")
    )


def timeline_positions(log: DataFrame) -> DataFrame:
    """Adds `position`, the place of each charted event between first (0) and last (1)."""
    charted = log.filter(F.col("decision").isin(*DECISIONS))
    micros = F.unix_micros("event_ts")
    # Two scalars; a span of zero counts as a second.
    first = charted.agg(F.min(micros)).scalar()
    span = charted.agg(F.max(micros) - F.min(micros)).scalar()
    width = F.coalesce(F.nullif(span, F.lit(0)), F.lit(1_000_000))
    return charted.withColumn("position", (micros - first) / width)


def session_summary(log: DataFrame) -> DataFrame:
    """One row per session: counts by decision, masked items, errors, first and last id.

    A log with `event_ts` also gives the first and the last time.
    """
    counts = [
        F.count(F.when(F.col("decision") == d, 1)).alias(f"n_{d}")
        for d in (*DECISIONS, "error", "trace")
    ]
    timed = "event_ts" in log.columns
    times = [F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts")] if timed else []
    return (
        log.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.count("*").alias("events"),
            *counts,
            F.sum("pii_redacted").alias("pii_redacted"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
            *times,
        )
    )
