"""The registered queries: every job, run on views over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.functions.event_hash import GENESIS, event_hash, payload
from gatehouse.functions.injection import RULES
from gatehouse.functions.pii import KINDS, PII_PATTERNS
from gatehouse.operators import chain, key_chain, partials, reports
from gatehouse.operators.authorize import authorize, unknown_agents
from gatehouse.operators.egress import sanitize_egress
from gatehouse.operators.injection import neutralize, rule_hits, scan_injection
from gatehouse.operators.pii import pii_report, redact_pii
from gatehouse.plans.audit_trail import append_sealed, open_log
from gatehouse.plans.audit_trail import verify as verify_trail
from gatehouse.plans.driver_views import table, view, with_args
from gatehouse.plans.governed import GovernedRun, govern, with_session_label
from gatehouse.schemas import STEPS
from gatehouse.session import shared_folder, stored
from gatehouse.sources.audit_log import (
    append_events,
    append_if_empty,
    count_events,
    events_since,
    export_csv,
    newest_first,
    read_events,
    upgrade,
)
from gatehouse.sources.documents import join_blocks, read_documents
from gatehouse.sources.policy import DEFAULT_POLICY, DEMO_POLICY, policy_from_config
from gatehouse.sources.rules import read_rules, rules_table
from gatehouse.streaming import sealed_log
from gatehouse.streaming.audit import bucket_figures, kpi_stream, seal_stream, write_buckets
from gatehouse.streaming.files import read_stream, write_stream
from gatehouse.streaming.govern import govern_stream
from gatehouse.streaming.quota import authorize_stream

Query = Callable[[SparkSession, str], DataFrame]

# Every kind of policy; sessions also have an agent that has none.
POLICIES = {
    "agents": {
        **DEFAULT_POLICY["agents"],
        "clerk": {"denied_tools": ["send_email"], "max_calls_per_session": 25},
        "archivist": {
            "allowed_tools": ["read_text_file", "send_email"],
            "deny_path_tags": ["Budget", "confidential"],
        },
    }
}

JOURNAL_DECISIONS = ("allow", "deny", "trace")
JOURNAL_TOOLS = ("read_text_file", "write_file", "user_request")
JOURNAL_SESSIONS = ("1", "2", "3", "5", "8", "13")
SINCE = 400
#: Micro-batches of a stream that is made from a table, and the files that each of them brings.
BATCHES, BATCH_FILES = 5, 4
BUCKET_FORMAT = "yyyy-MM-dd HH:mm:ss"


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_audit")


def policy(spark: SparkSession) -> DataFrame:
    return policy_from_config(spark, POLICIES)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_args(view(spark, sf_dir, "v_calls"))


def text_of(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


# Reports


def kpi_metrics(spark, sf_dir):
    return reports.kpi_metrics(audit(spark, sf_dir))


def event_count(spark, sf_dir):
    return count_events(audit(spark, sf_dir))


def count_by_decision(spark, sf_dir):
    return reports.count_by_decision(audit(spark, sf_dir))


def decision_counts(spark, sf_dir):
    return reports.decision_counts(audit(spark, sf_dir))


def latency_by_tool(spark, sf_dir):
    return reports.latency_by_tool(audit(spark, sf_dir))


def newest_events(spark, sf_dir):
    return newest_first(audit(spark, sf_dir))


def security_feed(spark, sf_dir):
    return reports.security_feed(audit(spark, sf_dir)).select("id", "tool", "label", "reason")


def replay_view(spark, sf_dir):
    return reports.replay_view(audit(spark, sf_dir)).select("id", "tool", "label", "reason")


def journal_filter(spark, sf_dir):
    kept = reports.journal(
        audit(spark, sf_dir), JOURNAL_DECISIONS, JOURNAL_TOOLS, JOURNAL_SESSIONS
    )
    return reports.journal_table(kept).select(
        "id", "shown_at", "tool", "decision", "reason", "ms", "session", "pii"
    )


def filter_options(spark, sf_dir):
    return reports.filter_options(audit(spark, sf_dir))


def decisions_seen(spark, sf_dir):
    return reports.decisions_seen(audit(spark, sf_dir))


def decisions_covered(spark, sf_dir):
    return reports.covers(audit(spark, sf_dir), ["allow", "egress"])


def iso_log(spark, sf_dir):
    """The log with its time as ISO text, as a real one stores it."""
    text = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
    log = audit(spark, sf_dir).withColumn("ts", text).drop("event_ts")
    return reports.with_event_time(log)


def iso_times(spark, sf_dir):
    return iso_log(spark, sf_dir).select("id", reports.shown_time().alias("shown_at"))


def decision_timeline(spark, sf_dir):
    found = reports.decision_timeline(iso_log(spark, sf_dir))
    return found.withColumn("bucket", F.date_format("bucket", BUCKET_FORMAT))


def timeline_extent(spark, sf_dir):
    return reports.timeline_extent(iso_log(spark, sf_dir)).select(
        reports.shown_time("first_ts").alias("first_at"),
        reports.shown_time("last_ts").alias("last_at"),
    )


def timeline_positions(spark, sf_dir):
    found = reports.timeline_positions(iso_log(spark, sf_dir))
    return found.select("id", "decision", F.round("position", 9).alias("position"))


def session_summary(spark, sf_dir):
    found = reports.session_summary(audit(spark, sf_dir))
    times = {"first_at": reports.shown_time("first_ts"), "last_at": reports.shown_time("last_ts")}
    return found.withColumns(times).drop("first_ts", "last_ts")


def events_after(spark, sf_dir):
    return events_since(audit(spark, sf_dir), SINCE).select("id", "tool", "decision", "reason")


def legacy_upgrade(spark, sf_dir):
    """Half of the log as an early version wrote it, half as today; key figures over both."""
    log = audit(spark, sf_dir).drop("event_ts")
    odd = F.col("id") % 2 == 1
    early = log.filter(odd).select("id", "ts", "agent", "tool", "decision", "reason", "latency_ms")
    today = log.filter(~odd).withColumn("hash", F.sha2("ts", 256))
    return upgrade(early.unionByName(today, allowMissingColumns=True)).agg(
        F.count("*").alias("events"),
        F.count("hash").alias("sealed"),
        F.count("session_id").alias("with_session"),
        F.sum("pii_redacted").alias("pii_redacted"),
    )


def csv_export(spark, sf_dir):
    """The log as CSV files, read back."""
    log, path = audit(spark, sf_dir).drop("event_ts"), shared_folder(spark, "csv")
    export_csv(log, path)
    return spark.read.schema(log.schema).option("header", True).option("escape", '"').csv(path)


def load_if_empty(spark, sf_dir):
    """A log that is loaded once; the second load finds it there."""
    log, path = iso_log(spark, sf_dir).drop("event_ts"), shared_folder(spark, "loaded")
    loads = [append_if_empty(open_log(spark, path), log, path) for _ in range(2)]
    return count_events(open_log(spark, path)).select(*(F.lit(x).alias(n) for n, x in zip(("first", "second"), loads)), "events")


#: Documents that go into one file.
FILE_DOCS = 50


def documents_from_files(spark, sf_dir):
    """Documents written as text files, FILE_DOCS to a file, and read by path."""
    docs, path = table(spark, sf_dir, "documents"), shared_folder(spark, "files")
    dealt = docs.select(F.expr(f"doc_id div {FILE_DOCS}").alias("bucket"), "doc_id", "text")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "doc_id").drop("doc_id")
    ordered.write.partitionBy("bucket").text(path)
    files = read_documents(spark, path).filter("path LIKE 'bucket=%'")
    return files.select(
        F.regexp_extract("path", "^bucket=([0-9]+)/", 1).cast("bigint").alias("bucket"),
        F.char_length("text").alias("n_chars"),
        F.sha2("text", 256).alias("digest"),
    )


# Personal data and outgoing answers


def as_text(counts: str) -> Column:
    """A map of counts as `kind=n` pairs."""
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def pii_counts(spark, sf_dir):
    """The counts of each document as a map, kinds without a hit left out."""
    found = redact_pii(view(spark, sf_dir, "v_pii").select("doc_id", "text"))
    return found.select("doc_id", F.size("counts").alias("kinds"), as_text("counts").alias("counts"))


def egress_counts(spark, sf_dir):
    found = sanitize_egress(view(spark, sf_dir, "v_answers"))
    return found.select("conv_id", "turn", as_text("pii_counts").alias("counts"))


def pii_email_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    patterns = [(k, p) for k, p in PII_PATTERNS if k == "email"]
    return redact_pii(docs, patterns=patterns).select("doc_id", "n_email", "total", "summary")


def pii_redact(spark, sf_dir):
    found = redact_pii(view(spark, sf_dir, "v_pii").select("doc_id", "text"))
    return found.select("doc_id", "text", *[f"n_{k}" for k in KINDS], "total", "summary")


def pii_redact_no_phone(spark, sf_dir):
    docs = view(spark, sf_dir, "v_pii").select("doc_id", "text")
    patterns = [(k, p) for k, p in PII_PATTERNS if k != "phone"]
    return redact_pii(docs, patterns=patterns).select("doc_id", "text", "total", "summary")


def pii_report_by_source(spark, sf_dir):
    return pii_report(redact_pii(view(spark, sf_dir, "v_pii")), "lang", "source")


def pii_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return redact_pii(pages).select("page_id", "text", "total", "summary")


SANITIZED = ("text", "images_removed", "links_removed", "pii_redacted", "clean", "egress_summary")


def egress_sanitize(spark, sf_dir):
    found = sanitize_egress(view(spark, sf_dir, "v_answers"))
    return found.select("conv_id", "turn", *SANITIZED)


def egress_urls(spark, sf_dir):
    return sanitize_egress(view(spark, sf_dir, "v_urls")).select("page_id", *SANITIZED)


def egress_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return sanitize_egress(pages).select("page_id", *SANITIZED)


# Injection scan


def verdicts(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "safe", "score", text_of("matches"), "reason")


def injection_scan(spark, sf_dir):
    return verdicts(scan_injection(view(spark, sf_dir, "v_docs")))


def injection_rules_table(spark, sf_dir):
    """The scan with its rules read from JSON lines."""
    path = shared_folder(spark, "rules")
    rules_table(spark, RULES).write.json(path)
    return verdicts(scan_injection(view(spark, sf_dir, "v_docs"), rules=read_rules(spark, path)))


def injection_encoded(spark, sf_dir):
    return verdicts(scan_injection(view(spark, sf_dir, "v_encoded")))


def injection_fullwidth(spark, sf_dir):
    return verdicts(scan_injection(view(spark, sf_dir, "v_fullwidth")))


def injection_rule_hits(spark, sf_dir):
    return rule_hits(scan_injection(view(spark, sf_dir, "v_docs")), "source")


def neutralized(spark, sf_dir):
    return neutralize(view(spark, sf_dir, "v_docs")).select("doc_id", "safe", "text")


def joined_blocks(spark, sf_dir):
    """Lines of a document as the text blocks of a tool output."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", join_blocks(F.split("text", "\n")).alias("text"))


# Policy


def policy_authorize(spark, sf_dir):
    found = authorize(calls(spark, sf_dir), policy(spark), strict=False)
    return found.select("session_id", "seq", "tool", "allowed", "reason")


def policy_authorize_demo(spark, sf_dir):
    found = authorize(calls(spark, sf_dir), policy_from_config(spark, DEMO_POLICY), strict=False)
    return found.select("session_id", "seq", "tool", "allowed", "reason")


def policy_quota(spark, sf_dir):
    found = authorize(calls(spark, sf_dir), policy(spark), strict=False)
    over = F.col("reason").startswith("quota")
    return found.groupBy("session_id").agg(
        F.count(F.when(F.col("allowed"), 1)).alias("allowed"),
        F.count(F.when(over, 1)).alias("over_quota"),
    )


#: An agent with a large quota, and one with a small one.
LARGE_QUOTA = {
    "agents": {
        "porter": {"allowed_tools": ["read_text_file"], "max_calls_per_session": 5000},
        "runner": {"max_calls_per_session": 3},
    }
}


def policy_quota_large(spark, sf_dir):
    """A quota of thousands, and a session that holds nine tenths of all calls."""
    found = authorize(with_args(view(spark, sf_dir, "v_hot_calls")), policy_from_config(spark, LARGE_QUOTA))
    return found.select("session_id", "seq", "tool", "allowed", "reason")


def policy_reason_counts(spark, sf_dir):
    found = authorize(calls(spark, sf_dir), policy(spark), strict=False)
    return found.groupBy("reason").agg(F.count("*").alias("calls"))


def policy_unknown_agents(spark, sf_dir):
    return unknown_agents(calls(spark, sf_dir), policy(spark)).select("agent", "session_id", "seq")


# Hash chain


def event_hashes(spark, sf_dir):
    """Each event hashed as if it were the first of a chain."""
    own = event_hash(F.lit(GENESIS), payload())
    return audit(spark, sf_dir).select("id", own.alias("hash"))


def sealed(spark, sf_dir):
    return chain.seal(audit(spark, sf_dir).drop("event_ts"))


def chain_seal(spark, sf_dir):
    return sealed(spark, sf_dir).select("id", "prev_hash", "hash")


def chain_last_hash(spark, sf_dir):
    return chain.last_hash(sealed(spark, sf_dir))


def chain_anchors(spark, sf_dir):
    return chain.anchors(sealed(spark, sf_dir))


def chain_verify(spark, sf_dir):
    return chain.verify_chain(sealed(spark, sf_dir), chain.SEGMENT_ROWS)


def chain_verify_tampered(spark, sf_dir):
    edited = F.when(F.col("id") % 997 == 500, "allowed later").otherwise(F.col("reason"))
    log = sealed(spark, sf_dir).withColumn("reason", edited)
    return chain.verify_chain(log, chain.SEGMENT_ROWS)


def chain_bad_links(spark, sf_dir):
    """A log with some rows deleted: the row after each gap is bad."""
    log = sealed(spark, sf_dir).filter(F.col("id") % 331 != 7)
    return chain.with_link_check(log, chain.SEGMENT_ROWS).filter("bad").select("id")


#: Damage to a sealed log, by name: which rows are lost.
LOSSES = {
    "border row": "id % 4096 = 1023",
    "middle row": "id % 331 = 7",
    "tail of a segment": "id div 1024 % 3 = 1 AND id % 1024 >= 900",
    "whole segment": "id div 1024 % 4 = 2",
    "end of the log": "id >= (SELECT max(event_id) - 5 FROM {events})",
    "nothing": "false",
}


def chain_verify_deleted(spark, sf_dir):
    """Verification of a log that lost rows, once for each kind of loss."""
    log = stored(sealed(spark, sf_dir), "sealed")
    anchored = stored(chain.segment_anchors(log), "anchors")
    found = None
    for name, lost in LOSSES.items():
        rest = spark.sql(f"SELECT * FROM {{log}} WHERE NOT ({lost})", log=log, events=table(spark, sf_dir, "events"))
        one = chain.verify_log(rest, anchored).withColumn("loss", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def chain_findings(spark, sf_dir):
    """All lost and edited ids of a log that was damaged in both ways."""
    log = stored(sealed(spark, sf_dir), "sealed")
    anchored = stored(chain.segment_anchors(log), "anchors")
    edited = F.when(F.col("id") % 997 == 500, "allowed later").otherwise(F.col("reason"))
    damaged = log.filter("id % 331 <> 7 AND id % 1024 <> 1023").withColumn("reason", edited)
    return chain.findings(damaged, anchored)


def hot_log(spark, sf_dir):
    return view(spark, sf_dir, "v_hot_audit").drop("event_ts")


def chain_seal_sessions(spark, sf_dir):
    """One unbroken chain per session; one of them has a third of all rows."""
    return key_chain.seal_chains(hot_log(spark, sf_dir), "session_id").select("id", "session_id", "prev_hash", "hash")


def chain_seal_log(spark, sf_dir):
    """One unbroken chain over the whole log."""
    return key_chain.seal_chains(audit(spark, sf_dir).drop("event_ts"), None).select("id", "prev_hash", "hash")


#: Ids below this are of an early version and were never sealed.
LEGACY = 300


def chain_verify_legacy(spark, sf_dir):
    """An unbroken log behind unsealed early rows, whole and edited."""
    log = audit(spark, sf_dir).drop("event_ts")
    early = log.filter(F.col("id") < LEGACY).withColumns({"prev_hash": F.lit(None).cast("string"), "hash": F.lit(None).cast("string")})
    log = stored(early.unionByName(key_chain.seal_chains(log.filter(F.col("id") >= LEGACY), None)), "legacy-log")
    edited = F.when(F.col("id") % 997 == 500, "allowed later").otherwise(F.col("reason"))
    checks = [(log, "whole"), (log.withColumn("reason", edited), "edited")]
    one, other = (chain.verify_chain(rows).withColumn("log", F.lit(name)) for rows, name in checks)
    return one.unionByName(other)


#: Damage to a log with a chain per session: which rows are lost.
SESSION_LOSSES = {
    "nothing": "false",
    "middle rows": "id % 331 = 7",
    "the end of the log": "id >= (SELECT max(event_id) * 9 div 10 FROM {events})",
    "whole sessions": "session_id IN ('3', '8', '11')",
    "the hot session": "session_id = 'hot'",
}


def chain_verify_sessions(spark, sf_dir):
    """Verification per session against the anchored heads, once for each kind of loss, and with edited rows and anchors."""
    log = stored(key_chain.seal_chains(hot_log(spark, sf_dir), "session_id"), "sessions")
    anchored = stored(key_chain.anchor_heads(key_chain.key_heads(log, "session_id"), "session_id"), "session-anchors")
    events = table(spark, sf_dir, "events")
    cases = [(name, spark.sql(f"SELECT * FROM {{log}} WHERE NOT coalesce({lost}, false)", log=log, events=events), anchored) for name, lost in SESSION_LOSSES.items()]
    edited = F.when(F.col("id") % 997 == 500, "allowed later").otherwise(F.col("reason"))
    cases.append(("edited rows", log.withColumn("reason", edited), anchored))
    forged = F.when(F.col("session_id") == "5", F.sha2("head", 256)).otherwise(F.col("head"))
    cases.append(("a forged anchor", log, anchored.withColumn("head", forged)))
    found = None
    for name, rows, anchors in cases:
        one = key_chain.verify_keys(rows, anchors, "session_id").withColumn("loss", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def governed_log_path(spark, sf_dir) -> str:
    """A log that a governed run was appended to in two batches, half of the sessions each."""
    # The times of the view are no dates, but the log is laid out by day.
    day = F.format_string("2024-01-%02dT08:00:00+00:00", F.pmod("call_no", F.lit(28)) + 1)
    events = stored(governed(spark, sf_dir).events.withColumn("ts", day), "events")
    path = shared_folder(spark, "log")
    first = F.substring(F.sha2("session_id", 256), 1, 1) < "8"
    for batch in (events.filter(first), events.filter(~first)):
        append_sealed(batch, [*PLACED, "phase"], path)
    return path


def governed_sealed(spark, sf_dir):
    """The log of a governed run, read back and verified."""
    path = governed_log_path(spark, sf_dir)
    log = open_log(spark, path)
    numbers = log.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    kpis = reports.kpi_metrics(log)
    # One row each.
    return verify_trail(spark, path).join(F.broadcast(numbers), F.lit(True)).join(F.broadcast(kpis), F.lit(True))


def governed_log(spark, sf_dir):
    """The same log, row by row: every event under the id that its place gives."""
    log = open_log(spark, governed_log_path(spark, sf_dir))
    return log.select("id", "session_id", "tool", "decision", "reason", "latency_ms", "pii_redacted")


def chain_previous(spark, sf_dir):
    """The hash that precedes each event in the whole log, across all segments."""
    rows = audit(spark, sf_dir).select("id", F.sha2(F.col("ts"), 256).alias("hash"))
    return chain.with_previous(rows, "id", "hash").select("id", "previous")


# Governed run


def governed(spark, sf_dir) -> GovernedRun:
    steps = with_args(view(spark, sf_dir, "v_steps")).select(*[f.name for f in STEPS.fields])
    return govern(
        view(spark, sf_dir, "v_requests"),
        steps,
        view(spark, sf_dir, "v_governed_docs"),
        policy(spark),
        strict=False,
    )


PLACED = ("session_id", "step_no", "call_no")


def governed_run_events(spark, sf_dir):
    return governed(spark, sf_dir).events.select(
        *PLACED, "phase", "ts", "tool", "decision", "reason", "latency_ms", "pii_redacted"
    )


def governed_transcript(spark, sf_dir):
    return governed(spark, sf_dir).transcript.select(*PLACED, "role", "name", "content")


def governed_answers(spark, sf_dir):
    return governed(spark, sf_dir).answers.select("session_id", "ended", "clean", "text")


def session_labels(spark, sf_dir):
    """Requests of which every third one came without a session, with the label they get."""
    requests = table(spark, sf_dir, "conversations").filter("turn = 0")
    given = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("s"), "conv_id"))
    return with_session_label(requests.select("conv_id", given.alias("session_id")), "conv_id")


def governed_kpis(spark, sf_dir):
    return reports.kpi_metrics(governed(spark, sf_dir).events)


def step_cap(spark, sf_dir):
    return governed(spark, sf_dir).answers.groupBy("ended").agg(F.count("*").alias("sessions"))


# Streams, run to the end of what the tables hold


def ran(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """What a stream writes until its input is used up."""
    folder = shared_folder(spark, name)
    write_stream(rows, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def streamed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A stream over rows that are first written out as a table."""
    folder = shared_folder(spark, name)
    rows.write.parquet(folder)
    return read_stream(spark, folder, rows.schema)


def arriving(spark: SparkSession, rows: DataFrame, batch: str, name: str) -> DataFrame:
    """A stream that delivers `rows` in BATCHES micro-batches; the SQL text `batch` numbers them from 0.

    Each is written by several tasks. A file source takes files in the order of their time, so a
    batch is written when the one before is complete.
    """
    folder = shared_folder(spark, name)
    for number in range(BATCHES):
        rows.filter(f"({batch}) = {number}").repartition(BATCH_FILES).write.mode("append").parquet(folder)
        files = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
        if files != BATCH_FILES * (number + 1):
            raise ValueError(f"batch {number} has too few rows for {BATCH_FILES} files")
    return read_stream(spark, folder, rows.schema, files_per_trigger=BATCH_FILES)


def in_order(spark: SparkSession, sf_dir: str, number: str) -> str:
    """SQL that deals ids 0, 1, ... into batches of equal length, in order."""
    n = table(spark, sf_dir, "events").count()
    return f"{number} * {BATCHES} div {max(n, 1)}"


def stream_scan(spark, sf_dir):
    docs = streamed(spark, view(spark, sf_dir, "v_docs"), "docs")
    return verdicts(ran(spark, scan_injection(docs), "scan"))


def stream_redact(spark, sf_dir):
    docs = streamed(spark, view(spark, sf_dir, "v_pii"), "docs")
    return ran(spark, redact_pii(docs), "redact").select("doc_id", "text", "total", "summary")


def stream_egress(spark, sf_dir):
    answers = streamed(spark, view(spark, sf_dir, "v_answers"), "answers")
    found = ran(spark, sanitize_egress(answers), "egress")
    return found.select("conv_id", "turn", *SANITIZED)


def stream_quota(spark, sf_dir):
    source = calls(spark, sf_dir).withColumn("ts", F.col("seq").cast("string"))
    stream = arriving(spark, source, in_order(spark, sf_dir, "seq"), "calls")
    found = ran(spark, authorize_stream(stream, policy(spark), strict=False), "quota")
    return found.select("session_id", "seq", "tool", "allowed", "reason")


def stream_seal(spark, sf_dir):
    log = audit(spark, sf_dir).drop("event_ts")
    found = ran(spark, seal_stream(streamed(spark, log, "log")), "seal")
    return found.select("id", "prev_hash", "hash")


def stream_kpis(spark, sf_dir):
    """Buckets that are final: the watermark has passed their end."""
    log = streamed(spark, iso_log(spark, sf_dir), "log")
    found = ran(spark, kpi_stream(log, "1 day", "1 hour"), "kpis")
    return found.withColumn("bucket", F.date_format("bucket", BUCKET_FORMAT))


#: Calls of a governed stream: some arrive one batch late, some sessions are never opened, and some calls end theirs.
GOVERNED_CALLS = """
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY batch, seq) = 1 AND cast(session_id AS bigint) % 7 <> 3 AS opens, seq % 211 = 11 AS ends
FROM (SELECT *, cast(seq AS string) AS ts, least({last}, {batch} + CASE WHEN seq % 17 = 3 THEN 1 ELSE 0 END) AS batch FROM {calls})"""


def governed_stream_log(spark, sf_dir) -> str:
    """The folder of a log that a governed stream has written, in several batches."""
    sql = GOVERNED_CALLS.replace("{last}", str(BATCHES - 1)).replace("{batch}", in_order(spark, sf_dir, "seq"))
    source = stored(with_args(spark.sql(sql, calls=view(spark, sf_dir, "v_calls"))), "dealt-calls")
    folder = shared_folder(spark, "governed")
    stream = arriving(spark, source, "batch", "governed-calls").drop("batch")
    events = govern_stream(stream, policy(spark), strict=False)
    sealed_log.write_log(events, f"{folder}/log", f"{folder}/state", available_now=True).awaitTermination()
    return f"{folder}/log"


def stream_govern(spark, sf_dir):
    """Calls judged and sealed in one stateful job, in the order of arrival."""
    log = sealed_log.read_log(spark, governed_stream_log(spark, sf_dir))
    return log.select("id", "session_id", "tool", "decision", "reason", "chain", "place", "late", "prev_hash", "hash")


def stream_govern_verify(spark, sf_dir):
    """Verification of that log: whole, without its last batch of rows, and with one row lost in the middle of each chain."""
    path = governed_stream_log(spark, sf_dir)
    log, anchored = sealed_log.read_log(spark, path), sealed_log.newest_anchors(spark, path)
    cases = {"nothing": log, "tails": log.filter("id % 1000 < 900"), "edits": log.withColumn("tool", F.when(F.col("id") % 97 == 5, "x").otherwise(F.col("tool")))}
    found = None
    for name, rows in cases.items():
        one = key_chain.verify_keys(rows, anchored, "chain", "place").withColumn("loss", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found.select("loss", "ok", "checked", "edited", "missing", "unanchored")


def stream_buckets(spark, sf_dir):
    """Key figures of all days, the open ones too, and of all events, late ones too."""
    log = dealt_log(spark, sf_dir)
    folder = shared_folder(spark, "buckets")
    write_buckets(log, f"{folder}/figures", f"{folder}/state", "1 day", "1 hour", available_now=True).awaitTermination()
    found = bucket_figures(spark, f"{folder}/figures").drop("sketch")
    return found.withColumn("bucket", F.date_format("bucket", BUCKET_FORMAT))


def dealt_log(spark, sf_dir):
    """The log as a stream in which every 17th event comes a batch late."""
    batch = f"least({BATCHES - 1}, {in_order(spark, sf_dir, 'id')} + CASE WHEN id % 17 = 3 THEN 1 ELSE 0 END)"
    return arriving(spark, iso_log(spark, sf_dir), batch, "bucket-log")


def kpi_incremental(spark, sf_dir):
    """Key figures from partial rows per day, kept up to date while the log grows in three appends."""
    log, folder = iso_log(spark, sf_dir), shared_folder(spark, "grown")
    n = log.count()
    for number in range(3):
        part = log.filter((F.col("id") * 3 >= number * n) & (F.col("id") * 3 < (number + 1) * n))
        append_events(part.drop("event_ts"), f"{folder}/log")
        partials.refresh(read_events(spark, f"{folder}/log"), f"{folder}/days")
    return partials.figures(partials.read_partials(spark, f"{folder}/days"))


QUERIES: dict[str, Query] = {
    "kpi_metrics": kpi_metrics,
    "event_count": event_count,
    "count_by_decision": count_by_decision,
    "decision_counts": decision_counts,
    "latency_by_tool": latency_by_tool,
    "newest_events": newest_events,
    "security_feed": security_feed,
    "replay_view": replay_view,
    "journal_filter": journal_filter,
    "filter_options": filter_options,
    "decisions_seen": decisions_seen,
    "decisions_covered": decisions_covered,
    "iso_times": iso_times,
    "decision_timeline": decision_timeline,
    "timeline_extent": timeline_extent,
    "timeline_positions": timeline_positions,
    "session_summary": session_summary,
    "events_since": events_after,
    "legacy_upgrade": legacy_upgrade,
    "csv_export": csv_export,
    "load_if_empty": load_if_empty,
    "documents_from_files": documents_from_files,
    "pii_counts": pii_counts,
    "egress_counts": egress_counts,
    "pii_email_counts": pii_email_counts,
    "pii_redact": pii_redact,
    "pii_redact_no_phone": pii_redact_no_phone,
    "pii_report": pii_report_by_source,
    "pii_pages": pii_pages,
    "egress_sanitize": egress_sanitize,
    "egress_urls": egress_urls,
    "egress_pages": egress_pages,
    "injection_scan": injection_scan,
    "injection_rules_table": injection_rules_table,
    "injection_encoded": injection_encoded,
    "injection_fullwidth": injection_fullwidth,
    "injection_rule_hits": injection_rule_hits,
    "neutralize": neutralized,
    "joined_blocks": joined_blocks,
    "policy_authorize": policy_authorize,
    "policy_authorize_demo": policy_authorize_demo,
    "policy_quota": policy_quota,
    "policy_quota_large": policy_quota_large,
    "policy_reason_counts": policy_reason_counts,
    "policy_unknown_agents": policy_unknown_agents,
    "event_hash": event_hashes,
    "chain_seal": chain_seal,
    "chain_last_hash": chain_last_hash,
    "chain_anchors": chain_anchors,
    "chain_verify": chain_verify,
    "chain_verify_tampered": chain_verify_tampered,
    "chain_bad_links": chain_bad_links,
    "chain_verify_deleted": chain_verify_deleted,
    "chain_findings": chain_findings,
    "chain_seal_sessions": chain_seal_sessions,
    "chain_seal_log": chain_seal_log,
    "chain_verify_legacy": chain_verify_legacy,
    "chain_verify_sessions": chain_verify_sessions,
    "governed_sealed": governed_sealed,
    "governed_log": governed_log,
    "chain_previous": chain_previous,
    "governed_run_events": governed_run_events,
    "governed_transcript": governed_transcript,
    "governed_answers": governed_answers,
    "governed_kpis": governed_kpis,
    "session_labels": session_labels,
    "step_cap": step_cap,
    "stream_scan": stream_scan,
    "stream_redact": stream_redact,
    "stream_egress": stream_egress,
    "stream_quota": stream_quota,
    "stream_seal": stream_seal,
    "stream_kpis": stream_kpis,
    "stream_govern": stream_govern,
    "stream_govern_verify": stream_govern_verify,
    "stream_buckets": stream_buckets,
    "kpi_incremental": kpi_incremental,
}
