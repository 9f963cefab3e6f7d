"""SQL twins of the registered queries, for DuckDB.

DuckDB's patterns know neither look-around nor a Unicode-aware word edge. The masking twins
therefore put a mark at every place where one holds and let the pattern match the mark.
"""

from __future__ import annotations

from gatehouse.functions.event_hash import GENESIS
from gatehouse.functions.injection import ZERO_WIDTH
from gatehouse.functions.pii import KINDS, marker
from gatehouse.functions.text import SPACE, WORD
from gatehouse.operators.chain import FAN, SEGMENT_ROWS
from gatehouse.plans import queries as Q
from gatehouse.plans.driver_views import view_sql
from gatehouse.settings import DEFAULT
from gatehouse.sources.audit_log import SHOWN
from gatehouse.sources.policy import DEMO_POLICY

TEXTS = DEFAULT.messages
MARK = "\ue000"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inside(template: str, *values: str) -> str:
    """The SQL of a message with its `{}` filled in."""
    pieces = [quoted(piece) for piece in template.split("{}")]
    parts = [pieces[0]]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value, piece]
    return "concat(" + ", ".join(parts) + ")"


def in_list(values) -> str:
    return ", ".join(map(quoted, values))


AUDIT = view_sql("v_audit")
CHARTED = "('allow', 'deny', 'firewall', 'egress')"
TIMED = "decision = 'allow' AND latency_ms > 0"
SHOWN_AT = "strftime({}, '%d %b %Y %H:%M:%S')"


def audit_sql(body: str) -> str:
    return f"WITH v AS ({AUDIT}) {body}"


def label_sql(answer: bool = False) -> str:
    labels = dict(DEFAULT.labels)
    if answer:
        labels["trace"] = DEFAULT.answer_label
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in labels.items())
    return f"CASE decision {arms} ELSE decision END"


KPI_COLUMNS = f"""
  count(*) AS events,
  count(*) FILTER (decision = 'allow') AS actions_allowed,
  count(*) FILTER (decision = 'deny') AS actions_denied,
  count(*) FILTER (decision = 'firewall') AS injections_blocked,
  count(*) FILTER (decision = 'egress') AS egress_sanitized,
  count(*) FILTER (decision = 'error') AS errors,
  cast(coalesce(sum(pii_redacted), 0) AS bigint) AS pii_redacted,
  count(DISTINCT session_id) AS sessions,
  cast(round_even(coalesce(avg(latency_ms) FILTER ({TIMED}), 0), 0) AS bigint) AS avg_latency_ms,
  count(*) FILTER (decision IN ('deny', 'firewall')) AS total_blocked,
  round_even(count(*) FILTER (decision = 'allow') * 90 / 60, 1) AS minutes_saved"""

REPORTS = {
    "kpi_metrics": audit_sql(f"SELECT {KPI_COLUMNS} FROM v"),
    "event_count": audit_sql("SELECT count(*) AS events FROM v"),
    "count_by_decision": audit_sql("SELECT decision, count(*) AS events FROM v GROUP BY decision"),
    "decision_counts": audit_sql(f"""
SELECT decision, count(*) AS events, max(count(*)) OVER () AS peak,
  list_position(['allow', 'deny', 'firewall', 'egress'], decision) AS position
FROM v WHERE decision IN {CHARTED} GROUP BY decision ORDER BY position"""),
    "latency_by_tool": audit_sql(f"""
SELECT tool, avg(latency_ms) AS latency_ms FROM v WHERE {TIMED}
GROUP BY tool ORDER BY latency_ms DESC, tool"""),
    "newest_events": audit_sql(f"SELECT id, {', '.join(SHOWN)} FROM v ORDER BY id DESC"),
    "security_feed": audit_sql(f"""
SELECT id, tool, upper({label_sql()}) AS label, reason FROM v
WHERE decision IN ('deny', 'firewall', 'egress', 'error') ORDER BY id DESC"""),
    "replay_view": audit_sql(f"""
SELECT id, tool, {label_sql(answer=True)} AS label, reason FROM v
WHERE NOT (decision = 'trace' AND tool = 'user_request') ORDER BY id"""),
    "journal_filter": audit_sql(f"""
SELECT id, {SHOWN_AT.format("event_ts")} AS shown_at, tool, decision, reason,
  coalesce(nullif(cast(latency_ms AS string), '0'), '') AS ms,
  coalesce(session_id, '') AS session,
  coalesce(nullif(cast(pii_redacted AS string), '0'), '') AS pii
FROM v WHERE decision IN ({in_list(Q.JOURNAL_DECISIONS)}) AND tool IN ({in_list(Q.JOURNAL_TOOLS)})
  AND (session_id IN ({in_list(Q.JOURNAL_SESSIONS)}) OR session_id IS NULL)"""),
    "filter_options": audit_sql("""
SELECT 'decision' AS "filter", decision AS "value" FROM v
UNION SELECT 'tool', tool FROM v
UNION SELECT 'session', session_id FROM v WHERE session_id IS NOT NULL ORDER BY 1, 2"""),
    "decisions_seen": audit_sql("SELECT DISTINCT decision FROM v WHERE decision <> 'trace'"),
    "decisions_covered": audit_sql("""
SELECT count(DISTINCT decision) = 2 AS covered FROM v WHERE decision IN ('allow', 'egress')"""),
    "iso_times": audit_sql(f"SELECT id, {SHOWN_AT.format('event_ts')} AS shown_at FROM v"),
    "decision_timeline": audit_sql(f"""
SELECT strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M:%S') AS bucket, decision,
  count(*) AS events FROM v WHERE decision IN {CHARTED} GROUP BY 1, 2"""),
    "timeline_extent": audit_sql(f"""
SELECT {SHOWN_AT.format("min(event_ts)")} AS first_at, {SHOWN_AT.format("max(event_ts)")} AS last_at
FROM v WHERE decision IN {CHARTED}"""),
    "timeline_positions": audit_sql(f"""
SELECT id, decision, round((epoch_us(event_ts) - epoch_us(min(event_ts) OVER ())) /
  coalesce(nullif(epoch_us(max(event_ts) OVER ()) - epoch_us(min(event_ts) OVER ()), 0), 1000000), 9)
  AS position
FROM v WHERE decision IN {CHARTED}"""),
    "session_summary": audit_sql("""
SELECT session_id, count(*) AS events,
  count(*) FILTER (decision = 'allow') AS n_allow, count(*) FILTER (decision = 'deny') AS n_deny,
  count(*) FILTER (decision = 'firewall') AS n_firewall,
  count(*) FILTER (decision = 'egress') AS n_egress,
  count(*) FILTER (decision = 'error') AS n_error, count(*) FILTER (decision = 'trace') AS n_trace,
  cast(sum(pii_redacted) AS bigint) AS pii_redacted, min(id) AS first_id, max(id) AS last_id,
  """ + SHOWN_AT.format("min(event_ts)") + " AS first_at, " + SHOWN_AT.format("max(event_ts)") + """ AS last_at
FROM v WHERE session_id IS NOT NULL GROUP BY session_id"""),
    "events_since": audit_sql(f"""
SELECT id, tool, decision, reason FROM v WHERE id > {Q.SINCE} ORDER BY id"""),
    "legacy_upgrade": audit_sql("""
SELECT count(*) AS events, count(*) FILTER (id % 2 = 0) AS sealed,
  count(session_id) FILTER (id % 2 = 0) AS with_session,
  cast(sum(pii_redacted) FILTER (id % 2 = 0) AS bigint) AS pii_redacted FROM v"""),
    "csv_export": audit_sql("SELECT * EXCLUDE (event_ts) FROM v"),
    "load_if_empty": audit_sql('SELECT true AS "first", false AS "second", count(*) AS events FROM v'),
    "documents_from_files": f"""
SELECT doc_id // {Q.FILE_DOCS} AS bucket, length(t)::INT AS n_chars, sha256(t) AS digest
FROM (SELECT doc_id // {Q.FILE_DOCS} AS bucket, any_value(doc_id) AS doc_id, string_agg(text || chr(10), '' ORDER BY doc_id) AS t
  FROM documents GROUP BY 1)""",
}

# Masking

EDGED = {
    "iban": f"{MARK}[A-Z]{{2}}\\p{{Nd}}{{2}}(?:(?:{MARK} {MARK})?[A-Z0-9]{{4}}){{2,7}}"
    f"(?:(?:{MARK} {MARK})?[A-Z0-9]{{1,4}})?{MARK}",
    "card": f"{MARK}(?:\\p{{Nd}}{{4}}{MARK}[ -]{MARK}){{3}}\\p{{Nd}}{{4}}{MARK}",
    "email": f"{MARK}[{MARK}{WORD}.+-]+@[{MARK}{WORD}-]+\\.[{MARK}{WORD}.-]+{MARK}",
    "phone": f"{MARK}(?:{MARK}\\+{MARK})?\\p{{Nd}}(?:\\p{{Nd}}|{MARK}[ .-]{MARK}){{7,14}}"
    f"\\p{{Nd}}{MARK}",
}


def marked(kind: str) -> str:
    """`text` with marks: for phones around all that may stand beside one, else at word edges."""
    around = f"[^{WORD}/]" if kind == "phone" else f"[{WORD}]+"
    wrapped = f"regexp_replace(text, '({around})', '{MARK}\\1{MARK}', 'g')"
    return f"concat('{MARK}', {wrapped}, '{MARK}')" if kind == "phone" else wrapped


def masking(source: str, kinds=KINDS, name: str = "masked") -> str:
    """CTEs from `source`(text, ...) to `masked` with the counts, `total` and `summary`."""
    ctes, before = [], source
    for kind in kinds:
        ctes.append(f"m_{kind} AS (SELECT *, {marked(kind)} AS marks FROM {before})")
        ctes.append(
            f"""d_{kind} AS (SELECT * EXCLUDE (marks) REPLACE (
  replace(regexp_replace(marks, '{EDGED[kind]}', '{marker(kind)}', 'g'), '{MARK}', '') AS text),
  cast(len(regexp_extract_all(marks, '{EDGED[kind]}')) AS int) AS n_{kind} FROM m_{kind})"""
        )
        before = f"d_{kind}"
    total = " + ".join(f"n_{k}" for k in kinds)
    parts = ", ".join(f"CASE WHEN n_{k} > 0 THEN concat(n_{k}, ' {k}') END" for k in kinds)
    summary = inside(TEXTS.pii_masked, total, f"concat_ws(', ', {parts})")
    ctes.append(
        f"""{name} AS (SELECT *, {total} AS total,
  CASE WHEN {total} = 0 THEN {quoted(TEXTS.no_pii)} ELSE {summary} END AS summary FROM {before})"""
    )
    return ",\n".join(ctes)


def with_source(sql: str, ctes: str, body: str) -> str:
    return f"WITH source AS ({sql}),\n{ctes}\n{body}"


PAGES = "SELECT page_id, html AS text FROM pages"
NO_PHONE = tuple(k for k in KINDS if k != "phone")
MASKING = {
    "pii_email_counts": with_source(
        "SELECT doc_id, text FROM documents",
        masking("source", ("email",)),
        "SELECT doc_id, n_email, total, summary FROM masked",
    ),
    "pii_redact": with_source(
        view_sql("v_pii"),
        masking("source"),
        f"SELECT doc_id, text, {', '.join(f'n_{k}' for k in KINDS)}, total, summary FROM masked",
    ),
    "pii_redact_no_phone": with_source(
        view_sql("v_pii"),
        masking("source", NO_PHONE),
        "SELECT doc_id, text, total, summary FROM masked",
    ),
    "pii_report": with_source(
        view_sql("v_pii"),
        masking("source"),
        f"""SELECT lang, source, count(*) AS texts, count(*) FILTER (total > 0) AS texts_with_pii,
  {", ".join(f"cast(sum(n_{k}) AS bigint) AS n_{k}" for k in KINDS)},
  cast(sum(total) AS bigint) AS total FROM masked GROUP BY lang, source""",
    ),
    "pii_pages": with_source(
        PAGES, masking("source"), "SELECT page_id, text, total, summary FROM masked"
    ),
}
PAIRS = f"concat_ws(',', {', '.join(f"CASE WHEN n_{k} > 0 THEN '{k}=' || n_{k} END" for k in KINDS)})"
MASKING["pii_counts"] = with_source(
    view_sql("v_pii"),
    masking("source"),
    f"SELECT doc_id, ({' + '.join(f'(n_{k} > 0)::INT' for k in KINDS)})::INT AS kinds, {PAIRS} AS counts FROM masked",
)
MASKING["stream_redact"] = with_source(
    view_sql("v_pii"), masking("source"), "SELECT doc_id, text, total, summary FROM masked"
)

# Outgoing answers

# An image from outside, a link and a bare URL with a query, in DuckDB's dialect.
IMAGE_SQL = "!\\[[^\\]]*\\]\\([[:space:]]*https?://[^)]*\\)"
LINK_SQL = "\\[[^\\]]*\\]\\([[:space:]]*https?://[^)?]*\\?[^)]*\\)"
URL_SQL = "https?://[^[:space:])\\]]+\\?[^[:space:])\\]]+"


def sanitizing(source: str, name: str = "sanitized") -> str:
    stages = (
        (IMAGE_SQL, TEXTS.image_marker, "images"),
        (LINK_SQL, TEXTS.link_marker, "links"),
        (URL_SQL, TEXTS.link_marker, "urls"),
    )
    ctes, before = [], source
    for pattern, mark, count in stages:
        ctes.append(
            f"""e_{count} AS (SELECT * REPLACE (
  regexp_replace(text, '{pattern}', '{mark}', 'g') AS text),
  cast(len(regexp_extract_all(text, '{pattern}')) AS int) AS {count} FROM {before})"""
        )
        before = f"e_{count}"
    ctes.append(masking(before, name="e_masked"))
    parts = ", ".join(
        f"CASE WHEN {count} > 0 THEN {inside(template, count)} END"
        for template, count in (
            (TEXTS.image_part, "images"),
            (TEXTS.link_part, "(links + urls)"),
            (TEXTS.pii_part, "total"),
        )
    )
    clean = "images + links + urls + total = 0"
    ctes.append(
        f"""{name} AS (SELECT * EXCLUDE (summary), images AS images_removed,
  links + urls AS links_removed, total AS pii_redacted, {clean} AS clean,
  CASE WHEN {clean} THEN {quoted(TEXTS.ok)}
    ELSE {inside(TEXTS.egress, f"concat_ws(', ', {parts})")} END AS egress_summary
  FROM e_masked)"""
    )
    return ",\n".join(ctes)


SANITIZED = ", ".join(Q.SANITIZED)
ANSWERS = with_source(
    view_sql("v_answers"),
    sanitizing("source"),
    f"SELECT conv_id, turn, {SANITIZED} FROM sanitized",
)
EGRESS = {
    "egress_counts": with_source(
        view_sql("v_answers"), sanitizing("source"), f"SELECT conv_id, turn, {PAIRS} AS counts FROM sanitized"
    ),
    "egress_sanitize": ANSWERS,
    "stream_egress": ANSWERS,
    "egress_urls": with_source(
        view_sql("v_urls"), sanitizing("source"), f"SELECT page_id, {SANITIZED} FROM sanitized"
    ),
    "egress_pages": with_source(
        PAGES, sanitizing("source"), f"SELECT page_id, {SANITIZED} FROM sanitized"
    ),
}

# Injection scan

# Name, pattern and weight of the rules, in DuckDB's dialect.
RULES = (
    (
        "override-instructions",
        "(ignore|disregard|forget) (your |the |all |previous |prior )*"
        "(instructions|prompts?|rules|everything)",
        2,
    ),
    ("fake-system", f"(^|[^{WORD}])system[{SPACE}]*:", 2),
    ("new-instructions", f"new instructions?[{SPACE}]*:", 2),
    (
        "role-hijack",
        f"(you are now($|[^{WORD}])|act as (an? |the )?(admin|root|developer|system))",
        2,
    ),
    ("reveal-prompt", "reveal (your|the) (system )?prompt", 2),
    ("exfil-explicit", "(exfiltrate|leak (the|all|internal))", 2),
    ("send-to-target", "send (it|them|the|this|all)[^\\n]{0,60}(to|@)", 1),
    (
        "urgency-override",
        "(before doing anything else|do this first|immediately and without)",
        1,
    ),
    ("tool-coercion", f"(use|call) the [{WORD}]+ tool", 1),
)
FORMS = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))


def scanning(source: str, name: str = "scanned", full_width: bool = False) -> str:
    """CTEs from `source`(text, ...) to `scanned` with safe, score, matches and reason.

    DuckDB has no NFKC; the only changes that matter here are those of full-width forms.
    """
    stripped = f"translate(text, '{ZERO_WIDTH}', '')"
    plain = f"translate({stripped}, {quoted(FORMS)}, {quoted(PLAIN)})" if full_width else stripped
    hits = [f"CASE WHEN regexp_matches(low, '{p}') THEN '{n}' END" for n, p, _ in RULES]
    hits.append("CASE WHEN hidden >= 3 THEN 'hidden-text' END")
    any_rule = " OR ".join(f"regexp_matches(d, '{p}')" for _, p, _ in RULES)
    hits.append(
        f"CASE WHEN len(list_filter(decoded, lambda d: d IS NOT NULL AND ({any_rule}))) > 0 "
        "THEN 'encoded-payload' END"
    )
    weights = {n: w for n, _, w in RULES} | {"hidden-text": 1, "encoded-payload": 2}
    weight = " ".join(f"WHEN '{n}' THEN {w}" for n, w in weights.items())
    return f"""s_text AS (SELECT *, lower({plain}) AS low,
  length(text) - length({stripped}) AS hidden,
  list_transform(regexp_extract_all(text, '[A-Za-z0-9+/]{{40,}}={{0,2}}'),
    lambda b: CASE WHEN length(b) % 4 = 0 THEN lower(try(decode(from_base64(b)))) END) AS decoded
  FROM {source}),
s_found AS (SELECT * EXCLUDE (low, hidden, decoded),
  list_filter([{", ".join(hits)}], lambda m: m IS NOT NULL) AS found FROM s_text),
s_score AS (SELECT *, cast(coalesce(list_sum(list_transform(found,
  lambda m: CASE m {weight} END)), 0) AS int) AS score FROM s_found),
{name} AS (SELECT * EXCLUDE (found), found, array_to_string(found, ',') AS matches,
  score < {DEFAULT.block_threshold} AS safe,
  CASE WHEN score < {DEFAULT.block_threshold} THEN {quoted(TEXTS.ok)}
    ELSE {inside(TEXTS.injection, "score", "array_to_string(found, ', ')")} END AS reason
  FROM s_score)"""


VERDICTS = "SELECT doc_id, safe, score, matches, reason FROM scanned"
SCANNED = with_source(view_sql("v_docs"), scanning("source"), VERDICTS)
SCANS = {
    "injection_scan": SCANNED,
    "stream_scan": SCANNED,
    "injection_encoded": with_source(view_sql("v_encoded"), scanning("source"), VERDICTS),
    "injection_fullwidth": with_source(
        view_sql("v_fullwidth"), scanning("source", full_width=True), VERDICTS
    ),
    "injection_rule_hits": with_source(
        view_sql("v_docs"),
        scanning("source"),
        """SELECT rule, source, count(*) AS hits
FROM (SELECT source, unnest(found) AS rule FROM scanned) GROUP BY rule, source""",
    ),
    "neutralize": with_source(
        view_sql("v_docs"),
        scanning("source"),
        f"""SELECT doc_id, safe, CASE WHEN safe THEN text ELSE {quoted(TEXTS.withheld)} END AS text
FROM scanned""",
    ),
    "joined_blocks": "SELECT doc_id, replace(text, chr(10), '') AS text FROM documents",
}

# Policy


def per_agent(config: dict, condition, otherwise: str = "false") -> str:
    """A CASE over the agents of a policy; `condition` makes SQL from the rules of one."""
    arms = [(agent, condition(rules)) for agent, rules in config["agents"].items()]
    shown = " ".join(f"WHEN {quoted(a)} THEN {sql}" for a, sql in arms if sql)
    return f"CASE agent {shown} ELSE {otherwise} END" if shown else otherwise


def tag_found(rules: dict) -> str:
    tags = [tag.lower() for tag in rules.get("deny_path_tags", [])]
    arms = " ".join(f"WHEN contains(lower(path), {quoted(t)}) THEN {quoted(t)}" for t in tags)
    return f"CASE {arms} END" if arms else ""


TRAVERSES = "'(^|[\\\\/])\\.\\.([\\\\/]|$)'"


def judging(source: str, config: dict, order: str = "seq", name: str = "judged") -> str:
    """CTEs from `source`(session_id, agent, tool, path, ...) to `judged` with allowed and reason."""

    def listed(key):
        return lambda r: f"tool IN ({in_list(r[key])})" if r.get(key) else ""

    def limit(rules):
        return str(rules["max_calls_per_session"]) if "max_calls_per_session" in rules else ""

    return f"""c_static AS (SELECT *, agent IN ({in_list(config["agents"])}) AS known,
  {per_agent(config, listed("denied_tools"))} AS denied,
  NOT {per_agent(config, listed("allowed_tools"), "true")} AS unlisted,
  regexp_matches(path, {TRAVERSES}) OR coalesce(len(list_filter(
    CASE WHEN starts_with(path, '[') AND json_valid(path) THEN CAST(path::JSON AS VARCHAR[]) END,
    lambda p: regexp_matches(p, {TRAVERSES}))), 0) > 0 AS traverses,
  {per_agent(config, tag_found, "NULL")} AS tag,
  cast({per_agent(config, limit, "NULL")} AS int) AS most FROM {source}),
c_prior AS (SELECT *, coalesce(sum(CASE WHEN NOT denied AND NOT unlisted AND NOT traverses
  AND tag IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, agent ORDER BY {order}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM c_static),
c_reason AS (SELECT *, CASE
  WHEN NOT known THEN {inside(TEXTS.unknown_agent, "agent")}
  WHEN denied THEN {inside(TEXTS.deny_listed, "tool")}
  WHEN unlisted THEN {inside(TEXTS.not_allow_listed, "tool")}
  WHEN prior >= most THEN {inside(TEXTS.quota_reached, "most")}
  WHEN traverses THEN {quoted(TEXTS.traversal)}
  WHEN tag IS NOT NULL THEN {inside(TEXTS.forbidden_tag, "tag")} END AS refusal FROM c_prior),
{name} AS (SELECT * EXCLUDE (refusal), refusal IS NULL AS allowed,
  coalesce(refusal, {quoted(TEXTS.ok)}) AS reason FROM c_reason)"""


def calls_sql(body: str, config: dict = Q.POLICIES, calls: str = "v_calls") -> str:
    return with_source(view_sql(calls), judging("source", config), body)


JUDGED = "SELECT session_id, seq, tool, allowed, reason FROM judged"
POLICY = {
    "policy_authorize": calls_sql(JUDGED),
    "stream_quota": calls_sql(JUDGED),
    "policy_authorize_demo": calls_sql(JUDGED, DEMO_POLICY),
    "policy_quota": calls_sql("""
SELECT session_id, count(*) FILTER (allowed) AS allowed,
  count(*) FILTER (starts_with(reason, 'quota')) AS over_quota FROM judged GROUP BY session_id"""),
    "policy_quota_large": calls_sql(JUDGED, Q.LARGE_QUOTA, "v_hot_calls"),
    "policy_reason_counts": calls_sql(
        "SELECT reason, count(*) AS calls FROM judged GROUP BY reason"
    ),
    "policy_unknown_agents": f"""
SELECT agent, session_id, seq FROM ({view_sql("v_calls")}) WHERE agent = 'nobody'""",
}

# Hash chain

REST = """concat_ws('|', ts, agent, tool, decision, reason, cast(latency_ms AS string),
  coalesce(session_id, 'None'), cast(pii_redacted AS string))"""


def sealing(key: str, source: str = AUDIT) -> str:
    """CTEs with `sealed`(chain, id, prev_hash, hash): one chain per value of `key`."""
    return f"""placed AS (SELECT {key} AS chain, id, {REST} AS rest,
  row_number() OVER (PARTITION BY {key} ORDER BY id) AS place FROM ({source})),
sealed AS (
  SELECT chain, id, place, '{GENESIS}' AS prev_hash, sha256(concat('{GENESIS}', '|', rest)) AS hash
  FROM placed WHERE place = 1
  UNION ALL
  SELECT p.chain, p.id, p.place, s.hash, sha256(concat(s.hash, '|', p.rest))
  FROM sealed s JOIN placed p ON p.chain = s.chain AND p.place = s.place + 1)"""


SEGMENTS = sealing(f"id // {SEGMENT_ROWS}")
CHECKED = "cast(count(*) AS bigint) AS checked"
HEADS = f"""
heads AS (SELECT chain AS block, count(*) AS "rows", min(id) AS first_id, max(id) AS last_id,
  arg_max(hash, id) AS head FROM sealed GROUP BY chain),
roots AS (SELECT block // {FAN} AS block, cast(sum("rows") AS bigint) AS "rows",
  min(first_id) AS first_id, max(last_id) AS last_id,
  list_reduce(list_prepend('{GENESIS}',
    list(concat_ws('|', block, "rows", first_id, last_id, head) ORDER BY block)),
    lambda a, b: sha256(concat(a, '|', b))) AS head
  FROM heads GROUP BY block // {FAN})"""
CHAIN = {
    "event_hash": audit_sql(f"SELECT id, sha256(concat('{GENESIS}', '|', {REST})) AS hash FROM v"),
    "chain_seal": f"WITH RECURSIVE {SEGMENTS} SELECT id, prev_hash, hash FROM sealed",
    "chain_last_hash": f"WITH RECURSIVE {SEGMENTS} SELECT arg_max(hash, id) AS last_hash FROM sealed",
    # Up to FAN segments make two levels; larger tables would need a third.
    "chain_anchors": f"""WITH RECURSIVE {SEGMENTS}, {HEADS}
SELECT 1 AS level, * FROM heads
UNION ALL SELECT 2, * FROM roots WHERE (SELECT max(block) FROM heads) > 0""",
    "chain_verify": audit_sql(
        f"SELECT true AS ok, {CHECKED}, cast(NULL AS bigint) AS first_bad_id FROM v"
    ),
    "chain_verify_tampered": audit_sql(f"""
SELECT count(*) FILTER (id % 997 = 500) = 0 AS ok, {CHECKED},
  min(id) FILTER (id % 997 = 500) AS first_bad_id FROM v"""),
    "chain_bad_links": audit_sql(f"""
SELECT min(n.id) AS id FROM v d JOIN v n
  ON n.id = d.id + 1 AND n.id // {SEGMENT_ROWS} = d.id // {SEGMENT_ROWS}
WHERE d.id % 331 = 7 GROUP BY d.id"""),
    "chain_previous": audit_sql("SELECT id, lag(sha256(ts)) OVER (ORDER BY id) AS previous FROM v"),
}

LOST = "\nUNION ALL ".join(
    f"""SELECT {quoted(name)} AS loss, count(*) FILTER ({lost}) = 0 AS ok,
  count(*) FILTER (NOT ({lost})) AS checked, min(id) FILTER ({lost}) AS first_bad_id FROM v"""
    for name, condition in Q.LOSSES.items()
    for lost in [condition.format(events="events").replace(" div ", " // ")]
)
CHAIN["chain_verify_deleted"] = audit_sql(LOST)
CHAIN["chain_findings"] = audit_sql("""
SELECT id, 'missing' AS kind FROM v WHERE id % 331 = 7 OR (id % 1024 = 1023 AND (id - 1) % 331 <> 7)
UNION ALL SELECT id, 'edited' FROM v WHERE id % 997 = 500 AND id % 331 <> 7 AND id % 1024 <> 1023""")

SESSION = "coalesce(session_id, '')"
HOT = view_sql("v_hot_audit")
CHAIN["chain_seal_sessions"] = f"""WITH RECURSIVE {sealing(SESSION, HOT)}
SELECT id, nullif(chain, '') AS session_id, prev_hash, hash FROM sealed"""
CHAIN["chain_seal_log"] = f"WITH RECURSIVE {sealing('0')} SELECT id, prev_hash, hash FROM sealed"
CHAIN["chain_verify_legacy"] = audit_sql(f"""
SELECT 'whole' AS log, true AS ok, {CHECKED}, cast(NULL AS bigint) AS first_bad_id FROM v WHERE id >= {Q.LEGACY}
UNION ALL SELECT 'edited', count(*) FILTER (id % 997 = 500) = 0, {CHECKED}, min(id) FILTER (id % 997 = 500)
FROM v WHERE id >= {Q.LEGACY}""")


def session_loss(name: str, lost: str) -> str:
    """What verification should say of a log that lost rows, from the ids alone."""
    return f"""
SELECT {quoted(name)} AS loss, bad = 0 AND short = 0 AS ok, checked, least(first_bad, first_short) AS first_bad_id,
  bad AS edited, short AS missing, 0::BIGINT AS unanchored, 0::BIGINT AS anchor
FROM (SELECT count(*) AS checked, count(*) FILTER (was IS DISTINCT FROM now) AS bad, min(id) FILTER (was IS DISTINCT FROM now) AS first_bad
  FROM (SELECT *, lag(id) OVER (PARTITION BY session ORDER BY id) AS now FROM h WHERE NOT coalesce({lost}, false))),
  (SELECT count(*) AS short, min(CASE WHEN left_id IS NULL THEN first_id ELSE last_id END) AS first_short FROM (
    SELECT session, min(id) AS first_id, max(id) AS last_id, max(id) FILTER (NOT coalesce({lost}, false)) AS left_id FROM h GROUP BY session)
  WHERE left_id IS DISTINCT FROM last_id)"""


CHAIN["chain_verify_sessions"] = f"""
WITH h AS (SELECT id, session_id, {SESSION} AS session, lag(id) OVER (PARTITION BY {SESSION} ORDER BY id) AS was FROM ({HOT}))
""" + " UNION ALL ".join(
    [session_loss(n, c.format(events="events").replace(" div ", " // ")) for n, c in Q.SESSION_LOSSES.items()]
    + [
        """
SELECT 'edited rows', count(*) FILTER (id % 997 = 500) = 0, count(*), min(id) FILTER (id % 997 = 500),
  count(*) FILTER (id % 997 = 500), 0, 0, 0 FROM h""",
        """
SELECT 'a forged anchor', count(begins) = 0, (SELECT count(*) FROM h), least(min(begins), min(own)), count(own), 0, 0, count(begins)
FROM (SELECT min(id) AS begins, max(id) FILTER (session = '5') AS own FROM h
  WHERE EXISTS (SELECT 1 FROM h WHERE session = '5') AND session >= '5' AND left(sha256(session), 2) = left(sha256('5'), 2)
  GROUP BY session)""",
    ]
)

CHAIN["stream_seal"] = CHAIN["chain_seal"]

# Governed stream

DEALT = f"(SELECT *, seq * {Q.BATCHES} // (SELECT count(*) FROM events) AS batch FROM ({view_sql('v_calls')}))"
STREAM = f"""
c_dealt AS (SELECT * EXCLUDE (batch), least({Q.BATCHES - 1}, batch + CASE WHEN seq % 17 = 3 THEN 1 ELSE 0 END) AS batch FROM {DEALT}),
c_arrived AS (SELECT *, row_number() OVER arrival AS nth, seq % 211 = 11 AS ends,
  max(seq) OVER (PARTITION BY session_id ORDER BY batch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > seq AS behind,
  cast(session_id AS bigint) % 7 <> 3 AND coalesce(max(CASE WHEN seq % 211 = 11 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY batch, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS is_open
  FROM c_dealt WINDOW arrival AS (PARTITION BY session_id ORDER BY batch, seq)),
{judging("c_arrived", Q.POLICIES, "nth")},
c_events AS (SELECT seq AS id, session_id, tool, agent, is_open, nth,
  CASE WHEN is_open AND allowed THEN 'allow' ELSE 'deny' END AS decision,
  CASE WHEN is_open THEN reason ELSE {quoted(TEXTS.not_open)} END AS reason,
  CASE WHEN is_open THEN session_id ELSE concat(session_id, '#', seq) END AS chain,
  CASE WHEN is_open THEN nth - 1 ELSE 0 END AS place, coalesce(is_open AND behind, false) AS late FROM judged),
c_rest AS (SELECT *, concat_ws('|', id, agent, tool, decision, reason, 0, session_id, 0) AS rest FROM c_events),
c_sealed AS (
  SELECT chain, id, place, '{GENESIS}' AS prev_hash, sha256(concat('{GENESIS}', '|', rest)) AS hash FROM c_rest WHERE place = 0
  UNION ALL
  SELECT r.chain, r.id, r.place, s.hash, sha256(concat(s.hash, '|', r.rest)) FROM c_sealed s JOIN c_rest r ON r.chain = s.chain AND r.place = s.place + 1)"""
GOVERNED_STREAM = {
    "stream_govern": f"""WITH RECURSIVE {STREAM.strip()}
SELECT e.id, session_id, tool, decision, reason, e.chain, e.place, late, prev_hash, hash FROM c_events e JOIN c_sealed s ON e.id = s.id""",
    # A chain that has lost rows: those whose place does not follow, and chains whose last place is lost.
    "stream_govern_verify": f"""WITH {STREAM.strip().split("c_sealed AS")[0].rstrip().rstrip(",")},
kept AS (SELECT *, lag(place) OVER (PARTITION BY chain ORDER BY place) AS prior FROM c_events WHERE id % 1000 < 900),
tails AS (SELECT count(*) FILTER (place <> coalesce(prior + 1, 0)) AS edited, count(*) AS checked FROM kept),
ends AS (SELECT count(*) AS missing FROM (SELECT chain, max(place) AS p, max(place) FILTER (id % 1000 < 900) AS q FROM c_events GROUP BY chain)
  WHERE p IS DISTINCT FROM q)
SELECT 'nothing' AS loss, true AS ok, count(*) AS checked, 0::BIGINT AS edited, 0::BIGINT AS missing, 0::BIGINT AS unanchored FROM c_events
UNION ALL SELECT 'tails', edited = 0 AND missing = 0, checked, edited, missing, 0 FROM tails, ends
UNION ALL SELECT 'edits', count(*) FILTER (id % 97 = 5) = 0, count(*), count(*) FILTER (id % 97 = 5), 0, 0 FROM c_events""",
    "stream_buckets": audit_sql(f"""
SELECT strftime(date_trunc('day', event_ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS events,
  count(*) FILTER (decision = 'allow') AS actions_allowed, count(*) FILTER (decision = 'deny') AS actions_denied,
  count(*) FILTER (decision = 'firewall') AS injections_blocked, count(*) FILTER (decision = 'egress') AS egress_sanitized,
  count(*) FILTER (decision = 'error') AS errors, cast(sum(pii_redacted) AS bigint) AS pii_redacted,
  cast(coalesce(sum(latency_ms) FILTER ({TIMED}), 0) AS bigint) AS latency_sum, count(*) FILTER ({TIMED}) AS timed,
  count(*) FILTER (event_ts < before - INTERVAL 1 HOUR) AS late
FROM (SELECT *, max(event_ts) OVER (ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT *, least({Q.BATCHES - 1}, id * {Q.BATCHES} // (SELECT count(*) FROM events) + CASE WHEN id % 17 = 3 THEN 1 ELSE 0 END) AS batch FROM v))
GROUP BY 1"""),
    # Up to the size of the test tables sessions are counted one by one.
    "kpi_incremental": audit_sql(f"SELECT {KPI_COLUMNS} FROM v"),
}

# Governed run

CUT = DEFAULT.trace_limit
LIMIT = DEFAULT.max_steps
FAILED = inside(
    TEXTS.tool_failed, f"coalesce(error, {inside(TEXTS.missing_document, 'c.path')})"
)
GOVERNED = f"""
WITH requests AS ({view_sql("v_requests")}),
steps AS ({view_sql("v_steps")}),
ends AS (SELECT session_id, min(step_no) AS end_step, arg_min(kind, step_no) AS ended,
  arg_min_null(text, step_no) AS text, arg_min(coalesce(error, ''), step_no) AS error
  FROM steps WHERE kind IN ('answer', 'llm_error') AND step_no < {LIMIT} GROUP BY session_id),
made AS (SELECT s.*, r.agent FROM steps s LEFT JOIN ends e ON e.session_id = s.session_id
  LEFT JOIN requests r ON r.session_id = s.session_id
  WHERE s.kind = 'tool_call' AND s.step_no < coalesce(e.end_step, {LIMIT})),
{judging("made", Q.POLICIES, "step_no, call_no")},
docs AS ({view_sql("v_governed_docs")}),
{scanning("docs")},
{masking("scanned")},
c_events AS (SELECT c.session_id, c.step_no, c.call_no, c.ts, c.tool,
  CASE WHEN NOT c.allowed THEN 'deny' WHEN c.error IS NOT NULL OR m.path IS NULL THEN 'error'
    WHEN NOT m.safe THEN 'firewall' ELSE 'allow' END AS decision,
  CASE WHEN NOT c.allowed THEN c.reason
    WHEN c.error IS NOT NULL OR m.path IS NULL THEN {FAILED}
    WHEN NOT m.safe THEN m.reason WHEN m.total > 0 THEN m.summary
    ELSE {quoted(TEXTS.ok)} END AS reason,
  CASE WHEN c.allowed THEN c.latency_ms ELSE 0 END AS latency_ms,
  CASE WHEN c.allowed AND c.error IS NULL AND m.safe THEN m.total ELSE 0 END AS pii_redacted,
  m.text AS shown
  FROM judged c LEFT JOIN masked m ON m.path = c.path AND c.allowed AND c.error IS NULL),
given AS (SELECT r.session_id, r.ts, r.text AS request, coalesce(e.end_step, {LIMIT}) AS end_step,
  coalesce(e.ended, 'max_steps') AS ended, e.error,
  CASE coalesce(e.ended, 'max_steps') WHEN 'llm_error' THEN {quoted(TEXTS.aborted_answer)}
    WHEN 'max_steps' THEN {quoted(TEXTS.stopped_answer)} ELSE coalesce(e.text, '') END AS text
  FROM requests r LEFT JOIN ends e ON e.session_id = r.session_id),
"""


def governed_sql(body: str) -> str:
    # The answers get their own masking stages, named apart from those of the documents.
    answers = sanitizing("given")
    for kind in KINDS:
        answers = answers.replace(f"m_{kind}", f"am_{kind}").replace(f"d_{kind}", f"ad_{kind}")
    return GOVERNED + answers + "\n" + body


EVENTS = f"""
SELECT session_id, step_no, call_no, 1 AS phase, ts, tool, decision, substr(reason, 1,
  CASE WHEN decision = 'error' THEN {CUT} ELSE length(reason) END) AS reason, latency_ms, pii_redacted
FROM c_events
UNION ALL SELECT session_id, -1, 0, 0, ts, 'user_request', 'trace', substr(request, 1, {CUT}), 0, 0
FROM sanitized
UNION ALL SELECT session_id, end_step, 0, 2, ts, 'llm_chat', 'error',
  substr({inside(TEXTS.model_failed, "error")}, 1, {CUT}), 0, 0 FROM sanitized WHERE ended = 'llm_error'
UNION ALL SELECT session_id, end_step, 0, 3, ts, 'final_answer', 'egress', egress_summary, 0,
  pii_redacted FROM sanitized WHERE NOT clean
UNION ALL SELECT session_id, end_step, 0, 4, ts, 'final_answer', 'trace', substr(text, 1, {CUT}), 0, 0
FROM sanitized"""
RUN = {
    "governed_run_events": governed_sql(EVENTS),
    "governed_transcript": governed_sql(f"""
SELECT session_id, step_no, call_no, 'tool' AS role, tool AS name,
  CASE decision WHEN 'deny' THEN {inside(TEXTS.blocked_message, "reason")}
    WHEN 'error' THEN {inside(TEXTS.error_message, "reason")}
    WHEN 'firewall' THEN {quoted(TEXTS.withheld)} ELSE shown END AS content
FROM c_events
UNION ALL SELECT session_id, -2, 0, 'system', NULL, {quoted(TEXTS.system_prompt)} FROM requests
UNION ALL SELECT session_id, -1, 0, 'user', NULL, text FROM requests"""),
    "governed_answers": governed_sql("SELECT session_id, ended, clean, text FROM sanitized"),
    "governed_kpis": governed_sql(f"SELECT {KPI_COLUMNS} FROM ({EVENTS})"),
    "governed_sealed": governed_sql(f"""
SELECT true AS ok, (SELECT count(*) FROM ({EVENTS})) AS checked,
  cast(NULL AS bigint) AS first_bad_id, cast(0 AS bigint) AS first_id,
  (SELECT count(*) - 1 FROM ({EVENTS})) AS last_id, {KPI_COLUMNS} FROM ({EVENTS})"""),
    "governed_log": governed_sql(f"""
SELECT row_number() OVER (ORDER BY substr(sha256(session_id), 1, 1) >= '8', session_id, step_no, call_no, phase) - 1 AS id,
  session_id, tool, decision, reason, latency_ms, pii_redacted FROM ({EVENTS})"""),
    "session_labels": """
SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN concat('s', conv_id) ELSE substr(sha256(conv_id::VARCHAR), 1, 8) END AS session_id
FROM conversations WHERE turn = 0""",
    "step_cap": governed_sql("SELECT ended, count(*) AS sessions FROM given GROUP BY ended"),
}

# Streams

STREAMS = {
    # Final buckets: the watermark, an hour behind the newest event, has passed their end.
    "stream_kpis": audit_sql(f"""
, days AS (SELECT date_trunc('day', event_ts) AS day, count(*) AS events,
  count(*) FILTER (decision = 'allow') AS allowed, count(*) FILTER (decision = 'deny') AS denied,
  count(*) FILTER (decision = 'firewall') AS firewall,
  count(*) FILTER (decision = 'egress') AS egress, count(*) FILTER (decision = 'error') AS errors,
  cast(sum(pii_redacted) AS bigint) AS pii_redacted,
  cast(sum(latency_ms) FILTER ({TIMED}) AS bigint) AS latency_sum,
  count(*) FILTER ({TIMED}) AS timed FROM v GROUP BY 1)
SELECT * EXCLUDE (day), strftime(day, '%Y-%m-%d %H:%M:%S') AS bucket FROM days
WHERE day + INTERVAL 1 DAY <= (SELECT max(event_ts) FROM v) - INTERVAL 1 HOUR"""),
}

SCANS["injection_rules_table"] = SCANS["injection_scan"]

ORACLES = {
    name: sql.strip()
    for part in (REPORTS, MASKING, EGRESS, SCANS, POLICY, CHAIN, GOVERNED_STREAM, RUN, STREAMS)
    for name, sql in part.items()
}
