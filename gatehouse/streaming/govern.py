"""Tool calls judged and sealed as they arrive, in one stateful job.

Sessions are dealt to buckets by a hash. A call of the handler takes all rows that a batch has for a bucket, and reads
and writes the bucket's sessions as one list: a call for each session would cost far more than its rows.

Each session has one entry: the calls it has made, the last place it has seen, and the head of its chain. Calls are
taken in the order of their arrival (batch by batch, by `seq` within one), so nothing is ever too
late to be judged or sealed; a call behind a later one is marked, no more.

State lives from the row that opens a session to the one that ends it, or until the session has been
idle for long. A session is only opened by its opening row. So a call of a session that has ended or expired is
refused, and dropping state never refills a quota.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gatehouse.functions.event_hash import GENESIS, HASHED_FIELDS, payload
from gatehouse.operators.authorize import check_calls, eligible, prepare, refusal
from gatehouse.schemas import AUDIT_EVENTS
from gatehouse.settings import DEFAULT, Settings

#: `calls` holds the number of allowed calls by agent, as JSON; `active` is a time in milliseconds.
STATE = "name string, calls string, last_seq bigint, place bigint, head string, active bigint"
#: Buckets of sessions. The entries of a bucket are written anew with each batch that has rows for it.
BUCKETS = 256
HOUR_MS = 3_600_000
NO_LIMIT = -1

EVENTS = T.StructType(
    [
        *AUDIT_EVENTS.fields,
        T.StructField("chain", T.StringType()),
        T.StructField("place", T.LongType()),
        T.StructField("late", T.BooleanType()),
    ]
)
_STATIC = ["ts", "agent", "tool", "latency_ms", "session_id", "pii_redacted"]
#: What the handler needs of a row, in the order in which it takes it apart. Spark renames columns that begin with `_`.
_READ = ["name", "session_id", "id", "no_id", "agent", "opens", "ends", "counts", "max_calls", "allowed", "within", "beyond", "first", "rest"]
#: The hashed fields in front of the two that the handler decides, and behind them.
_AT = HASHED_FIELDS.index("decision")
BEFORE, AFTER = HASHED_FIELDS[:_AT], HASHED_FIELDS[_AT + 2 :]


def governor(genesis: str, idle_ms: int, closed: str) -> StatefulProcessor:
    """The state handler. Nested, so that it travels to the workers by itself."""

    class Governor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.session = handle.getListState("session", STATE)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            import json
            from hashlib import sha256
            from itertools import groupby

            # A bucket's rows of one batch; the source bounds the size of a batch.
            got = pd.concat(list(rows), ignore_index=True).sort_values(["name", "no_id", "id"], ignore_index=True)
            now = timerValues.getCurrentProcessingTimeInMs()
            held = {name: entry for name, *entry in self.session.get()}
            empty, out = not held, []
            for name, own in groupby(zip(*(got[c].tolist() for c in read)), lambda r: r[0]):
                before = held.pop(name, None)
                calls, last, place, head, _ = before or ("{}", None, 0, genesis, 0)
                calls, is_open = json.loads(calls), before is not None
                for _, session, seq, no_id, agent, opens, ends, counts, limit, allowed, within, beyond, first, rest in own:
                    is_open = is_open or opens
                    if not is_open:
                        digest = sha256(f"{genesis}|{first}|deny|{closed}|{rest}".encode()).hexdigest()
                        label = "nan" if no_id else seq
                        out.append(("deny", closed, genesis, digest, f"{session}#{label}", 0, False))
                        continue
                    used = calls.get(agent or "", 0)
                    spent = 0 <= limit <= used
                    decision, reason = ("allow" if allowed and not spent else "deny"), (beyond if spent else within)
                    if counts and not spent and limit >= 0:
                        calls[agent or ""] = used + 1
                    previous, head = head, sha256(f"{head}|{first}|{decision}|{reason}|{rest}".encode()).hexdigest()
                    out.append((decision, reason, previous, head, name, place, not no_id and last is not None and seq <= last))
                    if not no_id:
                        last = seq if last is None else max(last, seq)
                    place += 1
                    if ends:
                        calls, last, place, head, is_open = {}, None, 0, genesis, False
                if is_open:
                    held[name] = (json.dumps(calls), last, place, head, now)
            if held:
                self.session.put([(name, *entry) for name, entry in held.items()])
                if empty:
                    self.handle.registerTimer(now + idle_ms)
            elif not empty:
                self.session.clear()
            added = pd.DataFrame(out, columns=["decision", "reason", "prev_hash", "hash", "chain", "place", "late"])
            ids = got["id"].astype("Int64").mask(got["no_id"])
            yield pd.concat([got[static], added], axis=1).assign(id=ids)[names]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            # A bucket's timer is never later than the end of any of its sessions. It was not moved at every
            # batch, so it may have to go on.
            until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs())
            held = list(self.session.get())
            kept = [entry for entry in held if entry[-1] + idle_ms > until]
            if kept:
                if len(kept) < len(held):
                    self.session.put(kept)
                self.handle.registerTimer(min(entry[-1] for entry in kept) + idle_ms)
            elif held:
                self.session.clear()
            yield pd.DataFrame(columns=names)

        def close(self) -> None:
            pass

    static, names, read = list(_STATIC), EVENTS.names, list(_READ)
    return Governor()


def govern_stream(
    calls: DataFrame,
    policy: DataFrame,
    idle_ms: int = 24 * HOUR_MS,
    strict: bool = True,
    settings: Settings = DEFAULT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Audit events of a stream of calls, sealed: one chain per session, in the order of arrival.

    `calls` has session_id, seq, ts, agent, tool, args, and two booleans: `opens` marks the row that
    opens its session, `ends` the last one. (session_id, seq) must be unique. The result adds `chain` (the session, or a
    chain of its own for a call without an open session), `place` (in the chain, from 0) and `late`.
    Of an idle session nothing is kept after `idle_ms`, and its next call is refused like one after the end.
    `buckets` is part of the state: a checkpoint goes on with the number it began with. More of them suit streams with
    millions of open sessions.

    Its query needs the RocksDB state store (`files.ROCKSDB`); `sealed_log.write_log` sets it.
    """
    texts = settings.messages
    checked = check_calls(calls, prepare(policy))
    within, beyond = (refusal(F.lit(spent), strict, settings) for spent in (False, True))
    session = F.coalesce("session_id", F.lit(""))
    rows = checked.select(
        F.pmod(F.xxhash64(session), F.lit(buckets)).alias("_bucket"),
        session.alias("name"),
        F.coalesce("seq", F.lit(0)).alias("id"),
        F.col("seq").isNull().alias("no_id"),
        "ts",
        "agent",
        "tool",
        F.lit(0).alias("latency_ms"),
        "session_id",
        F.lit(0).alias("pii_redacted"),
        F.coalesce("opens", F.lit(False)).alias("opens"),
        F.coalesce("ends", F.lit(False)).alias("ends"),
        eligible().alias("counts"),
        F.when(F.col("_max_calls").isNull(), NO_LIMIT).otherwise(F.greatest("_max_calls", F.lit(0))).alias("max_calls"),
        within.alias("refused"),
        F.coalesce(beyond, F.lit(texts.ok)).alias("beyond"),
    )
    rows = rows.withColumns(
        {"allowed": F.col("refused").isNull(), "within": F.coalesce("refused", F.lit(texts.ok)), "first": payload(BEFORE), "rest": payload(AFTER)}
    ).drop("refused")
    return rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=governor(GENESIS, idle_ms, texts.not_open), outputStructType=EVENTS, outputMode="Append", timeMode="ProcessingTime"
    )
