"""Authorisation of a stream of tool calls; the quota count is state per session.

Sessions are dealt to buckets by a hash, and the counts of a bucket are one state: a call of the handler takes
all rows that a batch has for a bucket, because a call for each session would cost far more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatehouse.operators.authorize import check_calls, eligible, prepare, refusal
from gatehouse.settings import DEFAULT, Settings

KEPT = "session_id string, seq bigint, ts string, agent string, tool string"
#: The sessions of a bucket, with the calls they have made and the last place they have seen.
STATE = "session array<string>, agent array<string>, calls array<int>, last_seq array<bigint>"
#: Buckets of sessions. The state of a bucket is written anew with each batch that has rows for it.
BUCKETS = 256
NO_LIMIT = -1


def quota_marker():
    """The state handler. Nested, so that it travels to the workers by itself."""

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        # A bucket's rows of one batch; the source bounds the size of a batch.
        rows = pd.concat(list(batches), ignore_index=True)
        if rows["seq"].isna().any():
            raise ValueError("a call has no seq")
        number = rows.groupby(["session_id", "agent"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((rows["seq"], number))
        rows, number = rows.iloc[order], number[order]
        seq, limit = rows["seq"].to_numpy(), rows["max_calls"].to_numpy()
        new = np.ones(len(rows), bool)
        new[1:] = number[1:] != number[:-1]
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(rows)) - 1
        # From here on sessions are counted in the order of their first row.
        own = np.cumsum(new) - 1
        known = {(s, a): (c, n) for s, a, c, n in zip(*state.get, strict=True)} if state.exists else {}
        names = [(s, a) for s, a in zip(*(rows[c].iloc[heads].astype(object).where(lambda v: v.notna(), None) for c in ("session_id", "agent")))]
        before = [known.get(name) for name in names]
        calls = np.array([b[0] if b else 0 for b in before], np.int64)
        last = np.array([b[1] if b else seq[h] for b, h in zip(before, heads)], np.int64)
        late = np.array([b is not None for b in before])[own] & (seq <= last[own])
        late[1:] |= ~new[1:] & (seq[1:] == seq[:-1])
        counted = rows["counts"].to_numpy(bool) & ~late
        so_far = np.cumsum(counted) - counted
        so_far -= so_far[heads][own]
        exhausted = (limit >= 0) & (calls[own] + so_far >= limit)
        total = (so_far + counted)[ends]
        free = np.where(limit[heads] < 0, total, np.maximum(limit[heads] - calls, 0))
        calls += np.minimum(total, free)
        last = np.maximum(last, seq[ends])
        known.update(zip(names, zip(calls.tolist(), last.tolist())))
        state.update(([s for s, _ in known], [a for _, a in known], [c for c, _ in known.values()], [n for _, n in known.values()]))
        yield rows.drop(columns=["_bucket", "max_calls", "counts"]).assign(exhausted=exhausted, late=late)

    return mark


def authorize_stream(
    calls: DataFrame, policy: DataFrame, strict: bool = True, settings: Settings = DEFAULT, buckets: int = BUCKETS
) -> DataFrame:
    """Adds `allowed` and `reason`, and `late` for calls that came after a later one.

    Calls of a session must arrive in the order of `seq` over batches. A late call is not
    judged: `allowed` and `reason` are null and the count is left alone. State is kept for
    good, because an idle session that lost it would get a fresh quota. `buckets` is part of the
    state: a checkpoint goes on with the number it began with. More of them suit streams with
    millions of sessions.
    """
    # Spark decides everything but the count, once for either state of the quota.
    narrow = check_calls(calls, prepare(policy)).select(
        "session_id",
        "seq",
        "ts",
        "agent",
        "tool",
        refusal(F.lit(False), strict, settings).alias("refusal"),
        refusal(F.lit(True), strict, settings).alias("refusal_exhausted"),
        # `greatest` passes over nulls, and null means no limit.
        F.when(F.col("_max_calls").isNull(), NO_LIMIT)
        .otherwise(F.greatest("_max_calls", F.lit(0)))
        .alias("max_calls"),
        eligible().alias("counts"),
    )
    bucket = F.pmod(F.xxhash64("session_id", "agent"), F.lit(buckets))
    marked = narrow.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        quota_marker(),
        f"{KEPT}, refusal string, refusal_exhausted string, exhausted boolean, late boolean",
        STATE,
        "append",
        GroupStateTimeout.NoTimeout,
    )
    final = F.when(F.col("exhausted"), F.col("refusal_exhausted")).otherwise(F.col("refusal"))
    return marked.select(
        "session_id",
        "seq",
        "ts",
        "agent",
        "tool",
        F.when(~F.col("late"), final.isNull()).alias("allowed"),
        F.when(~F.col("late"), F.coalesce(final, F.lit(settings.messages.ok))).alias("reason"),
        "late",
    )
