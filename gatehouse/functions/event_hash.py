"""Hash of an audit event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the first event of a chain points to, the hashed fields in order, and
# the text that stands for a missing value.
GENESIS = "0" * 64
HASHED_FIELDS = (
    "ts",
    "agent",
    "tool",
    "decision",
    "reason",
    "latency_ms",
    "session_id",
    "pii_redacted",
)
MISSING = "None"


def payload(names: tuple[str, ...] = HASHED_FIELDS) -> Column:
    """Everything that is hashed after the previous hash, or some of its fields in a row."""
    # concat_ws would drop nulls, so each field gets its text first.
    fields = [F.coalesce(F.col(name).cast("string"), F.lit(MISSING)) for name in names]
    return F.concat_ws("|", *fields)


def event_hash(previous: Column, rest: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), rest), 256)
