"""Joins whose strategy depends on a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest config table that is broadcast, by rows and by the bytes of its rows as JSON.
SMALL_ROWS, SMALL_BYTES = 10_000, 10_000_000


def row_bytes() -> Column:
    """The bytes of a row as JSON, a measure of its size that holds for any columns."""
    return F.octet_length(F.to_json(F.struct("*"))).cast("long")


def broadcast_if_small(table: DataFrame, rows: int, n_bytes: int) -> DataFrame:
    """Marks a config table for broadcast if it has few rows and few bytes.

    A larger one stays unmarked: the join then shuffles, and adaptive execution splits the
    keys that hold too many rows.
    """
    return F.broadcast(table) if rows <= SMALL_ROWS and n_bytes <= SMALL_BYTES else table


def same_keys(left: DataFrame, right: DataFrame, pairs: dict[str, str]):
    """Equality of key columns in which null equals null."""
    condition = F.lit(True)
    for mine, theirs in pairs.items():
        condition = condition & left[mine].eqNullSafe(right[theirs])
    return condition
