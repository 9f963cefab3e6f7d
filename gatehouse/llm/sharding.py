"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows get dense global numbers in the order of (identifier, size, checksum). A Feistel network
permutes the numbers 0 to n - 1; where it leaves that range it is applied again until it is
back (cycle walking). Place p of the shuffle is slot p // shards of shard p % shards, so counts
differ by one at most, and shard and slot of any row can be computed from its number, the
number of rows and the seed alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Modulus and multipliers of the rounds: products stay below 2**62.
PRIME = 2_147_483_647
#: Rows that are numbered in one task, and the least number of such ranges.
RANGE_ROWS, RANGES = 500_000, 64


def round_keys(seed: int, rounds: int = 6) -> list[tuple[int, int]]:
    """Multiplier and summand of each round, from the seed."""
    state, keys = seed % PRIME, []
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            state = (state * 48_271 + 11) % PRIME
            pair.append(state % (PRIME - 1) + 1)
        keys.append(tuple(pair))
    return keys


def half_bits(n: int) -> int:
    """Bits of each half of the network that covers n numbers."""
    return max((max(n - 1, 1).bit_length() + 1) // 2, 1)


def permuted(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of some numbers below n in the shuffle of 0 to n - 1."""
    bits = half_bits(n)
    low = (1 << bits) - 1
    out = np.array(numbers, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & low
        for factor, summand in round_keys(seed):
            # The low digits of a product follow those of its factors, so higher ones are taken.
            left, right = right, left ^ (((right + summand) % PRIME * factor % PRIME) >> 7 & low)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= n]
    return out


def row_numbers(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows with dense numbers from 0 in the order of `keys`, nulls first, and their count.

    `keys` are all columns; equal rows are interchangeable and are counted before they are
    sorted. Ranges of the first key are numbered in parallel: a range holds about RANGE_ROWS
    rows, and only the limits and counts of ranges reach the driver.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    total = rows.count()
    ranges = max(RANGES, total // RANGE_ROWS)
    shares = [k / ranges for k in range(1, ranges)]
    limits = rows.agg(F.percentile_approx(keys[0], shares, max(10_000, 10 * ranges)).alias("x")).first()["x"] or []
    limits = np.unique(np.array(limits, np.int64))

    @F.arrow_udf("int")
    def range_of(value: pa.Array) -> pa.Array:
        at = np.searchsorted(limits, value.fill_null(0).to_numpy(), "left") + 1
        return pa.array(np.where(value.is_null().to_numpy(zero_copy_only=False), 0, at).astype(np.int32))

    placed = counted.withColumn("range", range_of(F.col(keys[0])))
    sizes = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.sum("times").alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(len(limits) + 2)])]).tolist()
    start = F.element_at(F.lit(before[:-1]), F.col("range") + 1) if total else F.lit(0)
    running = F.sum("times").over(Window.partitionBy("range").orderBy(*keys))
    numbered = placed.withColumn("first", start + running - F.col("times"))
    return numbered.select(*keys, F.explode(F.sequence("first", F.col("first") + F.col("times") - 1)).alias("row")), total


def shuffled_shards(docs: DataFrame, shards: int = 24, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row (the global number).

    size is the UTF-8 bytes of the text (null: none) plus 8, text_crc32 the unsigned checksum of
    the text (null: of nothing, 0). The law is `rows`: counts of shards differ by one at most;
    grown_shard is null, as with one more shard the permutation deals all rows anew. Slots are
    gapless from 0 in each shard.

    Rows without identifier are numbered first. Rows that are equal in doc_id, size and checksum
    are dealt one by one, and it does not matter which is which. Other columns are not looked
    at. An empty table gives an empty result.
    """
    text: Column = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered, total = row_numbers(rows, ["doc_id", "size", "text_crc32"])

    @F.arrow_udf("long")
    def place(row: pa.Array) -> pa.Array:
        return pa.array(permuted(row.to_numpy(), total, seed))

    return numbered.withColumn("place", place("row")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )
