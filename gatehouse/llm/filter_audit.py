"""How filters interact: every order in which they could be applied, for every part of a corpus.

A document is described by its mask, the set of filters it fails. An order of the filters removes
it at the first filter of the mask. Orders are numbered by their rank, the place in the
lexicographic list of all permutations (their Lehmer code): all orders that begin alike have
consecutive ranks. So the orders in which a mask is removed at step s are a few intervals of
ranks, one for each beginning of s - 1 filters outside the mask and one inside. The counts of a mask
are added at the first rank of each interval and taken away behind its last; running sums along
the ranks then give the documents removed at each step of every order.

Documents are measured once and counted per part and mask; what follows sees at most one row per
part and mask, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters whose outcome follows from the text, each as the condition under which it fails. `repeats` is set
#: for a text that a smaller identifier has too.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "has_symbol",
    "E": "repeats",
}
#: Characters that part words, and the symbols that filter D looks for.
SPACES, SYMBOLS = " \t\n\x0b\f\r", "[#$%&*|]"

COUNTS = ("n", "good", "toxic")
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


def removal_intervals(filters: int) -> np.ndarray:
    """Rows (mask, step, first, end): at ranks first <= r < end a document of this mask goes at this step.

    Bit k of a mask stands for filter k; steps count from 0.
    """
    found = []

    def extend(outside: int, rest: list[int], step: int, start: int) -> None:
        width = factorial(len(rest) - 1)
        for place, letter in enumerate(rest):
            first, others = start + place * width, [x for x in rest if x != letter]
            for chosen in range(1 << len(others)):
                mask = 1 << letter | sum(1 << x for k, x in enumerate(others) if chosen >> k & 1)
                found.append((mask, step, first, first + width))
            if others:
                extend(outside | 1 << letter, others, step + 1, first)

    extend(0, list(range(filters)), 0, 0)
    return np.array(found, np.int64).reshape(-1, 4)


def audited(counts: np.ndarray, intervals: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Arrays (rank, step) of the results for one part; `counts` has a row of COUNTS for every mask."""
    ranks = factorial(filters)
    mask, step, first, end = intervals.T
    ends = np.zeros((filters, ranks + 1, counts.shape[1]), np.int64)
    np.add.at(ends, (step, first), counts[mask])
    np.subtract.at(ends, (step, end), counts[mask])
    removed = ends.cumsum(axis=1)[:, :ranks].transpose(1, 0, 2)
    letters = np.array(list(permutations(range(filters))))
    bits = np.arange(len(counts))[:, None] >> np.arange(filters) & 1
    fails, alone = bits.T @ counts[:, 0], counts[1 << np.arange(filters), 0]
    shapley = np.bincount(letters.ravel(), weights=removed[:, :, 0].ravel(), minlength=filters).astype(np.int64)
    return {
        "kept": counts[:, 0].sum() - removed[:, :, 0].cumsum(axis=1),
        "removed": removed[:, :, 0],
        "redundant": fails[letters] - removed[:, :, 0],
        "unique_fails": alone[letters],
        "good_lost": removed[:, :, 1],
        "toxic_lost": removed[:, :, 2],
        "shapley": shapley[letters],
    }


def _audit(names: str):
    """Batches of parts, each with its counts per mask, to their rows in all orders."""
    filters = len(names)
    intervals = removal_intervals(filters)
    orders = ["".join(names[k] for k in p) for p in permutations(range(filters))]
    order = pa.array(np.repeat(orders, filters))
    step = pa.array(np.tile(np.arange(1, filters + 1, dtype=np.int32), len(orders)))

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column("part"), batch.column("masks").to_pylist(), strict=True):
                counts = np.zeros((1 << filters, len(COUNTS)), np.int64)
                for m in masks:
                    counts[m["mask"]] += [m[c] for c in COUNTS]
                found = audited(counts, intervals, filters)
                columns = {"part": pa.array([part.as_py()] * len(order), pa.string()), "filter_order": order, "step": step}
                yield pa.record_batch(columns | {k: pa.array(v.ravel()) for k, v in found.items()})

    return audit


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, doc_id, digest and the measurements of each text; the text itself goes no further."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    words = F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), "")
    return texts.withColumn("words", words).select(
        "part",
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.col("text").rlike(SYMBOLS).alias("has_symbol"),
    )


def _bit(name: str) -> Column:
    return F.when(F.expr(FILTERS[name]), 1 << list(FILTERS).index(name)).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail just the filters of the mask."""
    by_text = sum((_bit(f) for f in FILTERS if f != "E"), F.lit(0))
    # Rows that are equal in all that matters are counted before anything else moves, so neither a
    # repeated row nor a repeated identifier makes a hot group below.
    rows = measured(docs, id_col, text_col, part_col).select("part", "doc_id", "digest", by_text.alias("bits"))
    rows = rows.groupBy("doc_id", "digest", "part", "bits").agg(F.count(F.lit(1)).alias("n"))
    smallest = rows.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # A row without identifier has no smaller one, so E never removes it.
    rows = rows.join(smallest.withColumn("is_first", F.lit(True)), ["digest", "doc_id"], "left")
    rows = rows.withColumn("repeats", F.col("is_first").isNull() & F.col("doc_id").isNotNull())
    known = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .filter("doc_id IS NOT NULL AND (good OR toxic)")
        .groupBy("doc_id")
        .agg(F.max("good").alias("is_good"), F.max("toxic").alias("is_toxic"))
    )
    rows = rows.join(known, "doc_id", "left")
    return rows.groupBy("part", (F.col("bits") + _bit("E")).alias("mask")).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("is_good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("is_toxic"), F.col("n"))), F.lit(0)).alias("toxic"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps, removes and costs.

    A null text counts as empty, a null part as the empty string. Filter E looks at the whole
    table: a text fails if a smaller identifier has the same one. Rows with one identifier and
    one text do not remove each other; a row without identifier removes nothing, is never
    removed by E and has no label. Of several labels of a document any that says so counts. Texts
    are compared by sha256. An empty table has no parts and gives no rows; zeros are written for
    whatever does not occur in a part. Other columns are not looked at, whatever their names.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    # At most 32 masks in a part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))
    return parts.mapInArrow(_audit("".join(FILTERS)), RESULT)
