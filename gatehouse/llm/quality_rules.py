"""Quality rules as a ledger of bit masks.

`ledger` evaluates every rule once per document and stores the measurements together with one
bit per rule that the document fails. Policies are versioned masks: a document is kept if it
fails none of the rules its policy enforces, so another policy, or leaving one rule out
(`ablation`), needs no second look at a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm import text_arrays as ta

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: The rules, each as the condition under which a document fails; the order gives the bits.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_or_long_words": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
}


@dataclass(frozen=True)
class Policy:
    """A version and the rules it enforces."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
CURRENT = Policy("2024-06", tuple(RULES))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_RESULT = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])


def _earlier_equal(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry whether an equal one of its text stands before it, and whether any is equal."""
    order = np.lexsort((np.arange(len(keys)), keys, text))
    same = np.zeros(len(keys) + 1, bool)
    a, b = order[:-1], order[1:]
    same[1:-1] = (text[a] == text[b]) & (keys[a] == keys[b])
    earlier, any_equal = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order], any_equal[order] = same[:-1], same[:-1] | same[1:]
    return earlier, any_equal


def _measured(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = ta.words(data, offsets)
    n_words, sums = np.diff(first), ta.prefix_hash(data)
    in_words = np.zeros(len(data) + 1, np.int8)
    in_words[starts] += 1
    in_words[ends] -= 1
    in_words = np.cumsum(in_words)[:-1] > 0
    # A word that begins where another ends, at the border of two texts, is inside too.
    chars = _per_text(in_words & ((data & 0xC0) != 0x80), offsets)

    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 10
    cut[offsets] = True
    line_start = np.flatnonzero(cut[:-1])
    line_end = np.append(line_start[1:], len(data))
    text = np.searchsorted(offsets, line_start, "right") - 1
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, text = line_start[has_word], line_end[has_word], text[has_word]
    line_end = line_end - (data[line_end - 1] == 10)
    repeated, _ = _earlier_equal(text, ta.span_hash(sums, line_start, line_end))
    n = len(offsets) - 1

    word_text = ta.owner(first)
    keys = ta.windows(ta.span_hash(sums, starts, ends), 3)
    inside = word_text[: len(keys)] == word_text[2:] if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    _, twice = _earlier_equal(word_text[at], keys[at])
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return [
        n_words,
        chars,
        _per_text(_SYMBOL[data], offsets),
        np.bincount(text, minlength=n),
        np.bincount(text[repeated], minlength=n),
        _per_text(covered, first),
    ]


@F.arrow_udf(_RESULT)
def measures_of(texts: pa.Array) -> pa.Array:
    """The measurements of whole texts; all 0 for a null text."""
    data, offsets, _ = ta.flat(texts)
    parts = [_measured(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in ta.pieces(offsets)]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(MEASURES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, all measurements, and failed: bit k is set if rule k of RULES fails.

    One row per input row, whatever its identifier. A null or empty text has no words and fails
    `few_words`. Other columns of the input are not carried. An empty table gives an empty one.
    """
    measured = docs.select(F.col(id_col).alias("doc_id"), measures_of(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(0) for k, rule in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("failed", bits.cast("long"))


def passes(policy: Policy) -> Column:
    """Whether a row of the ledger is kept under a policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """(version, rule, n_failed, n_only): documents that fail a rule, and those that only it removes.

    One aggregation of the ledger. `n_only` is what would be kept if the rule were left out.
    """
    enforced = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = []
    for rule in policy.rules:
        bit = 1 << list(RULES).index(rule)
        fails = F.col("failed").bitwiseAND(F.lit(bit)) != 0
        sums.append(F.count_if(fails).alias(f"{rule}_failed"))
        sums.append(F.count_if(enforced == bit).alias(f"{rule}_only"))
    one = rows.agg(*sums)
    entries = [
        F.struct(F.lit(policy.version).alias("version"), F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("n_failed"), F.col(f"{r}_only").alias("n_only"))
        for r in policy.rules
    ]
    return one.select(F.inline(F.array(*entries)))
