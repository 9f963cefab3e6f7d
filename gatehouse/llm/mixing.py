"""Mixing documents to target weights with soft membership in domains.

A classifier, learned from the labelled table, gives each document a posterior over domains, and
each document a rate, the number of times it should be used. The rates minimise

    1/2 * sum over domains k of (expected tokens of k - target of k)**2 / tokens of k

over rates >= 0, from rates of 1 by projected gradient steps. With tokens n, posterior p and
residuals e, a step in the natural metric is rate = max(0, rate - sum_k p_k * e_k / tokens_k);
its length is safe, as the posteriors sum to 1. So the rate of a document follows from its
posterior and the residuals of all steps so far: an iteration is one aggregation of a narrow
table, and only one number per domain moves to the driver and back.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm import linear
from gatehouse.llm import text_arrays as ta

#: Domains of the labelled table, and the condition on its labels.
DOMAINS = {"clean": "quality = 1 AND toxic = 0", "low_quality": "quality = 0 AND toxic = 0", "toxic": "toxic = 1"}
#: Steps at most, the error of the totals (as a share of all tokens) at which they stop, and the one worth a warning.
STEPS, CLOSE, FAR = 60, 1e-6, 1e-3

_SUMS = T.StructType([T.StructField("totals", T.ArrayType(T.DoubleType()))])


class Posterior:
    """Domain names, the chosen features, and weights of one model per domain."""

    def __init__(self, names: list[str], chosen: np.ndarray, weights: list[np.ndarray]):
        self.names, self.chosen, self.weights = names, chosen, weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        p = np.stack([linear.probability(x, w) for w in self.weights], axis=1)
        return p / p.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, id_col: str = "doc_id", text_col: str = "text") -> Posterior:
    """Learns the domains from a bounded sample of the labelled documents (see `linear.sample`)."""
    named = labels.select(id_col, *(F.expr(c).alias(n) for n, c in domains.items()))
    texts, truth, _ = linear.sample(docs, named, list(domains), id_col, text_col)
    chosen = linear.choose(texts, truth)
    x = linear.matrix(texts, chosen)
    return Posterior(list(domains), chosen, [linear.fit(x, y.astype(float)) for y in truth.T])


def membership_of(spark, text: Column, model: Posterior) -> Column:
    """Struct of tokens (words of the whole text) and posterior (array in the order of domains)."""
    shared = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def member(texts: pa.Array) -> pa.Array:
        own = shared.value
        k = len(own.names)
        tokens, posterior = np.zeros(len(texts), np.int64), np.zeros((len(texts), k))
        for a, b, x, n_words in linear.features(texts, own.chosen):
            tokens[a:b], posterior[a:b] = n_words, own(x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(texts) + 1, k), pa.int32()), pa.array(posterior.ravel()))
        return pa.StructArray.from_arrays([pa.array(tokens), lists], names=["tokens", "posterior"])

    @F.arrow_udf(kind)
    def judge(texts: pa.Array) -> pa.Array:
        return ta.trimmed_group(member)(texts)

    return judge(text)


def _posteriors(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().reshape(len(values), -1)


def _rates(posterior: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the projected steps, one row of residuals over tokens per step."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(0, rate - posterior @ step)
    return rate


def rates_column(posterior: Column, steps: np.ndarray) -> Column:
    """The rates of `_rates`, as a column: a task that has a Python worker for the posteriors needs no second one."""
    if not len(steps):
        return F.lit(1.0)
    moves = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in steps))

    def after(rate: Column, step: Column) -> Column:
        down = sum((F.element_at(posterior, k + 1) * F.element_at(step, k + 1) for k in range(steps.shape[1])), F.lit(0.0))
        return F.greatest(F.lit(0.0), rate - down)

    return F.aggregate(moves, F.lit(1.0), after)


def fit_rates(members: DataFrame, shares: list[float], budget: float | None = None, whole: int | None = None) -> np.ndarray:
    """The steps that lead to the rates, for `members` with tokens and posterior.

    Domain k is to hold shares[k] / sum(shares) of `budget` tokens (null: as many as there are).
    A domain to which no document belongs is left out of the sum.

    With `whole`, the number of a domain of which nothing is to be lost, the budget grows until that
    domain's target is at least what it holds, and no other domain is to hold more than it does.

    A fit that ends far from its targets, because no rates meet them, says so in a warning.
    """
    k = len(shares)

    def totals(steps: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                if batch.num_rows:
                    p = _posteriors(batch.column("posterior"))
                    total += (_rates(p, steps) * batch.column("tokens").to_numpy()) @ p
            yield pa.record_batch({"totals": pa.array([total.tolist()], pa.list_(pa.float64()))})

        parts = members.select("tokens", "posterior").mapInArrow(sums, _SUMS)
        row = parts.agg(*(F.sum(F.element_at("totals", j + 1)) for j in range(k))).first()
        return np.array([x or 0.0 for x in row])

    steps = np.zeros((0, k))
    there = totals(steps)
    target = targets(there, shares, budget, whole)
    now = there
    for _ in range(STEPS):
        gap = np.where(there > 0, now - target, 0.0)
        if np.abs(gap).max(initial=0) <= CLOSE * max(target.sum(), 1):
            return steps
        steps = np.vstack([steps, gap / np.maximum(there, 1e-300)])
        now = totals(steps)
    left = np.abs(np.where(there > 0, now - target, 0.0)).max(initial=0) / max(target.sum(), 1)
    if left > FAR:
        warnings.warn(f"after {STEPS} steps a domain is {left:.1%} of all tokens away from its target", stacklevel=2)
    return steps


def targets(there: np.ndarray, shares: list[float], budget: float | None, whole: int | None) -> np.ndarray:
    """Tokens that each domain is to hold, given those it has."""
    part = np.array(shares, float) / sum(shares)
    budget = there.sum() if budget is None else budget
    if whole is None:
        return part * budget
    found = np.minimum(part * max(budget, there[whole] / part[whole]), there)
    found[whole] = max(part[whole] * budget, there[whole])
    return found


def copies_of(rate: Column, *keys: str) -> Column:
    """How often a document is used: its rate, rounded up or down by a hash of `keys`.

    The hash is uniform, so a domain's expected tokens are those of its rates.
    """
    draw = F.pmod(F.xxhash64(*keys, F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
