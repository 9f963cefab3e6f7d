"""Linear text classifiers that are learned from a bounded sample of labelled documents.

Features are the words of a text and their beginnings (4 to 6 bytes), as counts, and a few
shares that describe its form. Words go by classes of their hash, a fixed number, so the table
from which the telling ones are chosen has the same size for any sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.llm import text_arrays as ta

#: Labelled documents of the sample, bytes of its longest text, and of all its texts.
LEARN_DOCS, LEARN_BYTES, LEARN_TOTAL = 6_000, 65_536, 24_000_000
#: Bits of a hash class: four million classes, so that few words of a sample share one.
CLASS_BITS = 22
#: Beginnings of words in bytes; 0 is the whole word.
BEGINNINGS = (4, 5, 6, 0)
#: Features chosen that speak for each label, and against it; least documents with one; least
#: chi-square.
CHOSEN_FOR, CHOSEN_AGAINST, LEAST_DOCS, LEAST_SCORE = 192, 32, 6, 10.0
_FORM = 5


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of all words and their beginnings, and the number of words of each text."""
    low = ta.lower_latin(data)
    starts, ends, first = ta.words(low, offsets, ta.PUNCTUATED)
    sums = ta.prefix_hash(low)
    text = ta.owner(first)
    found = []
    for k in BEGINNINGS:
        at = np.flatnonzero(ends - starts > k)
        found.append((text[at], ta.span_hash(sums, starts[at], starts[at] + k if k else ends[at]) + np.uint64(k)))
    texts, marks = (np.concatenate(x) for x in zip(*found, strict=True))
    return texts, marks, np.diff(first)


def _classes(marks: np.ndarray) -> np.ndarray:
    return (marks >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _form(data: np.ndarray, offsets: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Shares of capitals, symbols, digits and line ends, and the logarithm of the length."""

    def count(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    n = np.maximum(np.diff(offsets), 1)
    capitals = count((data >= 65) & (data <= 90))
    symbols = count(ta.PUNCTUATED[data] & (data > 32))
    digits = count((data >= 48) & (data <= 57))
    lines = count(data == 10)
    return np.stack([capitals / n, symbols / n, digits / n, lines / n, np.log1p(n_words) / 10], axis=1)


def features(column: pa.Array, chosen: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, features, number of words) piece by piece."""
    data, offsets, _ = ta.flat(column)
    for a, b in ta.pieces(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        text, marks, n_words = _marks(part, own)
        counts = np.zeros((b - a, len(chosen)))
        if len(chosen):
            classes = _classes(marks)
            at = np.minimum(np.searchsorted(chosen, classes), len(chosen) - 1)
            hit = chosen[at] == classes
            np.add.at(counts, (text[hit], at[hit]), 1)
        yield a, b, np.concatenate([np.log1p(counts), _form(part, own, n_words)], axis=1), n_words


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], id_col: str, text_col: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts, labels, folds) of at most LEARN_DOCS labelled documents and LEARN_TOTAL bytes, by a hash of the identifier.

    Rows with a null label or text, and texts above LEARN_BYTES bytes, are not used; of labels
    that contradict each other the larger counts. A text, or one that shares its rarest words
    with another, is learned from once, so groups of copies do not outweigh the rest.
    """
    known = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(c) for c in columns)).dropna()
    known = known.groupBy("id").agg(*(F.max(c).alias(c) for c in columns))
    short = F.octet_length(text_col).between(1, LEARN_BYTES)
    ids = docs.filter(short).groupBy(F.col(id_col).alias("id")).agg(F.max(F.octet_length(text_col)).alias("bytes")).join(known, "id")
    first = ids.orderBy(F.xxhash64("id"), "id").limit(LEARN_DOCS)
    # A window over LEARN_DOCS narrow rows at most.
    so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("id"), "id"))
    picked = first.withColumn("so_far", so_far).filter(F.col("so_far") <= LEARN_TOTAL).drop("bytes", "so_far")
    texts = docs.filter(short).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", *columns).agg(F.min("text").alias("text"))
    got = rows.select("text", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)).alias("fold"), F.xxhash64("id").alias("h"), *columns).toArrow()
    got = got.sort_by("h")
    column = got.column("text").combine_chunks()
    data, offsets, _ = ta.flat(column)
    seen, keep = set(), []
    for k in range(len(column)):
        _, marks, _ = _marks(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
        key = tuple(np.unique(marks)[:4].tolist())
        if key not in seen:
            seen.add(key)
            keep.append(k)
    got = got.take(pa.array(keep, pa.int64()))
    values = np.stack([got.column(c).to_numpy() for c in columns], axis=1) if keep else np.zeros((0, len(columns)), int)
    return got.column("text").combine_chunks(), values, got.column("fold").to_numpy()


def choose(column: pa.Array, labels: np.ndarray) -> np.ndarray:
    """The classes of words that tell any of the labels most surely, sorted.

    Texts are counted piece by piece into one table of all classes: the texts with a class, and those
    of each label.
    """
    data, offsets, _ = ta.flat(column)
    total = np.zeros(1 << CLASS_BITS, np.int32)
    marked = np.zeros((labels.shape[1], 1 << CLASS_BITS), np.int32)
    for a, b in ta.pieces(offsets):
        text, marks, _ = _marks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        pairs = np.unique((text.astype(np.int64) << CLASS_BITS) | _classes(marks))
        text, classes = (pairs >> CLASS_BITS) + a, pairs & ((1 << CLASS_BITS) - 1)
        np.add.at(total, classes, 1)
        for k, label in enumerate(labels.T):
            np.add.at(marked[k], classes[label[text] > 0], 1)
    names = np.flatnonzero(total >= LEAST_DOCS)
    total, n, best = total[names].astype(float), len(labels), [np.zeros(0, np.int64)]
    for k, ones in enumerate(labels.sum(axis=0).tolist()):
        yes = marked[k, names].astype(float)
        no = total - yes
        rows = np.maximum(total * (n - total) * ones * (n - ones), 1)
        cross = yes * (n - ones - no) - no * (ones - yes)
        score = n * cross * np.abs(cross) / rows
        for signed, most in ((score, CHOSEN_FOR), (-score, CHOSEN_AGAINST)):
            top = np.argsort(-signed, kind="stable")[:most]
            best.append(names[top[signed[top] >= LEAST_SCORE]])
    return np.unique(np.concatenate(best))


def matrix(column: pa.Array, chosen: np.ndarray) -> np.ndarray:
    parts = [x for _, _, x, _ in features(column, chosen)]
    return np.concatenate(parts) if parts else np.zeros((0, len(chosen) + _FORM))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton steps from `start`."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weights = np.zeros(x.shape[1]) if start is None else start.copy()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + penalty * weights
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-4:
            break
    return weights


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
