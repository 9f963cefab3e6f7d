"""Toxicity by a chain of classifiers.

Categories are predicted one after the other; each linear model sees the features of the text
and the probabilities that the models before it gave. A later model is trained with
probabilities that come from models which had not seen the document (five folds), so it learns
how far they can be trusted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm import linear

#: A chain: each category and the condition on the labels that defines it.
CATEGORIES = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
    "toxic_low_quality": "toxic = 1 AND quality = 0",
}


class Chain:
    """Categories in order, the chosen features, and the weights of each category's model."""

    def __init__(self, names: list[str], chosen: np.ndarray, weights: list[np.ndarray]):
        self.names, self.chosen, self.weights = names, chosen, weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for weights in self.weights:
            x = np.concatenate([x, linear.probability(x, weights)[:, None]], axis=1)
        return x[:, x.shape[1] - len(self.weights) :]


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Learns the chain from a bounded sample of the labelled documents (see `linear.sample`).

    A category that the sample does not hold, or holds only, is predicted by its constant share.
    """
    named = labels.select(id_col, *(F.expr(c).alias(n) for n, c in categories.items()))
    texts, truth, folds = linear.sample(docs, named, list(categories), id_col, text_col)
    chosen = linear.choose(texts, truth)
    x, weights = linear.matrix(texts, chosen), []
    for k in range(len(categories)):
        y = truth[:, k].astype(float)
        weights.append(linear.fit(x, y))
        unseen = np.zeros(len(y))
        for fold in range(5):
            out = folds == fold
            unseen[out] = linear.probability(x[out], linear.fit(x[~out], y[~out], start=weights[-1]))
        x = np.concatenate([x, unseen[:, None]], axis=1)
    return Chain(list(categories), chosen, weights)


def toxicity_of(spark, text: Column, chain: Chain) -> Column:
    """Struct with a probability for each category, by whole text.

    A null or empty text has no sign of anything: all its probabilities are 0. Nothing but the
    text is looked at.
    """
    shared = spark.sparkContext.broadcast(chain)
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in chain.names])

    @F.arrow_udf(kind)
    def judge(texts: pa.Array) -> pa.Array:
        model = shared.value
        out = np.zeros((len(texts), len(model.names)))
        for a, b, x, n_words in linear.features(texts, model.chosen):
            out[a:b] = np.where(n_words[:, None] > 0, model.probabilities(x), 0.0)
        return pa.StructArray.from_arrays([pa.array(c) for c in out.T], names=model.names)

    return judge(text)
