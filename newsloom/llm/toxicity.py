"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Unseen misspellings share character n-grams with seen words, and so their vectors. The model is
fitted on a bounded sample of labelled documents (``sample`` per class at most, by a hash of the
id); scoring is one pass over whole texts with a table of fixed size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.language import sample_features
from newsloom.llm.subwords import Grams, Model, logits, raw_logits, train

GRAMS = Grams(orders=(3, 4, 5, 6), bits=17, letters_only=False, pad=100)
SAMPLE = 1500


class Detector(NamedTuple):
    """The model, and the score of every text when there was nothing to learn from."""

    model: Model | None
    constant: float


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    sample: int = SAMPLE,
    grams: Grams = GRAMS,
) -> Detector:
    """A detector fitted on at most ``sample`` documents of either label.

    A document labelled twice counts as toxic if any label says so. Labels without a document,
    documents without text and null labels teach nothing. If only one label occurs, every text gets
    that label's share (0 without labels) as its score. One document in five of the sample is set
    aside: the bias is moved to where it separates those best, weighed by how often either label
    occurs among all labels.
    """
    marked = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("doc_id"))
        .agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    )
    shares = {row.toxic: row["count"] for row in marked.groupBy("toxic").count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return Detector(None, float(shares.get(1, 0) > 0))
    order = F.xxhash64("doc_id", F.lit(6))
    ids = [marked.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    # At most 2 * sample rows: small enough to send to every task, so texts stay in place.
    chosen = F.broadcast(ids[0].union(ids[1]))
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    # Of texts with the same id one is learned from: a repeated id cannot exceed the sample.
    sampled = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    features, found = sample_features(sampled, "text", "toxic", grams)
    classes = np.array(found, dtype=np.int64)
    if len(set(found)) < 2:
        return Detector(None, shares.get(1, 0) / total)
    aside = np.arange(len(classes)) % 5 == 4
    fitted = train(
        [f for f, a in zip(features, aside, strict=True) if not a], classes[~aside], 2, grams,
        dim=4, epochs=6, rate=0.5,
    )
    # Two classes: the difference of their scores is all that matters.
    table = (fitted.table[:, 1] - fitted.table[:, 0])[:, None]
    bias = float(fitted.bias[1] - fitted.bias[0])
    two_sided = raw_logits([f for f, a in zip(features, aside, strict=True) if a], fitted)
    raw = two_sided[:, 1] - two_sided[:, 0]
    true = classes[aside] == 1
    if true.any() and not true.all():
        weight = np.where(true, shares[1] / true.sum(), shares[0] / (~true).sum())
        order = np.argsort(raw)
        ends = [raw[order[0]] - 1], [max(raw[order[-1]], bias) + 1]
        cuts = np.concatenate([ends[0], (raw[order][1:] + raw[order][:-1]) / 2, ends[1]])
        below = np.concatenate([[0], np.cumsum(np.where(true, weight, -weight)[order])])
        # A text without any n-gram has the bias alone, and is not toxic.
        below = np.where(cuts > bias + 1e-3, below, np.inf)
        best = np.flatnonzero(below <= below.min() + 1e-9)
        bias -= (cuts[best[0]] + cuts[best[-1]]) / 2
    return Detector(Model(table, np.array([bias]), 1.0, grams), 0.0)


def toxicity(text: Column, found: Detector) -> Column:
    """Score from 0 to 1; 0.5 and above means toxic. Null and empty texts get the bias alone, below 0.5."""
    model, constant = found
    if model is None:
        return F.lit(constant)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(logits(texts, model)[:, 0], -500, 500))), pa.float64())

    return score(F.coalesce(text, F.lit("")))


def keep_clean(docs: DataFrame, found: Detector, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows that score below ``limit``, columns as they were."""
    return docs.filter(toxicity(F.col(text), found) < limit)
