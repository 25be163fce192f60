"""Averaged hashed subword embeddings under a linear softmax, trained by gradient descent in numpy.

Every character n-gram within a word (its ends marked by a space) has a vector, found by hashing.
A text is the mean of its n-grams' vectors; a linear softmax turns it into class probabilities.
Vectors and softmax are trained jointly. As the mean is linear, a trained model comes down to one
score per n-gram bucket and class: a table of fixed size, which travels with the scoring function.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from newsloom.llm.texts import _powers, blocks

_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Grams(NamedTuple):
    """Which n-grams count (in bytes), the number of hash bits, and which characters end a word.

    ``pad`` zero vectors join every mean, so that a few n-grams alone are weak evidence.
    """

    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 16
    letters_only: bool = True
    pad: int = 0


class Model(NamedTuple):
    """Score per bucket and class, bias and scale of the logits."""

    table: np.ndarray
    bias: np.ndarray
    scale: float
    grams: Grams


def _folding(grams: Grams) -> np.ndarray:
    """Byte to byte: lower case; what ends a word becomes a space."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    ends = [c for c in range(128) if not chr(c).isalpha()] if grams.letters_only else [
        *range(33), 127, *map(ord, "\"(),.:;?[]{}")
    ]
    fold[ends] = 32
    return fold


def _joined(data: np.ndarray, offsets: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts with a space before each and at the end, and the text of every byte."""
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts, dtype=np.int32), np.diff(offsets) + 1)
    owner = np.append(owner, np.int32(max(texts - 1, 0)))
    out = np.full(len(data) + texts + 1, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[:-1] + np.arange(texts)] = False
    keep[-1] = False
    folded = _folding(grams)[data]
    # Latin capital letters with marks: the second byte of two is 32 lower than the small letter's.
    if len(folded) > 1:
        second = np.zeros(len(folded), bool)
        second[1:] = (folded[:-1] == 0xC3) & (folded[1:] >= 0x80) & (folded[1:] <= 0x9E) & (folded[1:] != 0x97)
        folded = folded + (second.view(np.uint8) << 5)
    out[keep] = folded
    return out, owner


def gram_buckets(data: np.ndarray, offsets: np.ndarray, grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of every n-gram and the text it stands in."""
    joined, owner = _joined(data, offsets, grams)
    up, down = _powers(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=total[1:])
    space = joined == 32
    spaces = np.zeros(len(joined) + 1, np.int32)
    np.cumsum(space, out=spaces[1:])
    for order in grams.orders:
        last = len(joined) - order + 1
        if last <= 0:
            continue
        whole = spaces[order - 1 : order - 1 + last] == spaces[1 : last + 1]
        if order == 2:
            whole = ~(space[:last] & space[1 : last + 1])
        at = np.flatnonzero(whole)
        hashed = (total[at + order] - total[at]) * down[at] + np.uint64(order)
        hashed ^= hashed >> np.uint64(32)
        yield ((hashed * _SPREAD) >> np.uint64(64 - grams.bits)).astype(np.int64), owner[at]


def text_features(texts: pa.Array, grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their counts, at most 65,535 each."""
    for _, data, offsets in blocks(texts):
        rows = len(offsets) - 1
        found = list(gram_buckets(data, offsets, grams))
        buckets = np.concatenate([b for b, _ in found]) if found else np.zeros(0, np.int64)
        owners = np.concatenate([o for _, o in found]) if found else np.zeros(0, np.int32)
        keys, counts = np.unique((owners.astype(np.int64) << grams.bits) | buckets, return_counts=True)
        edges = np.searchsorted(keys, np.arange(rows + 1, dtype=np.int64) << grams.bits)
        for row in range(rows):
            part = slice(edges[row], edges[row + 1])
            few = np.minimum(counts[part], 65_535).astype(np.uint16)
            yield (keys[part] & ((1 << grams.bits) - 1)).astype(np.int32), few


def shares(counts: np.ndarray, grams: Grams) -> np.ndarray:
    """Weight of each bucket in a text's mean."""
    return (counts / max(1, int(counts.sum(dtype=np.int64)) + grams.pad)).astype(np.float32)


def raw_logits(features: list[tuple[np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    """Logits of texts from their features, before any scale."""
    rows = [
        (model.table[ids] * shares(counts, model.grams)[:, None]).sum(0) if len(ids) else np.zeros(len(model.bias))
        for ids, counts in features
    ]
    return np.array(rows).reshape(-1, len(model.bias)) + model.bias


def logits_sizes(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scaled logits of every text, and its number of n-grams; a text without any has the bias alone."""
    out, sizes = np.zeros((len(texts), len(model.bias))), np.zeros(len(texts))
    for first, data, offsets in blocks(texts):
        rows = len(offsets) - 1
        sums = np.zeros((rows, len(model.bias)))
        seen = np.zeros(rows)
        for buckets, owners in gram_buckets(data, offsets, model.grams):
            for c in range(len(model.bias)):
                sums[:, c] += np.bincount(owners, model.table[:, c][buckets], rows)
            seen += np.bincount(owners, minlength=rows)
        out[first : first + rows] = sums / np.maximum(seen + model.grams.pad, 1)[:, None]
        sizes[first : first + rows] = seen
    return (out + model.bias) * model.scale, sizes


def logits(texts: pa.Array, model: Model) -> np.ndarray:
    """Scaled logits of every text; a text without n-grams has the bias alone."""
    return logits_sizes(texts, model)[0]


def softmax(values: np.ndarray) -> np.ndarray:
    shifted = np.exp(values - values.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def train(
    features: list[tuple[np.ndarray, np.ndarray]],
    classes: np.ndarray,
    n_classes: int,
    grams: Grams,
    dim: int = 8,
    epochs: int = 12,
    batch: int = 64,
    rate: float = 0.3,
    least_steps: int = 600,
    seed: int = 7,
) -> Model:
    """Vectors and softmax by stochastic gradient descent, each step scaled by its past gradients.

    A small sample is gone through more than ``epochs`` times, for ``least_steps`` steps in all.
    """
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (1 << grams.bits, dim)).astype(np.float32)
    weights = random.normal(0, 0.3, (dim, n_classes)).astype(np.float32)
    bias = np.zeros(n_classes, np.float32)
    past = [np.full(x.shape, 1e-8, np.float32) for x in (vectors, weights, bias)]
    targets = np.eye(n_classes, dtype=np.float32)[classes]
    # Texts without n-grams teach nothing about vectors.
    usable = np.array([i for i, (ids, _) in enumerate(features) if len(ids)], dtype=np.int64)
    epochs = max(epochs, -(-least_steps * batch // max(batch, len(usable))))
    for epoch in range(epochs):
        order = random.permutation(usable)
        step = rate * (1 - epoch / epochs) + 0.01
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = np.array([len(features[r][0]) for r in rows])
            ids = np.concatenate([features[r][0] for r in rows])
            share = np.concatenate([shares(features[r][1], grams) for r in rows])
            firsts = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(vectors[ids] * share[:, None], firsts, axis=0)
            error = (softmax(hidden @ weights + bias) - targets[rows]).astype(np.float32) / len(rows)
            back = np.repeat(error @ weights.T, sizes, axis=0) * share[:, None]
            touched, inverse = np.unique(ids, return_inverse=True)
            moved = np.stack(
                [np.bincount(inverse, back[:, d], len(touched)) for d in range(dim)], axis=1
            ).astype(np.float32)
            past[0][touched] += moved**2
            vectors[touched] -= step * moved / np.sqrt(past[0][touched])
            for value, gradient, seen in ((weights, hidden.T @ error, past[1]), (bias, error.sum(0), past[2])):
                seen += gradient**2
                value -= step * gradient / np.sqrt(seen)
    return Model((vectors @ weights).astype(np.float32), bias.astype(np.float64), 1.0, grams)
