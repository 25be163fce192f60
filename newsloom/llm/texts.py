"""Texts of an Arrow batch as flat byte arrays: words, their hashes and word shingles.

A batch is worked through in blocks of whole texts, so that memory follows the block size and the
longest text. Hashes are polynomial over the bytes, taken from one running sum per block.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15
_STEPS = (
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0xD6E8FEB86659FD93,
    0xFF51AFD7ED558CCD,
    0xA0761D6478BD642F,
)


def worker_value(name: str, make: Callable[[], Any]) -> Any:
    """A value made once per Python process; functions travel by value, so modules cannot hold it."""
    held = sys.modules.setdefault("_newsloom_worker", types.ModuleType("_newsloom_worker"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    held = worker_value("powers", dict)
    if len(held.get("up", ())) < size:
        size = max(size, BLOCK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            held[name] = np.cumprod(factors)
    return held["up"], held["down"]


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, one to one."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or binary values) and the offsets of each; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    texts = texts.cast(pa.large_binary()).fill_null(b"") if binary else texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    data, offsets = text_buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        upto = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        upto = min(max(upto, row + 1), rows)
        yield row, data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row]
        row = upto


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def is_space(data: np.ndarray) -> np.ndarray:
    """Space, tab, line feed, vertical tab, form feed, carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true positions that no break cuts."""
    size = len(inside)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(size + 1, bool)
    cut[breaks] = True
    fresh = cut[:-1].copy()
    fresh[0] = True
    fresh[1:] |= ~inside[:-1]
    last = cut[1:].copy()
    last[-1] = True
    last[:-1] |= ~inside[1:]
    return np.flatnonzero(inside & fresh), np.flatnonzero(inside & last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of each text's words in them."""
    starts, ends = runs(~is_space(data), offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """The running sum of which every span's hash is taken."""
    up, _ = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span of bytes; ``total`` are the sums of ``data``, if they are there already."""
    _, down = _powers(len(data) + 1)
    total = byte_sums(data) if total is None else total
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, and each text's offsets in them."""
    data = lower_ascii(data)
    starts, ends, bounds = words(data, offsets)
    return span_hashes(data, starts, ends), bounds


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges that begin at ``starts`` with the given lengths, in order."""
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    return np.repeat(starts - firsts, lengths) + np.arange(total)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than the width count as one shingle."""
    counts = np.diff(bounds)
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    sums = np.zeros(int(per_text.sum()), np.uint64)
    edges = np.concatenate([[0], np.cumsum(per_text)])
    full = counts >= width
    at = ragged(bounds[:-1][full], per_text[full])
    into = ragged(edges[:-1][full], per_text[full])
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value += hashes[at + k] * np.uint64(_STEPS[k % len(_STEPS)] + 2 * (k // len(_STEPS)))
    sums[into] = mixed(value)
    for text in np.flatnonzero((counts > 0) & ~full):
        span = hashes[bounds[text] : bounds[text + 1]]
        steps = np.array([_STEPS[k % len(_STEPS)] + 2 * (k // len(_STEPS)) for k in range(len(span))], np.uint64)
        sums[edges[text]] = mixed((span * steps).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(span)))[0]
    out = []
    for text in range(len(counts)):
        part = sums[edges[text] : edges[text + 1]]
        part.sort()
        if len(part) > 1:
            fresh = np.empty(len(part), bool)
            fresh[0] = True
            np.not_equal(part[1:], part[:-1], out=fresh[1:])
            if not fresh.all():
                part = part[fresh]
        out.append(part)
    return out


def free_name(columns: list[str], wish: str) -> str:
    """A column name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
