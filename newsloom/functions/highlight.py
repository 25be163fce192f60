"""Marks around the words of a text that a search matched."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.tokens import fold_text

# A word: letters and digits, with the combining marks that belong to them.
_WORD = re.compile(r"[^\W_][^\W_̀-ͯ]*(?:[̀-ͯ]+[^\W_]*)*")


def _spans(words: list[str], wanted: Sequence[tuple[tuple[str, ...], bool]]) -> list[tuple[int, int]]:
    """Word ranges that a unit covers; overlapping ranges are one."""
    found = []
    for unit, prefix in wanted:
        for start in range(len(words) - len(unit) + 1):
            *head, last = words[start : start + len(unit)]
            if tuple(head) == unit[:-1] and (
                last.startswith(unit[-1]) if prefix else last == unit[-1]
            ):
                found.append((start, start + len(unit)))
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def mark_text(
    text: str, wanted: Sequence[tuple[tuple[str, ...], bool]], before: str, after: str
) -> str:
    """Text with marks around the units; each word on its own, a phrase as a whole."""
    places = [match.span() for match in _WORD.finditer(text)]
    words = [fold_text(text[a:b]) for a, b in places]
    pieces, done = [], 0
    for start, end in _spans(words, wanted):
        left, right = places[start][0], places[end - 1][1]
        pieces += [text[done:left], before, text[left:right], after]
        done = right
    return "".join(pieces) + text[done:]


def highlighted(
    text: Column, wanted: Sequence[tuple[tuple[str, ...], bool]], before: str, after: str
) -> Column:
    """Column form of ``mark_text``, for the rows of a search result."""

    @F.arrow_udf("string")
    def mark(texts: pa.Array) -> pa.Array:
        marked = [None if t is None else mark_text(t, wanted, before, after) for t in texts.to_pylist()]
        return pa.array(marked, pa.string())

    return mark(text)
