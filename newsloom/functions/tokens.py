"""Accent-folding word tokens, the same on the driver and in a plan."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding_pairs() -> dict[str, str]:
    """Accented Latin letters that are one base letter and one mark, with that base letter."""
    pairs = {}
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) == 2 and parts[0].isascii():
            pairs[letter] = parts[0]
    return pairs


_PAIRS = _folding_pairs()
# Combining marks stand last: translate() deletes what has no partner.
_MARKS = "".join(map(chr, range(0x0300, 0x0370)))
FOLD_FROM = "".join(_PAIRS) + _MARKS
FOLD_TO = "".join(_PAIRS.values())

_PYTHON_FOLD = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, _MARKS)
_SEPARATORS = r"[^\p{L}\p{N}\p{Co}]++"


def folded(text: Column) -> Column:
    """Lower-cased text without accents. Pure ASCII text skips the letter mapping."""
    lower = F.lower(text)
    has_accents = F.length(text) != F.octet_length(text)
    return F.when(has_accents, F.translate(lower, FOLD_FROM, FOLD_TO)).otherwise(lower)


def tokens(text: Column) -> Column:
    """Words of a text in order: runs of letters and digits, lower case, accents removed."""
    words = F.array_remove(F.split(folded(text), _SEPARATORS), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def fold_text(text: str) -> str:
    """Driver- or task-side counterpart of ``folded`` for single words and query texts."""
    return text.lower().translate(_PYTHON_FOLD)


def split_words(text: str) -> list[str]:
    """Driver-side counterpart of ``tokens`` for query words."""
    return re.findall(r"[^\W_]+", fold_text(text))
