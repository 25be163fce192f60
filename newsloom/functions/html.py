"""Plain text of HTML fragments."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Each quantifier is possessive or runs over single characters, so that a long fragment
# cannot exhaust the matcher's stack.
_COMMENT = r"(?s)<!--.*?-->"
_SCRIPT = r"(?is)<script\b[^>]*+>.*?</script\s*+>"
_STYLE = r"(?is)<style\b[^>]*+>.*?</style\s*+>"
_DECLARATION = r"(?s)<[!?][^>]*+>"
_TAG = r"""(?s)</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


@F.arrow_udf(StringType())
def _unescape(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


def without_tags(markup: Column, gap: str = "") -> Column:
    """Markup without comments, scripts, styles, declarations and tags; references are kept.

    Script and style bodies are dropped because they are not text of the page. ``gap`` stands where
    something was removed.
    """
    for pattern in (_COMMENT, _SCRIPT, _STYLE, _DECLARATION, _TAG):
        markup = F.regexp_replace(markup, pattern, gap)
    return markup


def html_text(markup: Column) -> Column:
    """Plain text of a fragment: tags removed, character references decoded.

    Only fragments that hold a reference travel to Python; the rest stay in the JVM. A zero
    character keeps the pieces apart while references are decoded, so that the end of one piece and
    the start of the next never form a reference together.
    """
    has_reference = F.contains(markup, F.lit("&"))
    decoded = _unescape(F.when(has_reference, without_tags(markup, "\0")))
    return F.when(has_reference, F.replace(decoded, F.lit("\0"), F.lit(""))).otherwise(
        without_tags(markup)
    )


def escaped(text: Column) -> Column:
    """Text made safe for an HTML page."""
    # The five characters with a special meaning and their references.
    for plain, reference in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&#34;"),
        ("'", "&#39;"),
    ):
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text
