"""Text, date and number formatting columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"

# Characters a plain strip removes: every code point that Unicode counts as white space.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Openings a model tends to put before a summary, removed in this order.
STOCK_OPENINGS = ("Voici un résumé :", "Résumé :", "L'article explique que")


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.trim(text, F.lit(WHITESPACE))


def shorten(text: Column, length: int) -> Column:
    """First ``length`` characters, with an ellipsis only where something was cut."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def iso_text(timestamp: Column) -> Column:
    """Timestamp as ISO text to the second, without zone."""
    return F.date_format(timestamp, ISO_SECONDS)


def iso_to_day(published: Column) -> Column:
    """ISO text to day/month/year; null when the text is not in the seconds form."""
    return F.date_format(F.try_to_timestamp(published, F.lit(ISO_SECONDS)), "dd/MM/yyyy")


def local_datetime(utc: Column, zone: str = "Europe/Paris") -> Column:
    """UTC timestamp as local day and time text, ``N/A`` when unknown."""
    local = F.date_format(F.from_utc_timestamp(utc, zone), "dd/MM/yyyy 'à' HH:mm")
    return F.coalesce(local, F.lit("N/A"))


def utc_time(moment: Column) -> Column:
    """A point in time as UTC wall clock time, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as ISO text in UTC, whatever the session's zone."""
    start = F.lit("1970-01-01T00:00:00").cast("timestamp_ntz")
    return iso_text(start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def wall_clock(iso: Column) -> Column:
    """Timestamp of ISO text cut to the second; a zone suffix is dropped, not applied."""
    head = F.regexp_extract(iso, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 0)
    return F.try_to_timestamp(F.replace(head, F.lit(" "), F.lit("T")), F.lit(ISO_SECONDS))


def line_breaks(text: Column) -> Column:
    """Newlines as HTML breaks; null becomes empty."""
    return F.coalesce(F.replace(text, F.lit("\n"), F.lit("<br>\n")), F.lit(""))


def percent_text(similarity: Column) -> Column:
    """Similarity as one-decimal percent text, rounded from the exact binary value.

    Pass the raw double: a value that was rounded before gives another text now and then.
    """
    return F.replace(F.format_number(similarity * 100, 1), F.lit(","), F.lit(""))


def whole_percent(ratio: Column) -> Column:
    """Ratio as whole percent text, truncated."""
    return F.concat((ratio.cast("double") * 100).cast("int").cast("string"), F.lit("%"))


def clean_summary(answer: Column, openings: Sequence[str] = STOCK_OPENINGS) -> Column:
    """Model answer without outer quotes and without each stock opening, in order."""
    text = stripped(F.trim(stripped(answer), F.lit('"')))
    for opening in openings:
        text = stripped(F.regexp_replace(text, rf"^\Q{opening}\E", ""))
    return text


def prepare_text(
    frame: DataFrame,
    text: str,
    out: str,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Lower-cased words of a text without stop words and punctuation, joined by blanks.

    Without a list the French stop words that ship with Spark ML are used.
    """
    words = f"{out}_words"
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("french")
    split = F.array_remove(F.split(F.lower(F.col(text)), r"[\s\p{Punct}]++"), "")
    remover = StopWordsRemover(
        inputCol=words,
        outputCol=f"{out}_kept",
        stopWords=list(stop_words),
        caseSensitive=True,
        locale="en_US",
    )
    kept = remover.transform(frame.withColumn(words, split))
    return kept.withColumn(out, F.array_join(f"{out}_kept", " ")).drop(words, f"{out}_kept")
