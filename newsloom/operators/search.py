"""Full-text search over articles: match, BM25 score, rank in percent, highlight.

A query is a set of units (word, phrase or prefix), not a query string. Every search works on one
*hits* frame with a row per article: its length in tokens and how often each unit occurs. Hits come
either from the texts (``scan_hits``, narrow, no shuffle) or from a stored index
(``newsloom.operators.index.index_hits``); scoring is the same for both.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.highlight import highlighted
from newsloom.functions.tokens import split_words, tokens
from newsloom.plans.staging import staged
from newsloom.schemas import DAY

# BM25 saturation and length weight, and the floor of the rarity factor.
K1, B, RARITY_FLOOR = 1.2, 0.75, 1e-6

TEXT_COLUMNS = {"title": "title", "content": "summary"}
ID_COLUMN = "article_id"


@dataclass(frozen=True)
class Unit:
    """Consecutive words that count as one search unit.

    ``prefix`` lets the last word match any longer word; ``column`` limits the unit to ``title``
    or ``content``.
    """

    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


def unit(text: str, *, prefix: bool = False, column: str | None = None) -> Unit:
    """Search unit of a text: one word, or a phrase when it splits into several."""
    words = tuple(split_words(text))
    if not words:
        raise ValueError("the search term is empty")
    return Unit(words, prefix, _known_column(column))


def _known_column(column: str | None) -> str | None:
    if column not in (None, ID_COLUMN, *TEXT_COLUMNS):
        raise ValueError(f"unknown search column: {column}")
    return column


@dataclass(frozen=True)
class Query:
    """All units of ``must``, at least one of ``any_of`` (if given), none of ``exclude``."""

    must: tuple[Unit, ...] = ()
    any_of: tuple[Unit, ...] = ()
    exclude: tuple[Unit, ...] = ()

    @property
    def scored(self) -> tuple[Unit, ...]:
        return self.must + self.any_of

    @property
    def units(self) -> tuple[Unit, ...]:
        return self.scored + self.exclude


def _units(items: str | Unit | Sequence[str | Unit], column: str | None) -> tuple[Unit, ...]:
    if isinstance(items, (str, Unit)):
        items = [items]
    made = (item if isinstance(item, Unit) else unit(item) for item in items)
    return tuple(replace(u, column=u.column or _known_column(column)) for u in made)


def query(
    must: str | Unit | Sequence[str | Unit] = (),
    any_of: str | Unit | Sequence[str | Unit] = (),
    exclude: str | Unit | Sequence[str | Unit] = (),
    column: str | None = None,
) -> Query:
    """Query from words, phrases (texts of several words) and units."""
    made = Query(_units(must, column), _units(any_of, column), _units(exclude, column))
    if not made.scored:
        raise ValueError("the search term is empty")
    return made


def _word_test(word: Column, searched: Unit, offset: int) -> Column:
    """A token is the unit's word at ``offset``, or starts with it where the prefix stands."""
    wanted = searched.words[offset]
    if searched.prefix and offset == len(searched.words) - 1:
        return F.startswith(word, F.lit(wanted))
    return word == wanted


def occurrences(words: Column, searched: Unit) -> Column:
    """How often a unit occurs in an array of tokens; overlapping phrases all count."""
    if len(searched.words) == 1:
        if not searched.prefix:
            return F.size(words) - F.size(F.array_remove(words, searched.words[0]))
        return F.size(F.filter(words, lambda word: _word_test(word, searched, 0)))

    def starts_here(word: Column, i: Column) -> Column:
        following = [
            F.coalesce(_word_test(F.get(words, i + n), searched, n), F.lit(False))
            for n in range(1, len(searched.words))
        ]
        return reduce(and_, following, _word_test(word, searched, 0))

    # Positions are compared only where all whole words of the phrase are there at all.
    whole = searched.words[:-1] if searched.prefix else searched.words
    present = reduce(and_, [F.array_contains(words, word) for word in whole])
    return F.when(present, F.size(F.filter(words, starts_here))).otherwise(0)


def _with_words(articles: DataFrame, index_id: bool) -> tuple[DataFrame, dict[str, str]]:
    """Articles with a token array per searched column, and the names of those arrays."""
    fields = {name: f"_words_{name}" for name in TEXT_COLUMNS}
    arrays = [tokens(F.col(TEXT_COLUMNS[name])).alias(array) for name, array in fields.items()]
    if index_id:
        fields[ID_COLUMN] = "_words_id"
        arrays.append(F.array(F.col(ID_COLUMN).cast("string")).alias("_words_id"))
    return articles.select("*", *arrays), fields


def _sum(counts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts, F.lit(0))


def _searched_in(searched: Unit, fields: dict[str, str]) -> list[Column]:
    return [F.col(array) for name, array in fields.items() if searched.column in (None, name)]


def scan_hits(articles: DataFrame, searched: Query, *, index_id: bool = False) -> DataFrame:
    """Articles with ``doc_len`` and ``n_0``, ``n_1``, ... occurrences of the query's units.

    With ``index_id`` the article id counts as a word of the article, as in the stored index of
    the same option.
    """
    split, fields = _with_words(articles, index_id)
    columns = [_sum([F.size(array) for array in fields.values()]).alias("doc_len")]
    for number, searched_unit in enumerate(searched.units):
        counts = [occurrences(w, searched_unit) for w in _searched_in(searched_unit, fields)]
        columns.append(_sum(counts).alias(f"n_{number}"))
    # A generated row is computed once. As plain columns the counts would be copied into every
    # later filter, and each copy would split the texts again.
    return split.select("*", F.inline(F.array(F.struct(*columns)))).drop(*fields.values())


def hit_statistics(hits: DataFrame, searched: Query) -> DataFrame:
    """Number of articles, their mean length, and the articles that hold each scored unit, of all articles' hits."""
    return hits.agg(
        F.count("*").alias("docs"),
        (F.sum("doc_len") / F.count("*")).alias("mean_len"),
        *[F.count_if(F.col(f"n_{i}") > 0).alias(f"df_{i}") for i in range(len(searched.scored))],
    )


def matches(searched: Query) -> Column:
    """Condition on the occurrence columns: the article satisfies the query."""
    must, scored = len(searched.must), len(searched.scored)
    conditions = [F.col(f"n_{i}") > 0 for i in range(must)]
    if searched.any_of:
        conditions.append(reduce(or_, [F.col(f"n_{i}") > 0 for i in range(must, scored)]))
    conditions += [F.col(f"n_{i}") == 0 for i in range(scored, len(searched.units))]
    return reduce(and_, conditions)


def bm25(searched: Query, statistics: Column) -> Column:
    """Score of a matching article, higher is better.

    A unit that more than half of the articles hold gets the floor instead of a negative weight.
    """
    docs, mean_len = statistics["docs"].cast("double"), statistics["mean_len"]
    length = K1 * (1 - B + B * F.col("doc_len") / mean_len)
    score = F.lit(0.0)
    for i in range(len(searched.scored)):
        held = statistics[f"df_{i}"].cast("double")
        rarity = F.log((docs - held + 0.5) / (held + 0.5))
        rarity = F.when(rarity <= 0, F.lit(RARITY_FLOOR)).otherwise(rarity)
        count = F.col(f"n_{i}").cast("double")
        score = score + rarity * (count * (K1 + 1)) / (count + length)
    return score


def scored_hits(hits: DataFrame, searched: Query, statistics: DataFrame) -> DataFrame:
    """Matching articles with ``bm25``; ``statistics`` is one row of the whole corpus."""
    row = statistics.select(F.struct("*")).scalar()
    found = hits.filter(matches(searched)).withColumn("_corpus", row)
    return found.withColumn("bm25", bm25(searched, F.col("_corpus"))).drop("_corpus")


def scan_scores(articles: DataFrame, searched: Query, *, index_id: bool = False) -> DataFrame:
    """Matching articles (id, publication, counts) with ``bm25``, straight from the texts.

    Every text is split into words once: the short hits of all articles are staged, and statistics, scores
    and ranks come from them. For repeated searches write an index.
    """
    short = [ID_COLUMN, *(c for c in ("published", DAY) if c in articles.columns)]
    counts = [f"n_{i}" for i in range(len(searched.units))]
    hits = staged(scan_hits(articles, searched, index_id=index_id).select(*short, "doc_len", *counts))
    return scored_hits(hits, searched, hit_statistics(hits, searched))


def _day(text: str | dt.date | None) -> dt.date | None:
    if text is None or isinstance(text, dt.date):
        return text
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        raise ValueError(f"not a date in the form YYYY-MM-DD: {text}") from None


def in_date_range(
    published: Column,
    date_min: str | dt.date | None = None,
    date_max: str | dt.date | None = None,
    *,
    inclusive_end: bool = False,
) -> Column:
    """Publication text inside a date range, both ends optional.

    Texts are compared as texts: a time on the end day sorts after the bare date, so the end day is
    left out unless ``inclusive_end`` is set.
    """
    first, last = _day(date_min), _day(date_max)
    condition = F.lit(True)
    if first:
        condition &= published >= first.isoformat()
    if last and inclusive_end:
        condition &= published < (last + dt.timedelta(days=1)).isoformat()
    elif last:
        condition &= published <= last.isoformat()
    return condition


def percent_of_best(scored: DataFrame, score: str = "bm25", out: str = "rank") -> DataFrame:
    """Score as percent of the best score in ``scored``, two decimals."""
    best = scored.agg(F.max(score)).scalar()
    return scored.withColumn(out, F.round(100.0 * F.col(score) / best, 2))


def percent_of_range(scored: DataFrame, score: str = "bm25", out: str = "rank") -> DataFrame:
    """Place of a score in the range of scores: best 100, worst 0; null without a range."""
    ends = scored.agg(F.max(score).alias("high"), F.min(score).alias("low"))
    row = ends.select(F.struct("high", "low")).scalar()
    spread = F.nullif(row["high"] - row["low"], F.lit(0.0))
    return scored.withColumn(out, F.round(100.0 * (F.col(score) - row["low"]) / spread, 2))


def top_ranked(
    scored: DataFrame,
    limit: int | None = 10,
    date_min: str | dt.date | None = None,
    date_max: str | dt.date | None = None,
    *,
    inclusive_end: bool = False,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Best hits in the date range, with ``rank`` relative to the best hit of any date.

    Publication is a column of the hits, or is looked up in ``dates``; then only articles of the
    range are read.
    """
    best_first = [F.desc("bm25"), F.asc(ID_COLUMN)]
    any_date = date_min is None and date_max is None
    if limit is not None and any_date:
        # The best hit is among the best ones: no second pass, and the window sees ``limit`` rows.
        top = scored.orderBy(*best_first).limit(limit)
        best = F.max("bm25").over(Window.partitionBy())
        return top.withColumn("rank", F.round(100.0 * F.col("bm25") / best, 2))
    ranked = percent_of_best(scored)
    if not any_date:
        options = {"inclusive_end": inclusive_end}
        inside = in_date_range(F.col("published"), date_min, date_max, **options)
        if dates is None:
            ranked = ranked.filter(inside)
        else:
            if DAY in dates.columns:
                # The days of a stored table are its partitions.
                inside &= in_date_range(F.col(DAY), date_min, date_max, **options)
            ranked = ranked.join(dates.filter(inside).select(ID_COLUMN), ID_COLUMN)
    ranked = ranked.orderBy(*best_first)
    return ranked if limit is None else ranked.limit(limit)


def shaped(results: DataFrame) -> DataFrame:
    """Result columns of a search page: ``summary``, ``score`` and a lower-case ``source``."""
    return results.select(
        ID_COLUMN,
        "title",
        "link",
        "summary",
        "published",
        F.col("rank").alias("score"),
        F.lower("source").alias("source"),
    )


def search(
    articles: DataFrame,
    searched: Query,
    *,
    date_min: str | dt.date | None = None,
    date_max: str | dt.date | None = None,
    inclusive_end: bool = False,
    limit: int | None = 10,
    index_id: bool = False,
    mark: tuple[str, str] | None = ("<mark>", "</mark>"),
) -> DataFrame:
    """Ranked search of the texts: match, score, date range, best ``limit``, then highlight.

    Article ids must be distinct: the texts of the result are found by them.
    """
    scored = scan_scores(articles, searched, index_id=index_id)
    found = top_ranked(scored, limit, date_min, date_max, inclusive_end=inclusive_end)
    found = articles.join(found.select(ID_COLUMN, "rank", "bm25"), ID_COLUMN)
    found = found.orderBy(F.desc("bm25"), F.asc(ID_COLUMN))
    if mark:
        found = mark_hits(found, searched, *mark)
    return shaped(found)


def mark_hits(found: DataFrame, searched: Query, before: str, after: str) -> DataFrame:
    """Title and summary with the query's words marked; meant for the few rows of a result."""
    for name, column in TEXT_COLUMNS.items():
        units = [u for u in searched.scored if u.column in (None, name)]
        if units:
            marks = [(u.words, u.prefix) for u in units]
            found = found.withColumn(column, highlighted(F.col(column), marks, before, after))
    return found
