"""Random corpora: scores and marks against the full-text module of SQLite."""

import random
import sqlite3

import pytest

from newsloom.operators.search import query, search, unit

WORDS = ["a", "ab", "abc", "b", "ba", "été", "ete", "Été", "éte", "x1", "1", "ñ", "N", "ß", "œ", "bab"]
GAPS = [" ", " ", " ", ", ", "-", "_", "'", "\n", " … ", "́ ", " é"]


def text(rng, longest):
    words = rng.choices(WORDS, k=rng.randint(0, longest))
    return "".join(word + rng.choice(GAPS) for word in words)


@pytest.fixture(scope="module", params=[11, 12])
def corpus(request, spark):
    rng = random.Random(request.param)
    docs = [(i, text(rng, 4), text(rng, 12)) for i in range(1, 121)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(article_id, title, content, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without full-text search")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", docs)
    frame = spark.createDataFrame(
        [(i, t, s, "l", "2025-01-01T00:00:00", "rss") for i, t, s in docs],
        "article_id long, title string, summary string, link string, published string, source string",
    )
    return frame.repartition(4), con


CASES = [
    ('"a b"', query("a b")),
    ('"a a" OR "b a"', query(any_of=["a a", "b a"])),
    ("ab*", query(unit("ab", prefix=True))),
    ('"a ab" *', query(unit("a ab", prefix=True))),
    ("ete NOT x1", query("été", exclude="x1")),
    ("(abc OR ba) AND (a AND b)", query(["a", "b"], any_of=["abc", "ba"])),
    ("title: (ete OR bab)", query(any_of=["ete", "bab"], column="title")),
    ("ß OR œ OR n", query(any_of=["ß", "œ", "ñ"])),
]


@pytest.mark.parametrize("match, searched", CASES, ids=[c[0] for c in CASES])
def test_random_corpus(corpus, match, searched):
    articles, con = corpus
    expected = con.execute(
        "SELECT article_id, -rank, highlight(f, 1, '<mark>', '</mark>'), highlight(f, 2, '<mark>', '</mark>') "
        "FROM f WHERE f MATCH ? ORDER BY rank",
        (match,),
    ).fetchall()
    found = {r.article_id: r for r in search(articles, searched, limit=500, index_id=True).collect()}
    assert set(found) == {int(row[0]) for row in expected}
    for article_id, score, title, content in expected:
        row = found[int(article_id)]
        assert (row.title, row.summary) == (title, content)
        assert row.score == pytest.approx(100 * score / expected[0][1], abs=0.006)
