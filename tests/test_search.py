"""Search against the word index that ships with SQLite, on a small corpus."""

import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from newsloom.functions.highlight import mark_text
from newsloom.functions.tokens import split_words, tokens
from newsloom.operators.index import (
    WHOLE,
    build_index,
    refresh_index,
    search_index,
    term_statistics,
    write_index,
)
from newsloom.operators.search import (
    percent_of_range,
    query,
    scan_scores,
    search,
    unit,
)

DOCS = [
    (1, "Alpine élan vital", "Le compilateur alpine alpha alp. Été ÉTÉ été!", "2025-10-18T08:00:00"),
    (2, "Docker en production", "docker docker docker, la sécurité de l'IA (5 étapes) c++", "2025-10-19T09:00:00"),
    (3, "Cœur et œuvre", "Straße naïve café cafe CAFÉ; docker compose la la la", "2025-10-20T00:00:00"),
    (4, "", "intelligence artificielle et cybersécurité, intelligence", "2025-10-20T12:00:00"),
    (5, "Intelligence Artificielle", "la sécurité et la cyber; une intelligence artificielle", "2025-10-21T10:00:00"),
    (6, "Notes 5", "la fin et la suite et rien d'autre", "2025-10-22T10:00:00"),
    (7, "Vide", "", "2025-10-22T11:00:00"),
    (8, "Rare", "ΑΛΦΑ бета ２０２５ été l’été", "2025-10-23T11:00:00"),
]


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(i, t, s, f"https://x/{i}", p, "RSS") for i, t, s, p in DOCS]
    return spark.createDataFrame(
        rows, "article_id long, title string, summary string, link string, published string, source string"
    )


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(article_id, title, content, tokenize='unicode61', prefix='2,3')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without full-text search")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", [(i, t, s) for i, t, s, _ in DOCS])
    return con


def fts_scores(fts, match):
    rows = fts.execute("SELECT article_id, -rank FROM f WHERE f MATCH ?", (match,)).fetchall()
    return {int(i): score for i, score in rows}


CASES = [
    ("docker", query("docker")),
    ("intelligence artificielle", query(["intelligence", "artificielle"])),
    ("docker OR intelligence", query(any_of=["docker", "intelligence"])),
    ("la NOT docker", query("la", exclude="docker")),
    ("la AND (docker OR cyber)", query("la", any_of=["docker", "cyber"])),
    ('"intelligence artificielle"', query("intelligence artificielle")),
    ('"la la"', query("la la")),
    ('"la securite" OR docker', query(any_of=["la sécurité", "docker"])),
    ("alp*", query(unit("alp", prefix=True))),
    ("cyb* OR al*", query(any_of=[unit("cyb", prefix=True), unit("al", prefix=True)])),
    ('"la se" *', query(unit("la se", prefix=True))),
    ("title: intelligence", query("intelligence", column="title")),
    ("content: (intelligence OR docker)", query(any_of=["intelligence", "docker"], column="content")),
    ("cafe", query("CAFÉ")),
    ("ete", query("été")),
    ("oeuvre", query("oeuvre")),
    ("œuvre", query("œuvre")),
    ("strasse", query("strasse")),
    ("straße", query("Straße")),
    ("5", query("5")),
    ("et", query("et")),
    ("αλφα", query("αλφα")),
    ('"l IA"', query("l'ia")),
    ('"c"', query("c++")),
    ("absent", query("absent")),
]


@pytest.mark.parametrize("match, searched", CASES, ids=[c[0] for c in CASES])
def test_scores_equal_the_reference_engine(articles, fts, match, searched):
    rows = scan_scores(articles, searched, index_id=True).select("article_id", "bm25").collect()
    assert {r.article_id: r.bm25 for r in rows} == pytest.approx(fts_scores(fts, match), rel=1e-9)


@pytest.fixture(scope="module")
def index(spark, articles, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "words")
    write_index(articles, path, index_id=True)
    with pytest.raises(ValueError, match="already in the index"):
        write_index(articles.limit(1), path, index_id=True, mode="append")
    return spark.read.parquet(path)


@pytest.mark.parametrize("match, searched", CASES, ids=[c[0] for c in CASES])
def test_index_gives_the_same_scores(articles, index, fts, match, searched):
    found = search_index(articles, index, searched, limit=None, mark=None).collect()
    scores = fts_scores(fts, match)
    best = max(scores.values(), default=None)
    assert {r.article_id for r in found} == set(scores)
    for row in found:
        assert row.score == pytest.approx(100 * scores[row.article_id] / best, abs=0.006)


HIGHLIGHTS = [
    ("ete", query("ete")),
    ("la", query("la")),
    ('"la la"', query("la la")),
    ("intelligence artificielle", query(["intelligence", "artificielle"])),
    ('"intelligence artificielle" OR intelligence', query(any_of=["intelligence artificielle", "intelligence"])),
    ("alp*", query(unit("alp", prefix=True))),
    ("title: intelligence", query("intelligence", column="title")),
]


@pytest.mark.parametrize("match, searched", HIGHLIGHTS, ids=[h[0] for h in HIGHLIGHTS])
def test_marks_equal_the_reference_engine(articles, fts, match, searched):
    marked = fts.execute(
        "SELECT article_id, highlight(f, 1, '<mark>', '</mark>'), highlight(f, 2, '<mark>', '</mark>') "
        "FROM f WHERE f MATCH ?",
        (match,),
    ).fetchall()
    found = search(articles, searched, limit=20).collect()
    assert {(r.article_id, r.title, r.summary) for r in found} == {(int(i), t, c) for i, t, c in marked}


def test_overlapping_phrases_share_a_mark():
    wanted = [(("a", "b"), False), (("b", "c"), False)]
    assert mark_text("a b c a b", wanted, "[", "]") == "[a b c] [a b]"
    assert mark_text("x a-b", wanted, "[", "]") == "x [a-b]"


def test_rank_is_relative_to_the_best_of_any_date(articles):
    everything = search(articles, query("docker")).collect()
    assert everything[0].article_id == 2 and everything[0].score == 100.0
    assert everything[0].source == "rss"
    later = search(articles, query("docker"), date_min="2025-10-20").collect()
    assert [r.article_id for r in later] == [3]
    assert later[0].score == everything[1].score < 100.0


def test_end_day_is_left_out_unless_asked(articles):
    options = {"date_min": "2025-10-20", "date_max": "2025-10-20", "mark": None}
    plain = search(articles, query(any_of=["docker", "intelligence"]), **options)
    whole = search(articles, query(any_of=["docker", "intelligence"]), inclusive_end=True, **options)
    assert [r.article_id for r in plain.collect()] == []
    assert {r.article_id for r in whole.collect()} == {3, 4}


def test_limit_and_index_search_agree(articles, index):
    searched = query(any_of=["la", "docker", "intelligence"])
    for options in ({"limit": 2}, {"limit": 3, "date_min": "2025-10-20", "date_max": "2025-10-22"}):
        scan = search(articles, searched, index_id=True, **options).collect()
        assert search_index(articles, index, searched, **options).collect() == scan


def test_date_range_prunes_the_days_of_a_stored_table(spark, articles, index, tmp_path):
    path = str(tmp_path / "articles")
    days = articles.withColumn("published_day", F.substring("published", 1, 10))
    days.write.partitionBy("published_day").parquet(path)
    stored = spark.read.schema(days.schema).parquet(path)
    searched = query(any_of=["la", "docker", "intelligence"])
    options = {"date_min": "2025-10-20", "date_max": "2025-10-21", "inclusive_end": True, "mark": None}
    found = search_index(stored, index, searched, **options)
    assert found.collect() == search(articles, searched, index_id=True, **options).collect()
    assert len(found.collect()) == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "published_day" in plan and "PartitionFilters: [isnotnull(published_day" in plan


@pytest.mark.parametrize("bad", [{"date_min": "20-10-2025"}, {"date_max": "tomorrow"}])
def test_bad_dates_are_refused(articles, bad):
    with pytest.raises(ValueError, match="YYYY-MM-DD"):
        search(articles, query("la"), **bad)


def test_empty_queries_are_refused():
    for make in (lambda: query(), lambda: query(""), lambda: query("!?"), lambda: query(exclude="la")):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(ValueError):
        query("x", column="body")


def test_percent_of_range(articles):
    rows = percent_of_range(scan_scores(articles, query("la"))).collect()
    best, worst = max(rows, key=lambda r: r.bm25), min(rows, key=lambda r: r.bm25)
    assert best["rank"] == 100.0 and worst["rank"] == 0.0
    single = percent_of_range(scan_scores(articles, query("alpine"))).first()
    assert single["rank"] is None


def test_vocabulary_equals_the_reference_engine(spark, articles, fts):
    fts.execute("CREATE VIRTUAL TABLE IF NOT EXISTS v USING fts5vocab(f, 'row')")
    expected = {t: (d, c) for t, d, c in fts.execute("SELECT term, doc, cnt FROM v")}
    found = {r.term: (r.articles, r.occurrences) for r in term_statistics(articles, index_id=True).collect()}
    assert found == expected


def test_folding_equals_the_reference_engine(spark):
    """Every accented Latin letter folds as the engine's tokenizer folds it."""
    letters = [
        chr(c)
        for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
        if unicodedata.category(chr(c))[0] == "L"
    ]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without full-text search")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(ord(ch), f"x{ch}y") for ch in letters])
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    engine = {doc: term for term, doc, _, _ in con.execute("SELECT * FROM v")}
    rows = spark.createDataFrame([(ord(ch), f"x{ch}y") for ch in letters], "code long, t string")
    ours = {r.code: r.w for r in rows.select("code", tokens(F.col("t")).alias("w")).collect()}
    differing = [chr(c) for c in engine if ours[c] != [engine[c]]]
    assert len(differing) <= 8, differing
    assert not set("àâäáãåçéèêëíìîïñóòôöõúùûüýÿœæß") & set(differing)


def test_driver_and_plan_tokens_agree(spark):
    texts = [s for _, t, s, _ in DOCS] + ["a_b __c__ d-e", "É́x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", tokens(F.col("t")).alias("w")).collect():
        assert row.w == split_words(row.t)


def test_refreshed_index_equals_a_new_one(spark, articles):
    changed = spark.createDataFrame([(1,), (3,), (9,)], "article_id long")
    new_rows = spark.createDataFrame(
        [(1, "Nouveau titre", "texte", "l", "2025", "rss"), (9, "Neuf", "ajout", "l", "2025", "rss")],
        articles.schema,
    )
    state = articles.filter("article_id NOT IN (1, 3)").unionByName(new_rows)
    refreshed = refresh_index(build_index(articles), changed, new_rows)
    assert sorted(map(tuple, refreshed.collect())) == sorted(map(tuple, build_index(state).collect()))


def test_index_read_is_pushed_to_the_files(index):
    from newsloom.operators.index import index_hits

    plan = index_hits(index, query(any_of=["docker", "la"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,docker)" in plan
    assert index.filter(F.col("term") == WHOLE).count() == len(DOCS)


def test_null_texts_are_empty(spark):
    rows = spark.createDataFrame(
        [(1, None, "mot"), (2, "mot", None), (3, None, None)], "article_id long, title string, summary string"
    )
    assert {r.article_id for r in scan_scores(rows, query("mot")).collect()} == {1, 2}
    assert build_index(rows).filter(F.col("term") == WHOLE).count() == 3
