"""The segmented index against a search of the texts, through random changes."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import search, segments, store
from newsloom.operators.search import query, unit

WORDS = ["alpe", "alpha", "alpine", "café", "berg", "see", "tal", "la", "ville", "de", "x1", "été"]
SCHEMA = "article_id long, title string, summary string"
QUERIES = [
    query("alpe"),
    query(["alpe", "berg"]),
    query(any_of=["alpe", "berg", "cafe"], exclude="tal"),
    query("la ville"),
    query(any_of=["la ville de", unit("alp", prefix=True)]),
    query(unit("la vi", prefix=True)),
    query("see", column="title"),
    query(any_of=["la la", "missing"]),
    query("missing"),
]


def text(pick, most=12):
    return " ".join(pick.choices(WORDS, weights=[3, 1, 1, 2, 2, 1, 2, 6, 4, 5, 1, 1], k=pick.randint(0, most)))


def rows_of(frame):
    return sorted((r.article_id, round(r.bm25, 9)) for r in frame.collect())


def check(spark, index, articles, queries=QUERIES):
    table = spark.createDataFrame(articles, SCHEMA)
    for searched in queries:
        expected = rows_of(search.scan_scores(table, searched))
        assert rows_of(segments.all_hits(index, searched)) == expected, searched
    return table


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("index")


def files(path):
    return {str(p) for p in path.rglob("*.parquet")}


def test_index_follows_changes(spark, folder, monkeypatch):
    monkeypatch.setattr(segments, "RANGE", 8)
    pick = random.Random(4)
    now = {i: (i, text(pick, 4), text(pick)) for i in range(60)}
    now[3] = (3, None, None)
    path = folder / "follows"
    index = segments.create_index(spark.createDataFrame(list(now.values()), SCHEMA), str(path))
    check(spark, index, list(now.values()), QUERIES[:4])
    for step in range(3):
        gone = pick.sample(sorted(now), 6)
        old = [now.pop(i) for i in gone]
        new = [(i, text(pick, 4), text(pick)) for i in gone[:3]] + [(200 + 10 * step + i, text(pick), text(pick)) for i in range(4)]
        now |= {row[0]: row for row in new}
        before = files(path / "segments")
        index = segments.change_index(index, spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA))
        # Old segments are left as they are.
        assert before <= files(path / "segments")
    articles = list(now.values())
    check(spark, segments.open_index(spark, str(path)), articles)
    merged = segments.merge_index(index, first=1, last=2)
    assert len(merged.segments) == 3
    check(spark, merged, articles, QUERIES[3:6])
    single = segments.merge_index(segments.open_index(spark, str(path)))
    assert len(single.segments) == 1
    check(spark, single, articles, QUERIES[2:5])
    # The merged index equals a new one, table by table.
    fresh = segments.create_index(spark.createDataFrame(articles, SCHEMA), str(folder / "fresh"))
    for table in ("terms", "corpus", "articles"):
        one, other = (i.read(table).drop("place").toPandas() for i in (single, fresh))
        key = sorted(one.columns)
        assert one.sort_values(key)[key].values.tolist() == other.sort_values(key)[key].values.tolist(), table


def test_only_known_changes(spark, folder):
    index = segments.create_index(spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (None, "e", "f")], SCHEMA), str(folder / "known"))
    one = spark.createDataFrame([(1, "a", "b")], SCHEMA)
    nothing = one.limit(0)
    assert index.read("corpus").first().articles == 2
    with pytest.raises(ValueError, match="already in the index"):
        segments.change_index(index, nothing, one)
    with pytest.raises(ValueError, match="not in the index"):
        segments.change_index(index, spark.createDataFrame([(9, "a", "b")], SCHEMA), nothing)
    with pytest.raises(ValueError, match="more than once"):
        segments.change_index(index, one.union(one), nothing)
    assert segments.change_index(index, nothing, nothing) is index
    index = segments.change_index(index, one, nothing)
    with pytest.raises(ValueError, match="not in the index"):
        segments.change_index(index, one, nothing)
    index = segments.change_index(index, nothing, one)
    assert rows_of(segments.all_hits(index, query("a"))) == rows_of(
        search.scan_scores(spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], SCHEMA), query("a"))
    )
    empty = segments.create_index(nothing, str(folder / "empty"))
    assert segments.all_hits(empty, query("a")).collect() == []
    assert segments.best_hits(empty, query("a"), 3).hits.collect() == []


@pytest.mark.parametrize("searched", [query("rare"), query(any_of=["common", "rare"]), query(["common", "other"], exclude="rare")])
def test_best_hits_skip_ranges(spark, folder, monkeypatch, searched):
    monkeypatch.setattr(segments, "RANGE", 4)
    monkeypatch.setattr(segments, "PROBED", 5)
    pick = random.Random(7)
    articles = []
    for i in range(400):
        words = ["common"] * pick.randint(0, 2) + ["other"] * pick.randint(0, 2) + ["fill"] * pick.randint(3, 40)
        words += ["rare"] * (i % 9 == 0) + ["common"] * (12 if i % 50 == 7 else 0)
        pick.shuffle(words)
        articles.append((i, "title", " ".join(words)))
    table = spark.createDataFrame(articles, SCHEMA)
    path = folder / "best"
    index = segments.open_index(spark, str(path)) if path.exists() else segments.create_index(table, str(path))
    found = segments.best_hits(index, searched, 5)
    best = [F.desc("bm25"), F.asc("article_id")]
    expected = search.scan_scores(table, searched).orderBy(*best).limit(5)
    assert rows_of(found.hits.orderBy(*best).limit(5)) == rows_of(expected)
    assert found.read < found.ranges / 2


def test_search_gives_the_same_page(spark, folder):
    pick = random.Random(2)
    articles = [
        (i, text(pick, 5), text(pick, 20), f"l{i}", f"2024-01-{i % 28 + 1:02d}T10:00:00", "rss") for i in range(80)
    ]
    table = spark.createDataFrame(articles, SCHEMA + ", link string, published string, source string")
    index = segments.create_index(table, str(folder / "page"))
    for searched, options in [
        (query(any_of=["alpe", "cafe"]), {}),
        (query("alpe"), {"date_min": "2024-01-05", "date_max": "2024-01-20", "limit": 4}),
        (query("la ville"), {"limit": None}),
    ]:
        expected = search.search(table, searched, **options).collect()
        assert segments.search_segments(table, index, searched, **options).collect() == expected


def test_dictionary(spark, folder):
    articles = [(1, "Alpe alp", "été alpha alpha"), (2, "été", "alpine ALPHA"), (3, "b", None)]
    index = segments.create_index(spark.createDataFrame(articles, SCHEMA), str(folder / "words"))
    rows = {r.term: tuple(r)[1:] for r in segments.dictionary(index, "alp").collect()}
    assert rows == {"alpe": (1, 1, 0, 1), "alp": (1, 1, 0, 1), "alpha": (2, 0, 2, 3), "alpine": (1, 0, 1, 1)}
    assert {r.term for r in segments.dictionary(index, "e").collect()} == {"ete"}
    assert segments.dictionary(index).count() == 6


ARTICLE = "title string, link string, summary string, score string, published string, source string, seq long"


def stored(spark, path, n=12):
    rows = [(f"t{i}", f"l{i}", f"text {i}", "1", f"2024-01-0{i % 4 + 1}T0{i % 10}:00:00", "rss", i) for i in range(n)]
    store.append_articles(spark.createDataFrame(rows, ARTICLE), path, at=dt.datetime(2024, 5, 1))
    return rows


def test_update_and_delete(spark, folder):
    path = str(folder / "store")
    stored(spark, path)
    days = {p.name: p.stat().st_mtime_ns for p in (folder / "store").rglob("*.parquet")}
    updates = spark.createDataFrame([(1, "new"), (99, "unknown"), (None, "none")], "article_id long, title string")
    deletes = spark.createDataFrame([(5,), (5,), (98,)], "article_id long")
    change = store.change_articles(spark, path, updates=updates, deletes=deletes, at=dt.datetime(2024, 6, 1))
    assert change.days == ("2024-01-01",)
    assert sorted(r.article_id for r in change.removed.collect()) == [1, 5]
    assert [(r.article_id, r.title, r.summary) for r in change.added.collect()] == [(1, "new", "text 0")]
    rows = {r.article_id: r for r in store.read_store(spark, path).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12]
    assert rows[1].title == "new" and rows[1].dt_created == dt.datetime(2024, 5, 1) and rows[1].dt_updated == dt.datetime(2024, 6, 1)
    assert rows[9].dt_updated == dt.datetime(2024, 5, 1)
    after = {p.name: p.stat().st_mtime_ns for p in (folder / "store").rglob("*.parquet")}
    kept = [name for name in days if name in after]
    assert kept and all(days[name] == after[name] for name in kept)


def test_move_and_empty_a_day(spark, folder):
    path = str(folder / "moved")
    stored(spark, path, 8)
    updates = spark.createDataFrame([(2, "2024-02-01T00:00:00")], "article_id long, published string")
    deletes = spark.createDataFrame([(1,), (5,)], "article_id long")
    store.change_articles(spark, path, updates=updates, deletes=deletes)
    rows = {r.article_id: r[store.DAY] for r in store.read_store(spark, path).collect()}
    assert sorted(rows) == [2, 3, 4, 6, 7, 8] and rows[2] == "2024-02-01"
    # Ids of deleted articles are not given again, and the store is not read for the greatest one.
    store.change_articles(spark, path, deletes=spark.createDataFrame([(8,)], "article_id long"))
    new = spark.createDataFrame([("n", "l", "s", "1", "2024-01-01T00:00:00", "rss", 1)], ARTICLE)
    assert store.append_articles(new, path) == 1
    assert max(r.article_id for r in store.read_store(spark, path).collect()) == 9


def test_faulty_changes_write_nothing(spark, folder):
    path = str(folder / "faulty")
    stored(spark, path, 4)
    before = files(folder / "faulty")
    for rows, match in [([(1, "a"), (1, "b")], "more than once"), ([(1, None)], "invalid"), ([(2, "odd")], "invalid")]:
        updates = spark.createDataFrame(rows, "article_id long, source string")
        with pytest.raises(ValueError, match=match):
            store.change_articles(spark, path, updates=updates)
    assert store.change_articles(spark, path).days == ()
    assert files(folder / "faulty") == before


def test_store_and_index_in_step(spark, folder):
    path = str(folder / "step")
    stored(spark, path)
    articles = store.read_store(spark, path)
    index = segments.create_index(articles, str(folder / "step-index"))
    updates = spark.createDataFrame([(3, "Berg und Tal")], "article_id long, summary string")
    change = store.change_articles(spark, path, updates=updates, deletes=spark.createDataFrame([(4,)], "article_id long"))
    index = segments.change_index(index, change.removed, change.added)
    articles = store.read_store(spark, path)
    for searched in (query("text"), query("berg")):
        assert rows_of(segments.all_hits(index, searched)) == rows_of(search.scan_scores(articles, searched))


def posting_batch(ids, titles):
    words = pa.array([t.split() for t in titles])
    columns = {"article_id": pa.array(ids), "_words_title": words, "_words_content": pa.array([["x"]] * len(ids))}
    return segments._rows_of_batch(pa.RecordBatch.from_pydict(columns), 4)


def test_posting_rows_come_in_sorted_runs_of_bounded_size(monkeypatch):
    parts = [posting_batch([i, i + 1], ["b a " + "a " * i, "c"]) for i in range(0, 40, 2)]
    monkeypatch.setattr(segments, "RUN_BYTES", 4 * parts[0].nbytes)
    monkeypatch.setattr(segments, "_SENT_ROWS", 7)
    rows = [row for part in segments._runs(iter(parts)) for row in part.to_pylist()]
    keys = [(row["term"], -row["impact"], row["range"]) for row in rows]
    falls = sum(a > b for a, b in zip(keys, keys[1:], strict=False))
    assert 1 <= falls < 5
    assert sorted(map(str, rows)) == sorted(str(row) for part in parts for row in part.to_pylist())


def test_merged_rows_hold_live_entries_of_all_places():
    old, new = posting_batch([0, 1, 2], ["a b", "a", "a"]), posting_batch([1, 3], ["a a", "a"])
    names = ["range", "term", *segments._ENTRY]
    batches = []
    for place, rows in enumerate((old, new)):
        table = rows.select(names).append_column("place", pa.array([place] * rows.num_rows, pa.int32()))
        batches.append(table.select([*names, "place"]))
    nothing = {name: pa.nulls(1, old.schema.field(name).type) for name in names}
    gone = nothing | {"range": pa.array([0]), "ids": pa.array([[1, 2]]), "place": pa.array([1], pa.int32())}
    batches.append(pa.RecordBatch.from_pydict(gone))
    merged = {row["term"]: row for row in segments._rows_without(batches, 4).to_pylist()}
    assert set(merged) == {"", "a", "b", "x"}
    assert merged["a"]["ids"] == [0, 1, 3]
    assert merged["a"]["title"] == [[0], [0, 1], [0]]
    assert merged["a"]["lens"] == [3, 3, 2]
    assert (merged["a"]["articles"], merged["a"]["occurrences"], merged["b"]["ids"]) == (3, 4, [0])
