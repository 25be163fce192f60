from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from newsloom.llm import jaccard, language, mixing, queries, sql, toxicity
from newsloom.llm.queries import fold

duckdb = pytest.importorskip("duckdb")
TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, least string, copies int"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_operator_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in queries.queries()}
    assert set(queries.queries()) | {"pipeline"} <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "packing"]


@pytest.mark.parametrize("name", sql.oracle_sql())
def test_query_equals_its_sql(spark, database, name):
    frame = entry.queries()[name](spark, str(TABLES))
    columns = sorted(frame.columns)
    cursor = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert Counter(map(tuple, frame.select(*columns).collect())) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_queries_cover_their_tables(spark, name):
    frame = queries.queries()[name](spark, str(TABLES))
    key = "query_id" if name == "op2_neighbours" else "doc_id"
    got = {r[0] for r in frame.select(key).distinct().collect()}
    if key == "query_id":
        table = spark.read.parquet(f"{TABLES}/embeddings.parquet").filter("vec_id % 20 = 0").select("vec_id")
    else:
        table = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id")
    assert got == {r[0] for r in table.collect()}


def stages(spark, docs, folder):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], folder).cache())
    return out


def test_stages_decide_as_their_operators(spark):
    folder = str(TABLES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [(10_000, None, "en", "src0", 0), (10_001, "12 34", "en", "src0", 5), (None, "", None, None, None)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    start, known, clean, distinct, mixed, packed = stages(spark, docs, folder)
    for frame in (known, clean, distinct, mixed):
        assert frame.columns == docs.columns

    def ids(frame):
        return Counter(r[0] for r in frame.select("doc_id").collect())

    found = language.fit(start.filter(fold(4) != 2))
    rejected = {r.doc_id for r in language.identify(start, found).filter("language.rejected").collect()}
    assert {10_000, 10_001, None} <= rejected
    assert set(ids(known)) == set(ids(start)) - rejected

    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(fold(5) != 0)
    score = toxicity.toxicity(F.col("text"), toxicity.fit(known, labels))
    assert set(ids(clean)) == {r.doc_id for r in known.filter(score < 0.5).collect()}

    groups = jaccard.jaccard_components(clean).collect()
    assert ids(distinct) == Counter({r.component_id for r in groups})

    often = {r.doc_id: r.copies for r in mixing.taken(distinct, mixing.mix(distinct)).collect()}
    assert ids(mixed) == Counter({k: n for k, n in often.items() if n})

    pieces = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in pieces} == {r.doc_id: r.t * ids(mixed)[r.doc_id] for r in pieces}
    assert {r.doc_id for r in pieces} == set(ids(mixed))


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, str(TABLES))
    assert rows.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and rows.count() > 0


def test_stages_take_odd_and_empty_tables(spark):
    rows = [
        (None, None, None, None, None, "x", 1), (1, "", "en", "a", 0, None, None), (2, "Ein Wort", "de", None, 8, "y", 2),
        (2, "Ein Wort", "de", None, 8, "y", 2), (3, "word " * 40_000, "en", "b", None, "z", 3), (4, "ein wort", "de", "b", 8, "z", 3),
    ]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, str(TABLES))
            if name != "packing":
                assert result.columns == docs.columns
            assert result.count() >= 0
    kept = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, SCHEMA), str(TABLES))
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "2", "3", "None"]


def test_one_row_of_each_group_stays(spark):
    """By row, not by id: near copies without an id, and a repeated id with another text."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    third = " ".join(f"y{i}" for i in range(60))
    texts = [(5, base), (None, base + " a"), (None, base + " b"), (None, "c " + base), (7, base + " d")]
    texts += [(None, other), (None, other + " e"), (None, other), (None, third + " f"), (None, third + " g")]
    texts += [(5, "z " + third), (-3, "one text of five words or more"), (-3, "one text of five words or more"), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, None, None) for i, t in texts], SCHEMA).repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, docs, str(TABLES)).collect()]
    assert Counter(i for i, _ in kept) == Counter([5, 5, -3, 10, None])
    assert (5, base) in kept and (5, "z " + third) in kept
