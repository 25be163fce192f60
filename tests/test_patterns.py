import random

from pyspark.sql import functions as F

from newsloom.operators import patterns as patterns_module
from newsloom.operators.patterns import letter_grams, matched_patterns

TEXTS = "page string, title string, url string"


def matches(spark, rows, words):
    texts = spark.createDataFrame(rows, TEXTS)
    patterns = spark.createDataFrame([(w,) for w in words], "keyword string")
    found = matched_patterns(texts, patterns, key="page", columns=["title", "url"])
    assert found.columns == ["page", "keyword"]
    return sorted(((r.page, r.keyword) for r in found.collect()), key=str)


def expected(rows, words):
    found = [
        (page, word)
        for page, *texts in rows
        for word in set(words)
        if word and any(word.lower() in text.lower() for text in texts if text is not None)
    ]
    return sorted(found, key=str)


def test_random_texts_equal_plain_search(spark):
    rng = random.Random(5)
    letters = "abcé 😀"

    def text(low, high):
        return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

    rows = [(f"p{i % 70}", text(0, 60), text(0, 12)) for i in range(80)]
    words = [text(1, 6) for _ in range(300)]
    assert matches(spark, rows, words) == expected(rows, words)


def test_odd_texts_and_keywords(spark):
    long = "x" * 40_000 + "needle"
    rows = [(None, "One", None), ("a", None, None), ("b", "", "ONE two"), ("c", long, "tw"), ("b", "", "ONE two")]
    words = [None, "", "one", "One", "two", "o", "tw", "needle", "xneedle", "onetwo", "absent", "x" * 5000]
    assert matches(spark, rows, words) == expected(rows, words)
    assert matches(spark, rows, []) == []
    assert matches(spark, [], ["one"]) == []


def test_a_key_of_most_rows_does_not_multiply_them(spark):
    texts = spark.range(3000).select(
        F.lit(None).cast("string").alias("page"), F.concat(F.lit("word "), F.col("id")).alias("title"), F.lit("u").alias("url")
    )
    patterns = spark.createDataFrame([("word 29",), ("u",)], "keyword string")
    found = matched_patterns(texts, patterns, key="page", columns=["title", "url"])
    got = [r.keyword for r in found.collect()]
    assert got.count("u") == 3000
    assert got.count("word 29") == len(got) - 3000 == 111


def test_many_keywords_from_a_table(spark):
    texts = spark.range(300).select(F.col("id").alias("page"), F.concat(F.lit("item-"), F.col("id") * 17, F.lit("-end")).alias("title"))
    patterns = spark.range(5000).select(F.concat(F.lit("M-"), F.col("id"), F.lit("-")).alias("keyword"))
    found = matched_patterns(texts, patterns, key="page", columns=["title"])
    assert {(r.page, r.keyword) for r in found.collect()} == {(i, f"M-{i * 17}-") for i in range(300) if i * 17 < 5000}


def test_grams_of_a_text(spark):
    row = spark.createDataFrame([("ab😀a",), ("",), (None,)], "t string").select(letter_grams(F.col("t")).alias("g")).collect()
    assert sorted(row[0].g) == sorted(["a", "b", "😀", "ab", "b😀", "😀a", "ab😀", "b😀a"])
    assert [g for g in row[1].g if g] == []
    assert not row[2].g


def test_candidates_are_not_shuffled(spark):
    texts = spark.range(100).select(F.col("id").alias("page"), F.concat(F.lit("item"), F.col("id")).alias("title"))
    words = spark.range(100).select(F.concat(F.lit("m"), F.col("id")).alias("keyword"))
    found = matched_patterns(texts, words, key="page", columns=["title"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange ") == 1


def test_every_text_meets_every_block_once(spark, monkeypatch):
    monkeypatch.setattr(patterns_module, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(patterns_module, "SPLIT_ROWS", 20)
    monkeypatch.setattr(patterns_module, "_MATCHES", 7)
    rng = random.Random(6)
    rows = [(f"p{i}", "".join(rng.choice("abcdé") for _ in range(30)), None) for i in range(60)]
    words = ["".join(rng.choice("abcdÉ") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    assert matches(spark, rows, words) == expected(rows, words)
