import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import language, subwords, toxicity

SOUNDS = {"xx": "ka to mi ra", "yy": "schu berg ung hei", "zz": "eau ille ment tré"}


def sentence(pick, name, n):
    parts = SOUNDS[name].split()
    return " ".join("".join(pick.choices(parts, k=pick.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    pick = random.Random(1)
    rows = [(i, sentence(pick, name, pick.randint(3, 60)), name) for i, name in enumerate(list(SOUNDS) * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_language_of_held_out_texts(spark, spoken):
    found = language.fit(spoken.filter("doc_id % 4 != 2"))
    rows = language.identify(spoken.filter("doc_id % 4 = 2"), found).collect()
    assert found.languages == ["xx", "yy", "zz"]
    assert np.mean([r.language.lang == r.lang for r in rows]) > 0.97
    assert all(0 <= r.language.score <= 1 for r in rows) and not any(r.language.rejected for r in rows)


def test_odd_texts_and_clashing_names(spark, spoken):
    found = language.fit(spoken)
    odd = [(1, None), (2, ""), (3, "123 !? 45"), (4, "KATOMI rakato " * 20_000), (4, "tokara mikato"), (None, "schuberg ung")]
    table = spark.createDataFrame([(i, t, "x") for i, t in odd], "doc_id long, text string, language string")
    added = language.identify(table, found)
    assert added.columns == ["doc_id", "text", "language", "language_"]
    got = {r.text: r.language_ for r in added.collect()}
    for t in (None, "", "123 !? 45"):
        assert (got[t].lang, got[t].score, got[t].rejected) == ("und", 0.0, True)
    assert [got[t].lang for t in (odd[3][1], odd[4][1], odd[5][1])] == ["xx", "xx", "yy"]
    kept = language.keep_identified(table, found)
    assert kept.columns == table.columns and kept.count() == 3
    assert language.keep_identified(table.limit(0), found).count() == 0


def test_nothing_learned_means_undetermined(spark, spoken):
    for training in (spoken.limit(0), spoken.withColumn("lang", F.lit(None).cast("string"))):
        rows = language.identify(spoken, language.fit(training)).select("language.*").distinct().collect()
        assert [tuple(r) for r in rows] == [("und", 0.0, True)]
    one = language.fit(spoken.filter("lang = 'xx'"))
    assert {r.lang for r in language.identify(spoken, one).select("language.lang").collect()} == {"xx"}


def test_unlike_texts_are_rejected(spark, spoken):
    found = language.fit(spoken)
    mixed = " ".join(sentence(random.Random(9), name, 40) for name in SOUNDS)
    rows = language.identify(spark.createDataFrame([(mixed,)], "text string"), found._replace(least=0.999)).collect()
    assert rows[0].language.rejected


def test_fitted_cuts_reject_the_unlearned_and_keep_short_texts(spark, spoken):
    found = language.fit(spoken)
    pick = random.Random(11)
    noise = [
        " ".join("".join(pick.choices("bcdfghjklmnpqrstvwxyz", k=pick.randint(3, 8))) for _ in range(n)) for n in (6, 40, 400)
    ]
    unlearned = ["пошли вчера вечером смотреть новое кино " * n for n in (1, 30)]
    unlearned += ["wczoraj wieczorem poszliśmy zobaczyć nowy film " * n for n in (1, 30)]
    clean = [sentence(pick, name, n) for name in SOUNDS for n in (4, 8, 30, 300)]
    clean.append(sentence(pick, "xx", 5) + " katomi" * 5_000)
    table = spark.createDataFrame([(t,) for t in noise + unlearned + clean], "text string")
    rows = table.select("text", language.identified(F.col("text"), found).alias("got")).collect()
    assert {r.text for r in rows if r.got.rejected} == {*noise, *unlearned}


WORDS = ["stupid", "moron", "loser"]


@pytest.fixture(scope="module")
def labelled(spark):
    pick = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        words = sentence(pick, "xx", pick.randint(20, 90)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(words) // 12)):
                words[pick.randrange(len(words))] = pick.choice(WORDS)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(docs, "doc_id long, text string").cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxicity_of_held_out_texts_and_misspellings(spark, labelled):
    docs, labels = labelled
    found = toxicity.fit(docs, labels.filter("doc_id % 7 != 0"))
    scored = docs.filter("doc_id % 7 = 0").join(labels, "doc_id")
    rows = scored.select("toxic", toxicity.toxicity(F.col("text"), found).alias("score")).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in rows]) > 0.93
    misspelt = ["katomi stupidd rakato moronn " * 3, "katomi rakato mito toka " * 3]
    table = spark.createDataFrame([(t,) for t in misspelt], "text string")
    bad, good = (r[0] for r in table.select(toxicity.toxicity(F.col("text"), found)).collect())
    assert bad > 0.5 > good


def test_toxicity_of_odd_texts(spark, labelled):
    docs, labels = labelled
    found = toxicity.fit(docs, labels)
    table = spark.createDataFrame([(1, None), (1, ""), (2, "katomi " * 50_000)], "doc_id long, text string")
    scores = {r[0]: r[1] for r in table.select(F.length("text"), toxicity.toxicity(F.col("text"), found)).collect()}
    assert scores[None] < 0.5 and scores[0] < 0.5 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.keep_clean(table, found).columns == table.columns
    assert toxicity.keep_clean(table.limit(0), found).count() == 0


def test_samples_are_bounded_whatever_repeats(spark, spoken, labelled, monkeypatch):
    seen = []
    real = language.sample_features

    def counted(sample, *rest):
        features, labels = real(sample, *rest)
        seen.append(len(labels))
        return features, labels

    monkeypatch.setattr(language, "sample_features", counted)
    monkeypatch.setattr(toxicity, "sample_features", counted)
    same = spark.range(300).selectExpr("CAST(NULL AS long) AS doc_id", "'ka to mi' AS text", "'xx' AS lang")
    language.fit(spoken.union(same), sample=40)
    docs, labels = labelled
    again = spark.range(300).selectExpr("CAST(5 AS long) AS doc_id", "'ka ' || id AS text")
    toxicity.fit(docs.union(again), labels, sample=60)
    assert seen == [120, 120]


def test_one_label_alone_gives_its_share(spark, labelled):
    docs, labels = labelled
    assert toxicity.fit(docs, labels.limit(0)) == (None, 0.0)
    assert toxicity.fit(docs, labels.filter("toxic = 0")) == (None, 0.0)
    assert toxicity.fit(docs, labels.filter("toxic = 1")) == (None, 1.0)
    nulls = labels.select(F.lit(None).cast("long").alias("doc_id"), "toxic")
    assert toxicity.fit(docs, nulls) == (None, 0.0)
    table = docs.limit(3).select(toxicity.toxicity(F.col("text"), toxicity.Detector(None, 0.25)))
    assert [r[0] for r in table.collect()] == [0.25] * 3


def test_grams_stay_within_words():
    grams = subwords.Grams((3,), 20, False)
    texts = pa.array(["ab cd", "cd", "ab", " ab  cd "])
    found = [set(ids.tolist()) for ids, _ in subwords.text_features(texts, grams)]
    assert found[0] == found[1] | found[2] == found[3] and not found[1] & found[2]
