import datetime as dt
import html

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.functions.html import escaped, html_text
from newsloom.operators.digest import digest_lines, html_entries, html_page, write_digest
from newsloom.operators.summaries import prompt, summarise, token_rate


def values(spark, column, rows, schema):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {schema}")
    return [r.o for r in frame.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text_columns(spark):
    assert values(spark, lambda c: t.shorten(c, 3), ["abc", "abcd", None], "string") == ["abc", "abc...", None]
    assert values(spark, t.line_breaks, ["a\nb", None], "string") == ["a<br>\nb", ""]
    assert values(spark, t.iso_to_day, ["2025-01-02T10:00:00", "2025-01-02"], "string") == ["02/01/2025", None]
    assert values(spark, t.percent_text, [0.4367, 1.0, 0.00049, 0.0025, 0.4365], "double") == [
        f"{x * 100:.1f}" for x in (0.4367, 1.0, 0.00049, 0.0025, 0.4365)
    ]
    assert values(spark, t.whole_percent, [0.5, 0.29, 1.0], "double") == ["50%", "28%", "100%"]
    assert values(spark, t.epoch_text, [1737000000.0], "double") == ["2025-01-16T04:00:00"]
    moments = [dt.datetime(2025, 1, 1, 12), dt.datetime(2025, 7, 1, 22, 30), None]
    assert values(spark, t.local_datetime, moments, "timestamp") == [
        "01/01/2025 à 13:00",
        "02/07/2025 à 00:30",
        "N/A",
    ]


def test_wall_clock(spark):
    rows = ["2025-09-23T15:31:04.446738146Z", "2025-09-23T15:31:04+02:00", "2025-09-23 15:31:04", "soon", None]
    expected = dt.datetime(2025, 9, 23, 15, 31, 4)
    assert values(spark, t.wall_clock, rows, "string") == [expected, expected, expected, None, None]


def test_clean_summary(spark):
    rows = [
        ' "Voici un résumé : Résumé : texte" ',
        "L'article explique que ça\n",
        "Résumé :\tL'article explique que x",
        "Résumé : Voici un résumé : y",
        "un Résumé : z",
        '""',
    ]
    assert values(spark, t.clean_summary, rows, "string") == ["texte", "ça", "x", "Voici un résumé : y", "un Résumé : z", ""]


def test_prepare_text(spark):
    frame = spark.createDataFrame([("Le chat, et la souris : l'été !",)], "v string")
    assert t.prepare_text(frame, "v", "w", ["le", "la", "et", "l"]).first().w == "chat souris été"
    assert "chat souris" in t.prepare_text(frame, "v", "w").first().w


@pytest.mark.parametrize(
    "markup, plain",
    [
        ("<p>Hello <b>world</b></p>", "Hello world"),
        ("a &lt;b&gt; &amp;amp; &eacute;&#233;&#xE9;&nbsp;x", "a <b> &amp; ééé\xa0x"),
        ('<a title="x > y" href=\'z>\'>link</a>', "link"),
        ("<!-- gone <b> -->kept<!DOCTYPE html>", "kept"),
        ("<SCRIPT type='x'>var t='</p>';</SCRIPT>in<style>p{}</style>out", "inout"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<b>&am</b>p;", "&amp;"),
        ("plain", "plain"),
        ("", ""),
        (None, None),
    ],
)
def test_html_text(spark, markup, plain):
    frame = spark.createDataFrame([(markup,)], "v string")
    assert frame.select(html_text(F.col("v")).alias("o")).first().o == plain


def test_html_text_of_a_very_long_fragment(spark):
    body = "<p class='x'>word &amp; " * 20_000 + '<a href="' + "y" * 200_000 + '">end</a>'
    frame = spark.createDataFrame([(body,)], "v string")
    assert frame.select(html_text(F.col("v")).alias("o")).first().o == "word & " * 20_000 + "end"


def test_escaping(spark):
    text = "é, ç, €, <>& \"q\" 'a'"
    frame = spark.createDataFrame([(text,)], "v string")
    safe = frame.select(escaped(F.col("v")).alias("o")).first().o
    assert html.unescape(safe) == text and "<" not in safe


ARTICLES = [
    ("L'IA révolutionne la médecine", "https://domain.ntld", "Un résumé\nsuite", "60", "2025-01-01T20:30:00", "rss", 1),
    ("Énergie & <villes>", "https://domain2.ntld", None, "45", None, "rss", 2),
]
SCHEMA = "title string, link string, summary string, score string, published string, source string, position int"


def test_digest(spark, tmp_path):
    articles = spark.createDataFrame(ARTICLES, SCHEMA)
    lines = digest_lines(articles, ["ia", "agent"], 0.5, day="2025-02-03").orderBy("ord").collect()
    assert len(lines) == 3
    assert lines[0].line == (
        "Revue de presse - Résumé du 03/02/2025\n\nLes 2 derniers articles filtrés et résumés.\n"
        "Mots clés : ia, agent sur un seuil >= 50%"
    )
    assert lines[1].line == "Titre: L'IA révolutionne la médecine\nLien: https://domain.ntld\nUn résumé\nsuite\n---"
    assert lines[2].line.endswith("https://domain2.ntld\n\n---")
    empty = digest_lines(articles.filter("false"), ["test"], 0.3, day="2025-02-03").collect()
    assert len(empty) == 1 and "Les 0 derniers" in empty[0].line
    with pytest.raises(ValueError):
        digest_lines(articles, [], 1.5)
    write_digest(digest_lines(articles, ["x"], 0.5, day="2025-02-03"), str(tmp_path / "digest"))
    assert spark.read.parquet(str(tmp_path / "digest")).count() == 3


def test_html_digest(spark):
    articles = spark.createDataFrame(ARTICLES, SCHEMA).withColumn(
        "dt_created", F.lit(dt.datetime(2025, 1, 2, 8))
    )
    blocks = {r.ord: r.block for r in html_entries(articles).collect()}
    assert "L&#39;IA" in blocks[1] and "publié le 01/01/2025 - résumé du 02/01/2025 à 09:00" in blocks[1]
    assert "Un résumé<br>\nsuite" in blocks[1] and ">Énergie &amp; &lt;villes&gt;</a> - 45 %" in blocks[2]


def test_summaries(spark):
    articles = spark.createDataFrame(ARTICLES + [("T", "l", "a. b! c? d.", "1", "p", None, 3)], SCHEMA)

    def answer(prompts):
        return ['"Résumé : Mock summary"' for _ in prompts]

    got = summarise(articles, answer).collect()
    assert {r.summary for r in got if r.position != 2} == {"Mock summary"}
    assert {r.position: r.source for r in got}[3] == "unknown"
    assert summarise(articles, answer, limit=2).count() == 2
    assert summarise(articles, answer, limit=0).count() == 3
    assert summarise(articles, answer, limit=2).rdd.getNumPartitions() > 1


def test_prompt_and_rate(spark):
    frame = spark.createDataFrame([("Titre {x}", "Texte % $1", 2.0)], "a string, b string, s double")
    made = frame.select(prompt(F.col("a"), F.col("b"), "thème").alias("o")).first().o
    assert made.startswith("Tu es un expert en thème.") and made.endswith("Contenu : Texte % $1\n\nRésumé :")
    assert "\nTitre {x}\n" in made
    assert frame.select(*token_rate(F.col("b"), F.col("s"))).first() == (3, 1.5)


def test_html_page_has_a_heading_per_day(spark):
    articles = spark.createDataFrame(ARTICLES, SCHEMA).withColumns(
        {"dt_created": F.lit(dt.datetime(2025, 1, 2, 8)), "day": F.lit("02/01/2025"), "score": F.lit("45 %")}
    )
    rows = html_page(articles, ["IA", "a & b"], 0.5).orderBy("ord").collect()
    assert rows[0].ord == -1 and rows[0].digest_day == "02/01/2025"
    for part in ("02/01/2025", f"Les {len(ARTICLES)} derniers articles", "IA, a &amp; b", "50%"):
        assert part in rows[0].block
    assert all(" - 45 %</h3>" in r.block for r in rows[1:]) and len(rows) == 1 + len(ARTICLES)


def test_a_day_of_a_written_digest_has_one_file_however_its_rows_came(spark, tmp_path):
    lines = spark.range(60).repartition(6).selectExpr("'d' || id % 5 AS digest_day", "id AS ord", "'line ' || id AS line")
    write_digest(lines, str(tmp_path / "digest"))
    files = [len(list(day.glob("*.parquet"))) for day in (tmp_path / "digest").glob("digest_day=*")]
    assert files == [1] * 5
    read = spark.read.parquet(str(tmp_path / "digest")).select(*lines.columns)
    assert sorted(read.collect()) == sorted(lines.collect())
