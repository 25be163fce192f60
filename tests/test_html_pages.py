"""Plain text of the test pages against the standard library's parser."""

import os
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom.functions.html import html_text

PAGES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")) / "pages.parquet"


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@pytest.mark.skipif(not PAGES.exists(), reason="no test tables")
def test_pages_equal_the_standard_parser(spark):
    rows = spark.read.parquet(str(PAGES)).select("page_id", "html", html_text(F.col("html")).alias("text")).collect()
    assert rows
    for row in rows:
        parser = Text()
        parser.feed(row.html)
        parser.close()
        assert row.text == "".join(parser.parts), row.page_id
