"""A training corpus from the documents table: recognised, clean, distinct, mixed and packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import jaccard, language, mixing, packing, toxicity
from newsloom.llm.queries import fold, table, tokenizer_file
from newsloom.llm.texts import free_name
from newsloom.plans.staging import staged

# Whole texts travel to Python: so many rows at once bound what a worker and its executor hold.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without a letter go."""
    _small_batches(spark)
    found = language.fit(docs.filter(fold(4) != 2))
    return language.keep_identified(docs, found)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model of the labelled ones among them."""
    _small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(fold(5) != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row: the one with the least id, of equal ids by a hash of the text.

    Rows without an id come after all others; of a group of such rows one stays. A row of a repeated id stands
    for its own text. Texts without words are no duplicates. Of rows equal in id and text one stays.
    """
    _small_batches(spark)
    key, least, place = (free_name(docs.columns, wish) for wish in ("row_key", "least", "place"))
    # Texts of one order: the id moved above zero, filled to a fixed width, then the text's hash.
    moved = F.col("doc_id").cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    number = F.lpad(moved.cast("decimal(20,0)").cast("string"), 20, "0")
    code = F.lpad(F.hex(F.xxhash64("text")), 16, "0")
    keyed = docs.withColumn(key, F.concat(F.coalesce(number, F.lit("~")), F.lit(":"), code))
    groups = jaccard.jaccard_components(keyed, key=key)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(least)).distinct()
    rows = keyed.join(staged(kept), F.col(key) == F.col(least), "left_semi")
    same = Window.partitionBy(key).orderBy("text")
    return rows.withColumn(place, F.row_number().over(same)).filter(F.col(place) == 1).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    _small_batches(spark)
    return mixing.mixture(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token windows."""
    _small_batches(spark)
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language", recognised),
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("mixing", mixed),
    ("packing", packed),
]

# The classifiers are no SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
