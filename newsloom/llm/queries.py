"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    brown,
    centroids,
    dialogue,
    fingerprints,
    jaccard,
    language,
    minhash,
    mixing,
    negatives,
    neighbours,
    packing,
    sharding,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(folds: int, key: str = "doc_id") -> Column:
    """The fold of a row; a row without id has the fold of an empty id."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def tokenizer_file() -> str:
    """The tokenizer the packing query is asked to use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@_query
def op1_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer_file())


@_query
def op2_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return neighbours.search(neighbours.build(vectors), vectors.filter("vec_id % 20 = 0"))


@_query
def op3_sharding(spark, folder):
    placed = sharding.shard(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op4_jaccard(spark, folder):
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@_query
def op5_dialogue(spark, folder):
    return dialogue.rotate(table(spark, folder, "conversations"))


@_query
def op6_toxicity(spark, folder):
    docs, held_out = table(spark, folder, "documents"), fold(5) == 0
    found = toxicity.fit(docs, table(spark, folder, "labels").filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(F.col("text"), found).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query
def op7_brown(spark, folder):
    docs, held_out = table(spark, folder, "documents"), fold(5) == 1
    model, counts = brown.fit(docs.filter(~held_out))
    return brown.scores(docs, model, counts).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity",
    )


@_query
def op8_language(spark, folder):
    docs, held_out = table(spark, folder, "documents"), fold(4) == 2
    found = language.fit(docs.filter(~held_out))
    guess = language.identified(F.col("text"), found)
    rows = docs.select("doc_id", held_out.alias("held_out"), guess.alias("guess"))
    return rows.select(
        "doc_id",
        "held_out",
        F.col("guess.lang").alias("lang_pred"),
        F.col("guess.score").alias("score"),
        F.col("guess.rejected").alias("rejected"),
    )


@_query
def op9_fingerprints(spark, folder):
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


@_query
def op10_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs)
    rows = mixing.taken(docs, mixed).drop("text")
    # At most mixing.MOST_PATTERNS sources.
    aims = [(s, round(float(t), 6)) for s, t in mixed.targets.items()]
    aims = spark.createDataFrame(aims, "name string, target double")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = aims.join(sizes, F.col("name").eqNullSafe(F.col("source"))).select("name", "target", "source_size")
    joined = rows.join(F.broadcast(aims), F.col("source").eqNullSafe(F.col("name")))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return joined.select("doc_id", "size", "source_size", "target", taken, "copies")


@_query
def op11_centroids(spark, folder):
    found = centroids.cluster(table(spark, folder, "embeddings"))
    return centroids.with_inertia(found).drop("compared")


@_query
def op12_negatives(spark, folder):
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved))


@_query
def op13_minhash(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))
