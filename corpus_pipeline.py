"""From raw documents to shards: quality, near duplicates, benchmark leaks, mixture, order.

Each stage takes the table that the one before it wrote and decides on every row of it. All but the last return
the columns of their input, extra ones too. Null and empty texts are texts without words: the classifier
judges them by that, the other stages let them pass as such. Empty tables pass all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.llm import decontaminate, mixing, quality, sharding, simhash_dedup
from recall.plans.checkpoint import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _whole(docs: DataFrame) -> Column:
    """``row``: all columns of a row as one, so that none clashes with a stage's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts; it learns from the labels of the fold that is not held out."""
    labels = _table(spark, sf_dir, "labels")
    found = durable(quality.features(docs))
    model = quality.fit(found, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, a null id being the largest.

    Rows are known by id and text, so rows of one id with unlike texts are different ones; of rows that agree in both one stays.
    """
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    named = docs.select(name.alias("name"), F.col("text"), _whole(docs))
    groups = simhash_dedup.near_duplicates(named.select("name", "text"), id_column="name")
    stay = groups.select(F.col("component_id").alias("name")).distinct()
    kept = named.select("name", "row").join(stay, "name", "left_semi").groupBy("name").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*")


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no item of the benchmark leaked."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose words have tempered shares by source, language and topic.

    The topic of a document is the label of the vector with its id, where there is one.
    """
    weighed = docs.select(_whole(docs), "doc_id", "source", "lang", mixing.words(F.col("text")).alias("words"))
    weighed = mixing.with_topic(weighed, _table(spark, sf_dir, "embeddings"), "doc_id", "vec_id", "label")
    return mixing.mixed(weighed, F.col("words"), F.col("doc_id")).where("taken").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle what is left and place it: adds ``shard`` and ``slot``."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", no_leaks),
    ("mixing", mixture),
    ("sharding", shard),
]

#: Learned models and sketches have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the table that the one before it wrote."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
