"""Views over the driver's tables that the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.functions import text
from recall.schema import CODE_PATTERN, CONVERSATION, CORRECTION, DECISION, FACT

TYPE_OF_EVENT = {
    "view": FACT,
    "click": CONVERSATION,
    "purchase": DECISION,
    "signup": CODE_PATTERN,
    "error": CORRECTION,
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def memories(spark: SparkSession, folder: str) -> DataFrame:
    """One memory per document, with scope, time and metadata of the event of the same number."""
    # Hashed before the join, so that the texts stay behind where they are not asked for.
    d = table(spark, folder, "documents").withColumn("content_hash", text.content_hash(F.col("text")))
    e = table(spark, folder, "events").withColumnRenamed("user_id", "_user")
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    memory_type = F.create_map(*[F.lit(x) for pair in TYPE_OF_EVENT.items() for x in pair])[F.col("event_type")]

    def unset_if(condition, value):
        return F.when(condition, F.lit("")).otherwise(value)

    return (
        d.join(e, d.doc_id == e.event_id)
        .join(v, d.doc_id == v.vec_id, "left")
        .select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("text").alias("content"),
            memory_type.alias("memory_type"),
            unset_if(F.col("_user") % 5 == 0, F.concat(F.lit("u"), (F.col("_user") % 20).cast("string"))).alias("user_id"),
            unset_if(F.col("doc_id") % 3 == 0, F.col("lang")).alias("agent_id"),
            unset_if(F.col("doc_id") % 4 == 0, F.col("source")).alias("app_id"),
            unset_if(F.col("doc_id") % 2 == 0, F.concat(F.lit("run"), (F.col("doc_id") % 7).cast("string"))).alias("run_id"),
            F.replace("props", F.lit('"k"'), F.lit('"access_count"')).alias("metadata"),
            "content_hash",
            "embedding",
            F.col("ts").alias("created_at"),
            F.expr("ts + make_dt_interval(0, event_id % 240)").alias("updated_at"),
            "doc_id",
        )
    )


def event_memories(spark: SparkSession, folder: str) -> DataFrame:
    """One memory per event, all of them with a vector: texts and vectors come round again by the event's number.

    Agents are two, so a scope holds half of all rows.
    """
    e = table(spark, folder, "events")
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    # A text is hashed once, not for every event.
    d = table(spark, folder, "documents").select("doc_id", "text", text.content_hash(F.col("text")).alias("content_hash"))
    # Of empty tables nothing is met.
    places = {"vec_id": max(v.count(), 1), "doc_id": max(d.count(), 1)}
    e = e.withColumns({name: F.pmod("event_id", F.lit(count)) for name, count in places.items()})
    memory_type = F.create_map(*[F.lit(x) for pair in TYPE_OF_EVENT.items() for x in pair])[F.col("event_type")]
    return e.join(v, "vec_id").join(d, "doc_id").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("text").alias("content"),
        memory_type.alias("memory_type"),
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("user_id"),
        F.concat(F.lit("a"), (F.col("event_id") % 2).cast("string")).alias("agent_id"),
        F.lit("").alias("app_id"),
        F.lit("").alias("run_id"),
        F.replace("props", F.lit('"k"'), F.lit('"access_count"')).alias("metadata"),
        "content_hash",
        "embedding",
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector of the embeddings table as a query."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


def conversation_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as an ingest batch, ordered by conversation and turn."""
    return table(spark, folder, "conversations").select(
        F.col("text").alias("content"),
        F.lit(CONVERSATION).alias("memory_type"),
        F.col("role").alias("agent_id"),
        F.col("conv_id").cast("string").alias("run_id"),
        "conv_id",
        "turn",
    )


def star_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """One sentence per fact of the star schema: ``memory_id, content``."""
    customer = table(spark, folder, "customer")
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    made = (
        table(spark, folder, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("s_name", "p_name")
        .distinct()
    )

    def sentence(df: DataFrame, subject: str, verb: str, object_: str) -> DataFrame:
        return df.select(F.concat(F.col(subject), F.lit(f" {verb} "), F.col(object_), F.lit(".")).alias("content"))

    lines = (
        sentence(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "belongs to", "n_name")
        .unionByName(
            sentence(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "belongs to", "n_name")
        )
        .unionByName(
            sentence(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "is part of", "r_name")
        )
        .unionByName(sentence(made, "s_name", "created", "p_name"))
    )
    # The sentences are distinct, so the hash of a sentence identifies it.
    return lines.select(F.substring(F.sha2("content", 256), 1, 16).alias("memory_id"), "content")


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("memory_id"), F.col("text").alias("content")
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as trait observations."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("key"),
        F.col("value").cast("string").alias("value"),
        "ts",
        F.col("event_id").alias("seq"),
    )
