"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.llm import (
    decontaminate,
    exact_dedup,
    hard_negatives,
    line_dedup,
    merkle,
    mixing,
    passages,
    quality,
    secret_scan,
    sharding,
    simhash_dedup,
    token_counts,
    topk_search,
)
from recall.plans.checkpoint import durable, scratch_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return line_dedup.drop_boilerplate(pages, line_dedup.html_lines(F.col("html")), line_dedup.host(F.col("url")))


def op2_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return topk_search.top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = durable(quality.features(_table(spark, folder, "documents")))
    held_out = quality.held_out(F.col("doc_id"))
    model = quality.fit(found, _table(spark, folder, "labels").where(~held_out))
    return quality.scored(found, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "lang", mixing.words(F.col("text")).alias("tokens"))
    docs = durable(mixing.with_topic(docs, _table(spark, folder, "embeddings"), "doc_id", "vec_id", "label"))
    return mixing.mixed(docs, F.col("tokens"), F.col("doc_id"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.sharded(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(_table(spark, folder, "documents")))


def op8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.near_duplicate_passages(_table(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers  # the other queries do without vocabularies

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, folder, "documents"), tokenizer, scratch_folder(spark))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(_table(spark, folder, "embeddings"), vec_id % 50 == 0, moved)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    source, lang, n_chars, text, doc_id = (F.col(c) for c in ("source", "lang", "n_chars", "text", "doc_id"))
    docs = _table(spark, folder, "documents").withColumn("leaf", merkle.leaf(doc_id, source, lang, n_chars, text))
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    claimed = F.when(tampered, merkle.leaf(doc_id, source, lang, n_chars + 1, text)).otherwise(F.col("leaf"))
    return merkle.manifest(docs.withColumn("claimed", claimed), claimed_column="claimed").select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_topk_search,
        op3_quality,
        op4_mixing,
        op5_sharding,
        op6_simhash_dedup,
        op7_secret_scan,
        op8_passages,
        op9_token_counts,
        op10_decontaminate,
        op11_exact_dedup,
        op12_hard_negatives,
        op13_merkle_manifest,
    )
}
