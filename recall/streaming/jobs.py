"""Continuous forms of ingest, triple extraction, traits and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from recall.operators.embed import Embedder, embed_texts, embedding_problem
from recall.operators.graph import writes_of
from recall.operators.ingest import ingest, memory_id, normalised, validate, with_hash
from recall.operators.maintain import REMOVED
from recall.operators.profile import observe
from recall.operators.triples import extract_triples
from recall.plans.checkpoint import discard, durable
from recall.schema import MEMORIES, SCOPE
from recall.sources import snapshots
from recall.streaming import dedup

#: Times in handed-through rows keep all their digits.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


#: Where Spark names the running stream; the name is kept in the checkpoint.
QUERY_ID = "sql.streaming.queryId"


def batch_name(spark: SparkSession, job: str, number: int) -> str:
    """Name of a micro-batch, for use in ``foreachBatch``.

    It holds the id of the stream's checkpoint. A restart from that checkpoint repeats the name;
    other streams, and a new checkpoint whose numbers begin at 0 again, have names of their own.
    """
    stream = spark.sparkContext.getLocalProperty(QUERY_ID)
    if not stream:
        raise ValueError("batches are named inside a running stream")
    return f"{job}-{stream}-{number}"


def _stored_since(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Stream of the table's rows that other writers added or changed; each file is read once."""
    rows = spark.readStream.schema(snapshots.ROWS).option("ignoreMissingFiles", True).parquet(f"{root}/rows")
    # Folders of the job's own batches are skipped: its state knows them.
    return rows.where(~F.col("batch").startswith(f"{job}-")).select("content_hash", *SCOPE, "id", "created_at")


def _own_name(spark: SparkSession, root: str, job: str, name: str, number: int) -> None:
    """Refuse a job name that another checkpoint has used on the table."""
    stream = name.removesuffix(f"-{number}")
    names = snapshots.read_rows(spark, root).select("batch").where(F.col("batch").startswith(f"{job}-")).distinct()
    if not names.where(~F.col("batch").startswith(f"{stream}-")).isEmpty():
        raise ValueError(f"job {job!r} has added to this table from another checkpoint; give the new stream a name of its own")


def ingest_stream(
    arriving: DataFrame, root: str, embedder: Embedder, *, order_by: Sequence[str], job: str = "stream"
) -> DataStreamWriter:
    """Writer that adds each micro-batch to the memories table at ``root``.

    Rows are deduplicated on keyed state (:mod:`recall.streaming.dedup`). The state learns of rows that were in the table before, and
    of what others write, from the table's files, each of which it reads once; a micro-batch reads no rows that were
    stored before it. A repeat of a memory that was deleted or changed since is compared with the table itself, as
    :func:`recall.operators.ingest.ingest` does.

    A micro-batch is written under its own name, so running it a second time gives the same table, and no
    other stream or checkpoint writes over it. Its duplicates and rejects are kept beside the table
    (:func:`recall.sources.snapshots.read_outcome`). Streams of one table need job names of their own; a second
    checkpoint with a used name is refused. The caller sets trigger and checkpoint folder, and starts it. The session's state store
    is set to RocksDB, without which keys cannot be looked up one by one; streams that have a checkpoint keep the one they have.
    """
    spark = arriving.sparkSession
    snapshots.create(spark, root)
    for key, value in dedup.STORE.items():
        spark.conf.set(key, value)
    checked = with_hash(validate(normalised(arriving)))
    if "id" not in arriving.columns:
        checked = checked.withColumn("id", memory_id(job, SCOPE))
    kept = checked.schema
    none = F.lit(None)
    arrival = [F.col(c).alias(f"arrival_{i}") for i, c in enumerate(order_by)]
    no_arrival = [none.cast(arriving.schema[c].dataType).alias(f"arrival_{i}") for i, c in enumerate(order_by)]
    asked = checked.withColumns(
        {
            "order": F.struct(F.lit(1).alias("source"), none.cast("timestamp").alias("created_at"), *arrival, F.col("id").alias("id")),
            "payload": F.to_json(F.struct(*(F.col(f"`{c}`") for c in kept.names)), JSON_TIMES),
            "refused": F.col("reason").isNotNull(),
        }
    )
    known = _stored_since(spark, root, job)
    known = known.withColumn("order", F.struct(F.lit(0).alias("source"), "created_at", *no_arrival, "id"))

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        name = batch_name(session, job, number)
        if number == 0:
            _own_name(session, root, job, name, number)
        # The state is asked once.
        asked_once = durable(batch)
        decided = asked_once.withColumn("row", F.from_json("payload", kept, JSON_TIMES))
        refused = decided.where("row.reason is not null").select("row.*")
        judged = decided.where("row.reason is null").select(*dedup.KEYS, "row", "duplicate_of", "waits")
        owner = F.max(F.coalesce("duplicate_of", "row.id")).alias("owner")
        owners = judged.where("not waits").groupBy(*dedup.KEYS).agg(owner)
        waiting = judged.where("waits").drop("duplicate_of").join(owners, dedup.KEYS).withColumnRenamed("owner", "duplicate_of")
        judged = judged.where("not waits").unionByName(waiting).select("row.*", "duplicate_of")
        repeated = judged.where("duplicate_of is not null")
        fresh = judged.where("duplicate_of is null").drop("duplicate_of")

        removed = snapshots.read_outcome(session, root, REMOVED)
        stale = None
        if removed is not None:
            gone = removed.select(F.col("id").alias("duplicate_of"), "content_hash").distinct()
            stale = durable(repeated.join(gone, ["duplicate_of", "content_hash"], "left_semi"))
            stale = None if stale.isEmpty() else stale
        vectors = embed_texts(fresh, embedder, key="content_hash")
        embedded = fresh.join(vectors, "content_hash", "left").withColumn("problem", embedding_problem(F.col("embedding"), embedder.dimensions))
        stamp = F.current_timestamp()
        new_rows = embedded.where("problem is null").withColumns({"created_at": stamp, "updated_at": stamp}).select(*MEMORIES.names)
        failed = embedded.where("problem is not null")
        columns = [F.col(f"`{c}`") for c in arriving.columns]
        rejects = refused.select(*columns, "reason").unionByName(failed.select(*columns, F.col("problem").alias("reason")))
        if stale is not None:
            repeated = repeated.join(gone, ["duplicate_of", "content_hash"], "left_anti")
            new_rows = durable(new_rows)
            store = snapshots.read_memories_before(session, root, name).unionByName(new_rows)
            again = ingest(stale.select(*columns), store, embedder, order_by=order_by, batch_id=name)
            new_rows = new_rows.unionByName(again.new_rows)
            rejects = rejects.unionByName(again.rejects)
        duplicates = repeated.select(*columns, "duplicate_of")
        if stale is not None:
            duplicates = duplicates.unionByName(again.duplicates)
        snapshots.write_outcome(rejects, root, "rejects", name)
        snapshots.write_outcome(duplicates, root, "duplicates", name)
        if not failed.isEmpty():
            # The state holds their ids though they were not stored.
            snapshots.write_outcome(failed.select("id", "content_hash"), root, REMOVED, name)
        snapshots.append_batch(new_rows, root, name)
        discard(asked_once, vectors)

    return dedup.verdicts(asked, known).writeStream.foreachBatch(add)


def triple_stream(texts: DataFrame) -> DataFrame:
    """Triples of a stream of texts; stateless, for append mode."""
    return extract_triples(texts)


def graph_stream(texts: DataFrame, root: str, order: str = "memory_id", job: str = "graph") -> DataStreamWriter:
    """Writer that adds the triples of each micro-batch to the graph at ``root``.

    A micro-batch writes what it found and reads nothing; ``order`` tells which text is later, in whatever batch it comes.
    :func:`recall.operators.graph.settled` makes the graph of what was written.
    """

    def add(batch: DataFrame, number: int) -> None:
        snapshots.append_writes(writes_of(batch, order), root, batch_name(batch.sparkSession, job, number))

    return texts.writeStream.foreachBatch(add)


def trait_stream(observations: DataFrame, seq: str = "seq") -> DataFrame:
    """Traits of a stream of observations, for update or complete mode.

    The order of arrival does not matter, so late observations need no watermark.
    """
    return observe(observations, seq)


def type_stats_stream(memories: DataFrame) -> DataFrame:
    """Count and time range by type; the state is one row per type."""
    return memories.groupBy("memory_type").agg(
        F.count("*").alias("total"),
        F.min("created_at").alias("oldest_at"),
        F.max("created_at").alias("newest_at"),
    )
