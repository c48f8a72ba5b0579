"""Batch add: validate, hash, deduplicate within scope, embed, stamp."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall.functions import metadata, text
from recall.functions.times import instant
from recall.operators.embed import Embedder, embed_texts, embedding_problem
from recall.operators.filters import is_valid_type
from recall.operators.scope import earliest_in_scope
from recall.plans.checkpoint import durable
from recall.plans.grouping import grouped
from recall.schema import MEMORIES, SCOPE

INVALID_TYPE = "invalid memory type"
EMPTY_CONTENT = "content cannot be empty"


@dataclass(frozen=True)
class IngestResult:
    """Outcome of one batch.

    ``new_rows`` has the memories schema, ``duplicates`` maps every repeated
    input row to the id it repeats, ``rejects`` has the input rows that were
    refused, with a reason. Each input row appears in exactly one of them.
    """

    new_rows: DataFrame
    duplicates: DataFrame
    rejects: DataFrame


def normalised(memories: DataFrame) -> DataFrame:
    """'' for unset scope dimensions, and an empty object for absent metadata."""
    out = {c: F.coalesce(c, F.lit("")) if c in memories.columns else F.lit("") for c in SCOPE}
    given = F.col("metadata") if "metadata" in memories.columns else F.lit(None).cast("string")
    return memories.withColumns({**out, "metadata": metadata.encoded(given)})


def rejection(memory_type: Column, content: Column) -> Column:
    """Reason to refuse a row, or null. The type is looked at first; blanks count as content."""
    return F.when(~is_valid_type(memory_type), F.lit(INVALID_TYPE)).when(
        F.coalesce(content, F.lit("")) == "", F.lit(EMPTY_CONTENT)
    )


def validate(batch: DataFrame) -> DataFrame:
    """The batch with a ``reason`` column, null for acceptable rows."""
    return batch.withColumn("reason", rejection(F.col("memory_type"), F.col("content")))


def with_hash(memories: DataFrame) -> DataFrame:
    return memories.withColumn("content_hash", text.content_hash(F.col("content")))


def dedup(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``first``: the smallest ``order`` among the rows each row's scope matches.

    A row is kept if that is its own ``order``. Otherwise it repeats the row
    with that ``order``, which is itself always a kept one: whatever that row
    repeated would match here as well, and be smaller still.
    """
    earliest = earliest_in_scope(
        rows.select("content_hash", *SCOPE, order), order, own_scopes_only=True
    )
    return rows.join(earliest, ["content_hash", *SCOPE])


def memory_id(batch_id: str, scope_row: Sequence[str]) -> Column:
    """Id in UUID layout, derived from content and scope.

    Within one batch at most one row per hash and scope is accepted, so the id is
    unique; being derived, it comes out the same when a lost task is run again.
    """
    parts = [F.lit(batch_id), F.col("content_hash"), *[F.col(c) for c in scope_row]]
    # Length prefixes keep ('ab','c') and ('a','bc') apart.
    digest = F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def ingest(
    batch: DataFrame,
    store: DataFrame,
    embedder: Embedder,
    *,
    order_by: Sequence[str],
    batch_id: str,
    now: datetime | str | Column | None = None,
) -> IngestResult:
    """Add a batch to a store.

    ``batch`` has ``content``, ``memory_type``, optionally the scope columns and
    ``metadata``, and the columns in ``order_by``, which give the order of arrival
    and must be unique together. ``batch_id`` must differ between batches. An ``id``
    column is taken as it is; without one, ids are derived.
    """
    stamp = instant(now)
    checked = with_hash(validate(normalised(batch)))
    if "id" not in batch.columns:
        checked = checked.withColumn("id", memory_id(batch_id, SCOPE))
    # Stored rows come first, by age; then the batch in its own order.
    arrival = [F.col(c).alias(f"arrival_{i}") for i, c in enumerate(order_by)]
    no_arrival = [
        F.lit(None).cast(batch.schema[c].dataType).alias(f"arrival_{i}") for i, c in enumerate(order_by)
    ]
    no_age = F.lit(None).cast("timestamp").alias("created_at")
    position = F.struct(F.lit(1).alias("source"), no_age, *arrival, "id")
    # The texts are hashed once; what follows reads narrow columns where it can.
    checked = durable(checked.withColumn("_order", position))
    refused = checked.where(F.col("reason").isNotNull())
    accepted = checked.where(F.col("reason").isNull())

    known = (
        store.select("content_hash", *SCOPE, "id", F.col("created_at").cast("timestamp").alias("created_at"))
        # Only stored rows whose text comes in again can decide anything.
        .join(grouped(accepted, ["content_hash"]), "content_hash", "left_semi")
        .select(
            "content_hash",
            *SCOPE,
            F.struct(F.lit(0).alias("source"), "created_at", *no_arrival, "id").alias("_order"),
        )
    )
    candidates = known.unionByName(accepted.select(known.columns))
    # The store is scanned once, for all three results.
    earliest = durable(earliest_in_scope(candidates, "_order", own_scopes_only=True))
    decided = accepted.join(earliest, ["content_hash", *SCOPE])
    is_new = F.col("first") == F.col("_order")

    # The model runs once per distinct new text.
    fresh = decided.where(is_new)
    vectors = embed_texts(fresh, embedder, key="content_hash")
    embedded = fresh.join(vectors, "content_hash", "left")
    problem = embedding_problem(F.col("embedding"), embedder.dimensions)
    new_rows = (
        embedded.where(problem.isNull())
        .withColumns({"created_at": stamp, "updated_at": stamp})
        .select(*MEMORIES.names)
    )
    not_embedded = embedded.where(problem.isNotNull()).withColumn("reason", problem)
    rejects = refused.select(*batch.columns, "reason").unionByName(
        not_embedded.select(*batch.columns, "reason")
    )
    duplicates = decided.where(~is_new).select(*batch.columns, F.col("first.id").alias("duplicate_of"))
    return IngestResult(new_rows, duplicates, rejects)
