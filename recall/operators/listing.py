"""Newest-first pages, totals, and the newest rows of every scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall.operators.filters import MemoryFilter, apply_filter
from recall.plans.checkpoint import durable
from recall.schema import DEFAULT_PAGE, SEEDS_PER_SCOPE, positive_or


def newest_first() -> list:
    """Sort order of lists; ids settle equal times."""
    return [F.desc("created_at"), F.asc("id")]


def without_embedding(memories: DataFrame) -> DataFrame:
    """Shape shown to callers; also keeps the vectors out of the scan."""
    return memories.drop("embedding")


#: Rows up to the end of a page that one task may sort out.
SHALLOW = 100_000


def page(
    memories: DataFrame, flt: MemoryFilter | None = None, limit: int | None = None, offset: int = 0, shallow: int = SHALLOW
) -> DataFrame:
    """Newest rows from ``offset`` on. Pages that end beyond ``shallow`` rows are found by :func:`deep_page`."""
    rows, limit, offset = without_embedding(apply_filter(memories, flt)), positive_or(limit, DEFAULT_PAGE), max(offset, 0)
    if offset + limit > shallow:
        return deep_page(rows, limit, offset)
    return rows.orderBy(*newest_first()).offset(offset).limit(limit)


def deep_page(memories: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page anywhere in the list, without the rows before it ever meeting in one task.

    Times and ids are range partitioned and counted by partition; only the partitions that the page lies in
    are ranked, and wide columns are fetched for the page alone.
    """
    order = newest_first()
    narrow = memories.select("created_at", "id").repartitionByRange(*order).select("created_at", "id", F.spark_partition_id().alias("_part"))
    placed = durable(narrow)
    # One row per shuffle partition.
    sizes = sorted(tuple(r) for r in placed.groupBy("_part").count().collect())
    before, touched = 0, []
    for part, size in sizes:
        if before < offset + limit and before + size > offset:
            touched.append((part, before))
        before += size
    if not touched:
        return memories.limit(0)
    starts = F.create_map(*(F.lit(x) for pair in touched for x in pair))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + starts[F.col("_part")]
    inside = placed.where(F.col("_part").isin([part for part, _ in touched])).withColumn("_place", rank)
    wanted = durable(inside.where((F.col("_place") > offset) & (F.col("_place") <= offset + limit)).select("id"))
    return memories.join(F.broadcast(wanted) if limit <= SHALLOW else wanted, "id", "left_semi")


def total(memories: DataFrame, flt: MemoryFilter | None = None) -> DataFrame:
    """Number of rows behind a page, before its limit."""
    return apply_filter(memories, flt).agg(F.count("*").alias("total"))


#: Parts of a scope that are ranked by themselves first.
SALTS = 64


def newest_per_scope(
    memories: DataFrame, scope: Sequence[str], n: int = SEEDS_PER_SCOPE
) -> DataFrame:
    """The ``n`` newest rows of every scope, with ``position`` from 1.

    Ranks are taken on scope, time and id alone, first within parts of each scope and then among the parts' best, so
    a scope that holds much of the table is ranked by many tasks, and the last one sees at most
    ``n`` rows of each part. Wide columns are fetched afterwards.
    """
    names = [*scope, "created_at", "id"]
    narrow = memories.select(*names, F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("_part"))
    by_part = Window.partitionBy(*scope, "_part").orderBy(*newest_first())
    parted = narrow.withColumn("_place", F.row_number().over(by_part)).where(F.col("_place") <= n)
    by_scope = Window.partitionBy(*scope).orderBy(*newest_first())
    ranked = parted.withColumn("position", F.row_number().over(by_scope)).where(F.col("position") <= n)
    ranked = ranked.select(*names, "position")
    if set(memories.columns) <= set(names):
        return ranked
    return memories.join(durable(ranked.select("id", "position")), "id").select(*memories.columns, "position")
