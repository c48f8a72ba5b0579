"""Counts and time ranges over memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.operators.filters import MemoryFilter, apply_filter


def count_by_type(memories: DataFrame, flt: MemoryFilter | None = None) -> DataFrame:
    return apply_filter(memories, flt).groupBy("memory_type").agg(F.count("*").alias("total"))


def count_by_user(memories: DataFrame, flt: MemoryFilter | None = None) -> DataFrame:
    """One row per user: there is no bound on users, so this is a table, not a map in a row."""
    return apply_filter(memories, flt).groupBy("user_id").agg(F.count("*").alias("total"))


def time_range(memories: DataFrame, flt: MemoryFilter | None = None) -> DataFrame:
    """Oldest and newest creation time; null when nothing matches."""
    return apply_filter(memories, flt).agg(
        F.min("created_at").alias("oldest_at"), F.max("created_at").alias("newest_at")
    )


def summary(memories: DataFrame, flt: MemoryFilter | None = None) -> DataFrame:
    """One row: total, map of counts by type, oldest and newest. One scan.

    The map is bounded by the closed set of types.
    """
    by_type = (
        apply_filter(memories, flt)
        .groupBy("memory_type")
        .agg(
            F.count("*").alias("n"),
            F.min("created_at").alias("oldest_at"),
            F.max("created_at").alias("newest_at"),
        )
    )
    return by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("memory_type", "n")))).alias("by_type"),
        F.min("oldest_at").alias("oldest_at"),
        F.max("newest_at").alias("newest_at"),
    )
