"""Scope, type and time filters, and lookups by id or by content."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall.functions.times import literal
from recall.operators.scope import earliest_in_scope
from recall.plans.grouping import grouped
from recall.schema import MEMORY_TYPES, SCOPE


@dataclass(frozen=True)
class MemoryFilter:
    """Seven optional conjuncts. An unset one means "any", not "only rows without a value"."""

    user_id: str = ""
    agent_id: str = ""
    app_id: str = ""
    run_id: str = ""
    memory_type: str = ""
    since: datetime | None = None
    until: datetime | None = None

    def condition(self, time_type: T.DataType = T.TimestampType()) -> Column:
        """One column of plain comparisons, which Spark pushes into the Parquet scan.

        Times are compared in the type of the stored column: converting the column
        instead would keep the comparison from being pushed down.
        """
        tests = [
            F.col(f.name) == getattr(self, f.name)
            for f in fields(self)
            if f.name not in ("since", "until") and getattr(self, f.name)
        ]
        if self.since is not None:
            tests.append(F.col("created_at") >= literal(self.since).cast(time_type))
        if self.until is not None:
            tests.append(F.col("created_at") <= literal(self.until).cast(time_type))
        return reduce(and_, tests, F.lit(True))

    def apply(self, memories: DataFrame) -> DataFrame:
        return memories.where(self.condition(memories.schema["created_at"].dataType))


def apply_filter(memories: DataFrame, flt: MemoryFilter | None) -> DataFrame:
    return memories if flt is None else flt.apply(memories)


def is_valid_type(c: Column) -> Column:
    """Membership in the closed set of types, case-sensitive; null is not a member."""
    return F.coalesce(c.isin(*MEMORY_TYPES), F.lit(False))


def of_type(memories: DataFrame, memory_type: str) -> DataFrame:
    return memories.where(F.col("memory_type") == memory_type)


def with_embedding(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("embedding").isNotNull())


def lookup_ids(ids: DataFrame, memories: DataFrame) -> DataFrame:
    """Every requested id with its memory, and ``found`` telling whether there is one."""
    return ids.select("id").join(memories.withColumn("found", F.lit(True)), "id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def lookup_hashes(
    lookups: DataFrame, memories: DataFrame, flt: MemoryFilter | None = None
) -> DataFrame:
    """Earliest memory with the wanted content hash in the wanted scope.

    ``lookups`` has ``content_hash`` and any of the scope columns; missing scope
    columns and '' mean "any". ``id`` is null where nothing matches. The type and
    time parts of ``flt`` hold for all lookups.
    """
    missing = [c for c in SCOPE if c not in lookups.columns]
    wanted = lookups.withColumns({c: F.lit("") for c in missing})
    candidates = (
        apply_filter(memories, flt)
        .join(grouped(lookups, ["content_hash"]), "content_hash", "left_semi")
        .withColumn("_first", F.struct("created_at", "id"))
    )
    earliest = earliest_in_scope(candidates, "_first").select(
        "content_hash", *SCOPE, F.col("first.id").alias("id"), F.col("first.created_at").alias("created_at")
    )
    return wanted.join(earliest, ["content_hash", *SCOPE], "left").drop(*missing)
