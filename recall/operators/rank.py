"""Hybrid re-rank of search results by similarity, recency and frequency."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall.functions import metadata
from recall.functions.times import hours_between, instant
from recall.schema import HALF_LIFE_HOURS


@dataclass(frozen=True)
class Weights:
    similarity: float = 0.6
    recency: float = 0.25
    frequency: float = 0.15


def recency(updated_at: Column, now: Column, half_life: float = HALF_LIFE_HOURS) -> Column:
    """1 for just now (or later), halving with every half-life; non-positive half-lives are ignored."""
    hours = F.greatest(F.lit(0.0), hours_between(updated_at, now))
    return F.pow(F.lit(2.0), -hours / F.lit(half_life if half_life > 0 else HALF_LIFE_HOURS))


def rerank(
    results: DataFrame,
    *,
    now: datetime | str | Column | None = None,
    weights: Weights = Weights(),
    half_life: float = HALF_LIFE_HOURS,
) -> DataFrame:
    """Score and order each query's result set.

    ``results`` has ``query_id``, ``id``, ``score``, ``updated_at`` and
    ``metadata``. Frequencies are relative to the largest in the same result set
    and at least 1. Both windows share one partitioning, hence one exchange.
    """
    result_set = Window.partitionBy("query_id")
    best_first = result_set.orderBy(F.desc_nulls_last("final_score"), F.asc("id"))
    uses = metadata.access_count(F.col("metadata"))
    return (
        results.withColumn("_uses", uses)
        .withColumns(
            {
                "similarity_score": F.col("score"),
                "recency_score": recency(F.col("updated_at"), instant(now), half_life),
                "frequency_score": F.col("_uses")
                / F.greatest(F.lit(1.0), F.max("_uses").over(result_set)),
            }
        )
        .withColumn(
            "final_score",
            F.lit(weights.similarity) * F.col("similarity_score")
            + F.lit(weights.recency) * F.col("recency_score")
            + F.lit(weights.frequency) * F.col("frequency_score"),
        )
        .withColumn("final_rank", F.row_number().over(best_first))
        .drop("_uses")
    )
