"""Grouping that keeps later joins splittable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(rows: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """``rows.groupBy(*keys).agg(*aggregates)``, with the keys packed into one struct.

    Grouping by plain columns ties the group to the joins around it: it takes over
    a partitioning by fewer columns from a join before it, and a join by the same
    columns after it takes over its partitioning. Either way the join has no
    shuffle of its own on that side, and a skewed join is only split between
    two such shuffles. Packed keys keep them apart, so one key that
    holds a third of the rows is combined before the shuffle and split after it.
    """
    packed = F.struct(*keys).alias("_key")
    if not aggregates:
        return rows.select(packed).distinct().select("_key.*")
    return rows.groupBy(packed).agg(*aggregates).select("_key.*", "*").drop("_key")
