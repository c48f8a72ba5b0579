"""Dense global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall.plans.checkpoint import durable

NUMBER = "row_number"


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` from 0 without gaps, in the order of ``order``; and their count.

    Nulls come first. Rows equal in ``order`` follow a hash of all their columns; rows equal in
    everything are interchangeable. One range shuffle sorts the rows; only the sizes of its
    partitions are gathered, so nothing but these counts meets in one task. A last sort key of the
    rows' places in the input lets any number of equal rows spread over partitions. The rows travel as
    one struct, so their columns may have any names but ``row_number``.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    plain = rows.select(F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("tie"), F.monotonically_increasing_id().alias("place"))
    keys = [F.col("row")[c].asc_nulls_first() for c in order] + [F.col("tie"), F.col("place")]
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = durable(plain.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.spark_partition_id().alias("part"), index.alias("index")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))))
    count = offsets.agg(F.sum("size")).first()[0] or 0
    # One row per shuffle partition: small however large the table is.
    joined = placed.join(F.broadcast(offsets.drop("size")), "part")
    return joined.select("row.*", (F.col("before") + F.col("index")).alias(NUMBER)), count
