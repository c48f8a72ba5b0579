"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

The global row number of a row is its rank in the order of its id. A Feistel network permutes a
domain a * b just above the row count n; images at or beyond n are sent through it again until they
fall below n (cycle walking), which permutes 0 .. n-1 itself. Position p of the shuffle is slot
p div s of shard p mod s, so shard sizes are at most one apart and slots have no gaps. Place and row
number follow from each other by arithmetic, without a look at the data.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.llm.numbering import NUMBER, numbered

ROUNDS = 6
SEED = "shuffle-1"
SHARDS = 16


def domain(count: int) -> tuple[int, int]:
    """Sides a and b of the smallest near-square domain of at least ``count`` values."""
    a = isqrt(max(count - 1, 0)) + 1
    return a, -(-max(count, 1) // a)


def _noise(value: Column, seed: str, turn: Column) -> Column:
    """52 bits of a digest of seed, round and value."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), turn.cast("string"), value.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _network(value: Column, count: int, seed: str, inverse: bool) -> Column:
    """One pass of the network; null stays null.

    A round adds noise of one half to the other, modulo its side, and swaps the halves.
    """
    a, b = domain(count)

    def side(turn: Column) -> Column:
        return F.when(turn % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")

    def forth(at: Column, turn: Column) -> Column:
        moved = F.pmod(at["l"] + _noise(at["r"], seed, turn), side(turn))
        return F.struct(at["r"].alias("l"), moved.alias("r"))

    def back(at: Column, turn: Column) -> Column:
        moved = F.pmod(at["r"] - _noise(at["l"], seed, turn), side(turn))
        return F.struct(moved.alias("l"), at["l"].alias("r"))

    halves = F.struct(((value - value % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (value % F.lit(b)).cast("long").alias("r"))
    turns = [F.lit(turn) for turn in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))]
    return F.aggregate(F.array(*turns), halves, back if inverse else forth, lambda at: at["l"] * b + at["r"])


def _walk_length(spark: SparkSession, count: int, seed: str) -> int:
    """Passes that the longest walk from a row number back below ``count`` needs after the first.

    Only walks through the at most sqrt(count) values beyond ``count`` are longer than one pass, so
    this looks at those whose predecessor is a row number.
    """
    a, b = domain(count)
    if a * b == count:
        return 0
    beyond = spark.range(count, a * b)
    entered = beyond.where(_network(F.col("id"), count, seed, inverse=True) < count).select("id")
    steps = 0
    while entered.limit(1).count():
        entered = entered.select(_network(F.col("id"), count, seed, inverse=False).alias("id")).where(F.col("id") >= count)
        steps += 1
    return steps


def permuted(rows: DataFrame, column: str, count: int, seed: str = SEED, inverse: bool = False) -> DataFrame:
    """Replace row numbers below ``count`` in ``column`` by shuffled positions (``inverse``: back)."""
    if not count:
        return rows
    rows = rows.withColumn(column, _network(F.col(column), count, seed, inverse))
    for _ in range(_walk_length(rows.sparkSession, count, seed)):
        beyond = F.when(F.col(column) >= count, F.col(column))
        rows = rows.withColumn(column, F.coalesce(_network(beyond, count, seed, inverse), column))
    return rows


def sharded(rows: DataFrame, id_column: str = "doc_id", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 .. shards-1) and ``slot`` (long, gapless from 0 in each shard).

    Every row gets a place of its own, repeated rows and rows with a null id (which sort first) too.
    Shard sizes differ by one at most. Columns named ``shard``, ``slot`` or ``row_number`` of the
    input are replaced; others may have any name and are kept. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = rows.drop("shard", "slot", NUMBER)
    numbers, count = numbered(rows, id_column)
    placed = permuted(numbers, NUMBER, count, seed)
    return placed.select(
        *rows.columns,
        (F.col(NUMBER) % shards).cast("int").alias("shard"),
        F.expr(f"{NUMBER} div {shards}").alias("slot"),
    )


def row_at(places: DataFrame, count: int, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``places`` (shard, slot) with the ``row_number`` that the shuffle of ``count`` rows puts there."""
    at = places.withColumn(NUMBER, F.col("slot").cast("long") * shards + F.col("shard"))
    return permuted(at, NUMBER, count, seed, inverse=True)
