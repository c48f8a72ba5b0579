"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.plans.checkpoint import durable
from recall.plans.grouping import grouped


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours on the smallest node in reach.

    ``edges`` run from a larger to a smaller node. The large star moves the larger neighbours of a node
    to the smallest of itself and its neighbours, the small star the smaller ones and the node itself.
    Minima are combined before the shuffle, and the joins' own shuffles let hubs be split.
    """
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = grouped(around, ["a"], F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = grouped(edges, ["a"], F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node that the pairs (``a``, ``b``) link: root is the smallest one.

    The roots themselves are not in the result, nor are nodes without a link. Pairs may come in any
    order and number; pairs of a node with itself and nulls count for nothing. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the components' size.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = durable(pairs.where("a > b").distinct())
    state = None
    while True:
        pairs = durable(_stars(durable(_stars(pairs, large=True)), large=False))
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first()
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
