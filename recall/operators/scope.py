"""Wildcard scope matching as plain grouping.

A row matches a scope when it agrees with every dimension that scope sets. So
a row answers for exactly those scopes that arise from its own by blanking any
of its set dimensions: at most 16 of them. Listing those scopes turns "earliest
row matching a wildcard scope" into one ordinary, partially aggregated
``GROUP BY``, with no pairs of rows ever formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall.plans.grouping import grouped
from recall.schema import SCOPE

BITS = {c: 1 << i for i, c in enumerate(SCOPE)}
# All choices of dimensions to blank; 0 is the row's own scope.
BLANKINGS = range(1 << len(SCOPE))


def _unset() -> Column:
    """Bits of the dimensions a row does not set."""
    return reduce(
        Column.bitwiseOR, [F.when(F.col(c) == "", F.lit(b)).otherwise(F.lit(0)) for c, b in BITS.items()]
    )


def earliest_in_scope(rows: DataFrame, order: str, own_scopes_only: bool = False) -> DataFrame:
    """Earliest row per (content hash, scope), over all rows the scope matches.

    ``order`` names a comparable column that is unique per row. The result has
    ``content_hash``, the scope columns and ``first`` (the smallest ``order``).
    With ``own_scopes_only`` just the scopes that some row carries itself are kept.
    """
    # Collapse repeats before widening: a text repeated by a third of all rows
    # shrinks to its distinct scopes on the map side.
    keys = ["content_hash", *SCOPE]
    groups = grouped(rows, keys, F.min(order).alias("first"))
    if own_scopes_only:
        # A text with a single distinct scope can only match itself.
        spread = grouped(groups, ["content_hash"], F.count("*").alias("_scopes"))
        groups = groups.join(spread.where("_scopes > 1"), "content_hash", "left")
        only_own = F.col("_scopes").isNull()
    else:
        only_own = F.lit(False)
    everything = F.array(*[F.lit(b) for b in BLANKINGS])
    blanking = F.explode(F.when(only_own, F.array(F.lit(0))).otherwise(everything))
    wide = (
        groups.select("content_hash", *SCOPE, "first", blanking.alias("_blank"))
        # Blanking an unset dimension changes nothing; leave such repeats out.
        .where(F.col("_blank").bitwiseAND(_unset()) == 0)
        .select(
            "content_hash",
            "first",
            *[
                F.when(F.col("_blank").bitwiseAND(b) == 0, F.col(c)).otherwise(F.lit("")).alias(c)
                for c, b in BITS.items()
            ],
            (F.col("_blank") == 0).alias("own"),
        )
    )
    earliest = grouped(wide, keys, F.min("first").alias("first"), F.max("own").alias("own"))
    if own_scopes_only:
        earliest = earliest.where("own")
    return earliest.drop("own")
