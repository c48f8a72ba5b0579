"""Mixing documents to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. Raking scales these cells by one factor per source,
language and topic until the three marginals meet their targets; a document's chance to be taken is
its cell's scale, divided by the largest one, so that expected tokens have exactly the raked shares.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("source", "lang", "topic")
#: Exponent that evens out the shares of categories where no targets are given.
TEMPER = 0.8
SEED = 17
TOLERANCE, ROUNDS = 1e-9, 2000
#: Cells that the driver holds: sources x languages x topics, not documents.
MAX_CELLS = 200_000


def tempered(tokens: Sequence[float], exponent: float = TEMPER) -> np.ndarray:
    """Target shares in proportion to a power of the tokens."""
    raised = np.asarray(tokens, float) ** exponent
    return raised / raised.sum()


def raked(mass: np.ndarray, groups: Sequence[np.ndarray], targets: Sequence[np.ndarray]) -> np.ndarray:
    """Scale of each cell at which the shares of ``scale * mass`` by each grouping are the ``targets``.

    ``groups`` number the category of each cell. If no scale meets all targets, as empty cells can bring about, it
    is that of the last round.
    """
    scale = np.ones(len(mass))
    for _ in range(ROUNDS):
        worst = 0.0
        for group, target in zip(groups, targets, strict=True):
            share = np.bincount(group, scale * mass, len(target))
            factor = np.divide(target, share / share.sum(), out=np.ones(len(target)), where=share > 0)
            worst = max(worst, float(np.abs(factor - 1).max(initial=0)))
            scale = scale * factor[group]
        if worst < TOLERANCE:
            break
    return scale


def draw(*keys: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 (exclusive) that depends on the keys and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def cells(docs: DataFrame, dimensions: Sequence[str], tokens: Column) -> DataFrame:
    return docs.groupBy(*dimensions).agg(F.sum(tokens).cast("double").alias("mass"))


def probabilities(docs: DataFrame, tokens: Column, targets: Mapping[str, Mapping] | None = None, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(*dimensions, ``probability``), a row per combination that occurs.

    ``targets`` gives shares by dimension and category; categories it leaves out get none. A dimension it leaves out
    has tempered shares of its own tokens. Combinations without tokens are always taken: they weigh nothing. Null is a category.
    """
    table = cells(docs, dimensions, tokens)
    rows = table.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of {', '.join(dimensions)}: use coarser categories")
    mass = np.array([r["mass"] or 0.0 for r in rows])
    live = mass > 0
    groups, wanted = [], []
    for name in dimensions:
        names = sorted({r[name] for r, ok in zip(rows, live, strict=True) if ok}, key=lambda x: (x is not None, x))
        number = {x: i for i, x in enumerate(names)}
        group = np.array([number[r[name]] for r, ok in zip(rows, live, strict=True) if ok], int)
        given = (targets or {}).get(name)
        if given is None:
            target = tempered(np.bincount(group, mass[live], len(names))) if len(names) else np.zeros(0)
        else:
            target = np.array([float(given.get(x, 0.0)) for x in names])
            target = target / target.sum() if target.sum() else target
        groups.append(group)
        wanted.append(target)
    chance = np.ones(len(rows))
    if live.any():
        scale = raked(mass[live], groups, wanted)
        chance[live] = scale / scale.max() if scale.max() else 0.0
    fields = [table.schema[name] for name in dimensions]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", probability double"
    return docs.sparkSession.createDataFrame([(*(r[name] for name in dimensions), float(p)) for r, p in zip(rows, chance, strict=True)], schema)


def mixed(docs: DataFrame, tokens: Column, key: Column, targets: Mapping[str, Mapping] | None = None, dimensions: Sequence[str] = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``probability`` and ``taken``.

    ``tokens`` weighs a row (null: 0), ``key`` decides its draw: rows with one key share their fate, so repeated
    rows are taken together. Columns of the input named ``probability`` or ``taken`` are replaced, others kept.
    """
    docs = docs.drop("probability", "taken")
    chances = probabilities(docs, tokens, targets, dimensions)
    # The rows travel as one struct, so their columns may have any names.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(whole.alias("row"), draw(key, seed=seed).alias("draw"))
    same = [F.col("row")[name].eqNullSafe(F.col(f"chance.{name}")) for name in dimensions]
    # At most MAX_CELLS narrow rows, of which far fewer occur.
    joined = rows.join(F.broadcast(chances.alias("chance")), same, "left")
    return joined.select("row.*", F.col("chance.probability").alias("probability"), (F.col("draw") < F.col("chance.probability")).alias("taken"))


def words(text: Column) -> Column:
    """Number of words of a text, its weight in tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def with_topic(docs: DataFrame, topics: DataFrame, id_column: str, topic_id: str, label: str) -> DataFrame:
    """``docs`` with ``topic``: the smallest label that ``topics`` has for the id, else null. A column ``topic`` of the input is replaced."""
    marks = topics.where(F.col(topic_id).isNotNull()).groupBy(F.struct(F.col(topic_id)).alias("key")).agg(F.min(label).alias("topic"))
    marks = marks.select(F.col("key")[topic_id].alias("mark"), "topic").alias("m")
    docs = docs.drop("topic")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).alias("d")
    return rows.join(marks, F.col("d.row")[id_column] == F.col("m.mark"), "left").select("d.row.*", "m.topic")
