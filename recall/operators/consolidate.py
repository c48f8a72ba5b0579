"""Consolidation: clusters of similar memories, and facts that corrections may supersede."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall.functions import text
from recall.functions.times import instant
from recall.operators.filters import MemoryFilter, apply_filter
from recall.operators.listing import newest_per_scope
from recall.operators.search import knn
from recall.plans.checkpoint import durable
from recall.plans.grouping import grouped
from recall.schema import (
    CLUSTER_THRESHOLD,
    CONTRADICTION_CUTOFF,
    CORRECTION,
    EXCERPT_LENGTH,
    FACT,
    NEIGHBOURS_PER_CORRECTION,
    NEIGHBOURS_PER_SEED,
    SCOPE,
    SEEDS_PER_SCOPE,
    SUMMARY_CONFIDENCE,
)

SUMMARY = "summary"
CONTRADICTION = "contradiction"


@dataclass(frozen=True)
class Consolidation:
    """``insights``: summaries and contradictions. ``results``: one row per scope."""

    insights: DataFrame
    results: DataFrame


def threshold_or_default(value: float) -> float:
    """A similarity threshold in (0, 1]; anything else leaves the default."""
    return value if 0 < value <= 1 else CLUSTER_THRESHOLD


#: Edges between seeds of a scope up to which one task walks through them in order.
WALK_EDGES = 100_000
#: Fetched rows up to which their ids are broadcast: some 10 MB.
FEW_ROWS = 100_000


def find_seeds(memories: DataFrame, scope: Sequence[str], count: int = SEEDS_PER_SCOPE) -> DataFrame:
    """The newest rows of every scope that has at least two, newest first.

    ``searchable`` is false for empty texts and rows without a vector, which
    cannot be searched with. Long texts stay behind: only an excerpt comes along. The rows are found by scope, time
    and id alone.
    """
    wanted = durable(newest_per_scope(memories.select(*scope, "created_at", "id"), scope, max(count, 2)).select("id", "position"))

    def shown(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(
            *scope,
            "id",
            "memory_type",
            "created_at",
            "embedding",
            text.clipped(F.col("content"), EXCERPT_LENGTH).alias("excerpt"),
            (F.col("embedding").isNotNull() & (F.col("content") != "")).alias("searchable"),
            *more,
        )

    if wanted.count() <= FEW_ROWS:
        # Other rows end before anything wide is read or joined: the semi-join sinks to where the ids come from.
        small = F.broadcast(wanted)
        newest = shown(memories.join(small, "id", "left_semi").join(small, "id"), "position")
    else:
        newest = shown(memories).join(wanted, "id")
    # Kept, for otherwise the semi-join below sinks into the whole table and shuffles it by scope.
    newest = durable(newest)
    peers = grouped(newest, list(scope), F.count(F.lit(1)).alias("_peers")).where("_peers > 1").drop("_peers")
    return newest.join(peers, list(scope), "left_semi").where(F.col("position") <= count)


def find_neighbours(
    seeds: DataFrame,
    memories: DataFrame,
    min_score: float,
    scope: Sequence[str],
    neighbour_scope: str = "all",
    count: int = NEIGHBOURS_PER_SEED,
) -> DataFrame:
    """Nearest memories of each seed, from all scopes or from the seed's own."""
    own = list(scope) if neighbour_scope == "same" else []
    queries = seeds.where("searchable").select(F.col("id").alias("query_id"), "embedding", *own)
    return knn(queries, memories, count, min_score=min_score)


def _walk(edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Seeds that an earlier one absorbs, one task walking through the edges of a scope in order."""
    schema = T.StructType([*[edges.schema[c] for c in scope], T.StructField("id", T.StringType())])

    def one_scope(rows: pd.DataFrame) -> pd.DataFrame:
        absorbed: dict[str, bool] = {}
        for seed, later in rows.sort_values("position")[["seed_id", "later_id"]].itertuples(index=False):
            if seed not in absorbed:
                absorbed[later] = True
        out = pd.DataFrame({"id": list(absorbed)}, dtype=object)
        for place, name in enumerate(scope):
            out.insert(place, name, rows[name].iloc[0])
        return out

    return edges.groupBy(*scope).applyInPandas(one_scope, schema)


def absorbed_seeds(edges: DataFrame, scope: Sequence[str], walk_edges: int = WALK_EDGES) -> DataFrame:
    """Seeds that get no turn: ``scope, id``.

    ``edges`` lead from a seed to a later one of its scope that is near to it (``position`` is the earlier one's place). A seed is absorbed if an
    earlier seed with a turn is near to it. That is settled in rounds: seeds without an open edge to them
    have their turn, what they reach is absorbed, and both leave with their edges. As soon as the
    open edges of a scope are few, one task walks through them, so a scope of any size is never in one task.
    """
    keys, found, left = list(scope), None, durable(edges)
    while True:
        sizes = grouped(left, keys, F.count(F.lit(1)).alias("_n"))
        large = durable(sizes.where(F.col("_n") > walk_edges).select(keys))
        small = durable(_walk(left.join(large, keys, "left_anti"), scope))
        found = small if found is None else found.unionByName(small)
        if large.isEmpty():
            return found
        left = left.join(large, keys, "left_semi")
        aimed = left.select(*keys, F.col("later_id").alias("seed_id")).distinct()
        first = left.join(aimed, [*keys, "seed_id"], "left_anti")
        reached = durable(first.select(*keys, F.col("later_id").alias("id")).distinct())
        found = found.unionByName(reached)
        # Seeds with a turn have no say in what is left; absorbed ones neither, nor do they need a verdict.
        left = left.join(aimed, [*keys, "seed_id"], "left_semi")
        for end in ("seed_id", "later_id"):
            left = left.join(reached.withColumnRenamed("id", end), [*keys, end], "left_anti")
        left = durable(left)


def greedy_clusters(
    seeds: DataFrame, neighbours: DataFrame, scope: Sequence[str], threshold: float, walk_edges: int = WALK_EDGES
) -> DataFrame:
    """Greedy pass per scope: ``scope, seed_id, id`` for each member of a cluster of two or more.

    Newest first, each unvisited seed takes its unvisited near neighbours. A seed is
    unvisited when its turn comes unless an earlier one took it; so first the seeds with a turn are found
    (:func:`absorbed_seeds`), and then each neighbour goes to the earliest of them.
    """
    keys = list(scope)
    turns = durable(seeds.where("searchable").select(*keys, F.col("id").alias("seed_id"), "position"))
    near = neighbours.where(F.col("score") >= threshold).select(F.col("query_id").alias("seed_id"), "id")
    takes = durable(turns.join(near, "seed_id"))
    later = turns.select(*keys, F.col("seed_id").alias("later_id"), F.col("position").alias("_later"))
    edges = takes.withColumnRenamed("id", "later_id").join(later, [*keys, "later_id"]).where(F.col("position") < F.col("_later"))
    absorbed = durable(absorbed_seeds(edges.select(*keys, "seed_id", "position", "later_id"), scope, walk_edges))
    lost = absorbed.withColumnRenamed("id", "seed_id")
    has_turn = turns.join(lost, [*keys, "seed_id"], "left_anti").select(*keys, F.col("seed_id").alias("id"))
    offered = takes.join(lost, [*keys, "seed_id"], "left_anti").join(has_turn, [*keys, "id"], "left_anti")
    taken = durable(grouped(offered, [*keys, "id"], F.min_by("seed_id", "position").alias("seed_id")))
    members = taken.select(*keys, "seed_id", "id")
    own = members.select(*keys, "seed_id").distinct().withColumn("id", F.col("seed_id"))
    return members.unionByName(own)


def summarise(clusters: DataFrame, memories: DataFrame, scope: Sequence[str], now: Column) -> DataFrame:
    """One insight per cluster: members oldest first, the latest one's text, their number.

    Ages are fetched for all members, texts for the latest ones only.
    """
    clusters = durable(clusters)
    few = clusters.count() <= FEW_ROWS

    def fetched(rows: DataFrame, *columns: str) -> DataFrame:
        """Rows with columns of the memories of their ``id``."""
        return memories.select("id", *columns).join(F.broadcast(rows) if few else rows, "id")

    age = F.struct("created_at", "id")
    sets = fetched(clusters, "created_at").groupBy(*scope, "seed_id").agg(
        # A cluster has a seed and as many members as it has neighbours at most.
        F.array_sort(F.collect_list(age)).alias("_members")
    )
    dated = sets.withColumn("id", F.element_at("_members", -1)["id"])
    return fetched(durable(dated), "content").select(
        *scope,
        F.format_string("Consolidated from %d related memories. Latest: %s", F.size("_members"), F.col("content")).alias("content"),
        F.col("_members.id").alias("source_ids"),
        F.lit(SUMMARY).alias("insight_type"),
        F.lit(SUMMARY_CONFIDENCE).alias("confidence"),
        now.alias("created_at"),
    )


def contradictions(
    seeds: DataFrame, neighbours: DataFrame, scope: Sequence[str], cutoff: float, count: int = NEIGHBOURS_PER_CORRECTION
) -> DataFrame:
    """Pairs of a fact and a later, similar correction of the same scope.

    The fact must be among the correction's ``count`` nearest memories overall.
    """
    close = neighbours.where((F.col("rank") <= count) & (F.col("score") > cutoff)).select(
        F.col("query_id").alias("correction_id"), F.col("id").alias("fact_id"), "score"
    )

    def side(name: str, memory_type: str) -> DataFrame:
        return seeds.where(F.col("memory_type") == memory_type).select(
            *scope,
            F.col("id").alias(f"{name}_id"),
            F.col("created_at").alias(f"{name}_at"),
            F.col("excerpt").alias(f"{name}_excerpt"),
        )

    return (
        side("correction", CORRECTION)
        .join(close, "correction_id")
        .join(side("fact", FACT), ["fact_id", *scope])
        .where(F.col("correction_at") >= F.col("fact_at"))
        .select(*scope, "fact_id", "correction_id", "fact_excerpt", "correction_excerpt", "score")
    )


def describe(pairs: DataFrame, scope: Sequence[str], now: Column) -> DataFrame:
    """Contradiction pairs as insights."""
    content = F.concat(
        F.lit("Potential contradiction: fact "),
        text.quoted(F.col("fact_excerpt")),
        F.lit(" may be superseded by correction "),
        text.quoted(F.col("correction_excerpt")),
    )
    return pairs.select(
        *scope,
        content.alias("content"),
        F.array("fact_id", "correction_id").alias("source_ids"),
        F.lit(CONTRADICTION).alias("insight_type"),
        F.col("score").alias("confidence"),
        now.alias("created_at"),
    )


def consolidate(
    memories: DataFrame,
    scope: Sequence[str] = ("user_id",),
    *,
    flt: MemoryFilter | None = None,
    threshold: float = CLUSTER_THRESHOLD,
    cutoff: float = CONTRADICTION_CUTOFF,
    neighbour_scope: str = "all",
    now: datetime | str | Column | None = None,
    seeds: int = SEEDS_PER_SCOPE,
    neighbours: int = NEIGHBOURS_PER_SEED,
    correction_neighbours: int = NEIGHBOURS_PER_CORRECTION,
) -> Consolidation:
    """Consolidate every scope at once.

    ``scope`` is any non-empty subset of the scope dimensions; the others mean
    "any". ``flt`` limits the memories looked at, not the neighbours, which
    come from the whole table. ``seeds`` newest memories of a scope ask for ``neighbours`` nearest ones each, of
    which ``correction_neighbours`` count for contradictions.
    """
    if not scope or not set(scope) <= set(SCOPE):
        raise ValueError(f"scope must be a non-empty subset of {SCOPE}")
    if neighbour_scope not in ("all", "same"):
        raise ValueError("neighbour_scope must be 'all' or 'same'")
    threshold = threshold_or_default(threshold)
    scoped = apply_filter(memories, flt)
    # The clock is read once, not by each action.
    stamp = instant(datetime.now(timezone.utc).isoformat() if now is None else now)

    # Both are small next to the table and used more than once.
    newest = durable(find_seeds(scoped, scope, seeds))
    most = max(neighbours, correction_neighbours)
    close = durable(find_neighbours(newest, memories, min(threshold, cutoff), scope, neighbour_scope, most))

    clusters = durable(greedy_clusters(newest, close.where(F.col("rank") <= neighbours), scope, threshold))
    pairs = contradictions(newest, close, scope, cutoff, correction_neighbours)
    insights = summarise(clusters, memories, scope, stamp).unionByName(describe(pairs, scope, stamp))

    processed = scoped.groupBy(*scope).agg(F.count("*").alias("processed_count"))
    merged = clusters.groupBy(*scope).agg(F.count("*").alias("merged_count"))
    results = processed.join(merged, list(scope), "left").fillna(0, ["merged_count"])
    return Consolidation(insights, results)
