"""Knowledge graph as tables: building, merging, searching and walking it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall.functions import text
from recall.functions.times import instant
from recall.operators.triples import entity_id, entity_type, extract_triples, relation_id
from recall.plans.checkpoint import durable
from recall.plans.grouping import grouped
from recall.schema import DEFAULT_GRAPH_LIMIT, clamp_depth, positive_or

GRAM = 3
# Queries up to which they are broadcast; with all their runs some 10 MB.
FEW_QUERIES = 5_000
FEW_BYTES = 1_000_000
# Candidates up to which they are broadcast to the names: two ids and a text each, some 20 MB.
FEW_CANDIDATES = 100_000


@dataclass(frozen=True)
class Graph:
    """Entities, the memories each one is mentioned in, and relations.

    The mentions are a table of their own because one entity may be mentioned
    by any share of all memories; ordered by ``first_seen, text_order`` they are
    the entity's memory ids in first-seen order.
    """

    entities: DataFrame
    mentions: DataFrame
    relations: DataFrame


def _mentions(triples: DataFrame) -> DataFrame:
    """One row per named end of each triple; ``side`` is 0 for subjects and 1 for objects."""
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("subject").alias("name")),
        F.struct(F.lit(1).alias("side"), F.col("object").alias("name")),
    )
    carried = [c for c in triples.columns if c not in ("subject", "predicate", "object")]
    return triples.select(*carried, F.inline(ends)).withColumn("entity_id", entity_id(F.col("name")))


def entities_of(
    triples: DataFrame, order: str | None = None, now: datetime | str | Column | None = None
) -> DataFrame:
    """Entities of a table of triples, one per lower-cased name.

    Names are written as first seen. With ``order``, a column that orders the
    texts, each text counts as a write of its own, and the latest text that has
    the entity decides.
    """
    first_in_text = [-F.col("sentence_pos"), -F.col("pattern_pos"), -F.col("side")]
    deciding = F.struct(*([F.col(order)] if order else []), *first_in_text)
    stamp = instant(now)
    named = _mentions(triples).groupBy("entity_id").agg(F.max_by("name", deciding).alias("name"))
    return named.select(
        F.col("entity_id").alias("id"),
        "name",
        entity_type(F.col("name")).alias("type"),
        F.lit(None).cast("string").alias("metadata"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def mentions_of(
    triples: DataFrame, order: str = "memory_id", now: datetime | str | Column | None = None
) -> DataFrame:
    """Distinct ``(entity_id, memory_id)`` with the place of the text in its batch."""
    return (
        _mentions(triples)
        .groupBy("entity_id", "memory_id")
        .agg(F.min(order).alias("text_order"))
        .withColumn("first_seen", instant(now))
    )


def relations_of_triples(
    triples: DataFrame, order: str = "memory_id", now: datetime | str | Column | None = None
) -> DataFrame:
    """One relation per triple, repeats included, with the place it was found at."""
    start, end = entity_id(F.col("subject")), entity_id(F.col("object"))
    return triples.select(
        relation_id(start, F.col("predicate"), end).alias("id"),
        start.alias("from_id"),
        end.alias("to_id"),
        F.col("predicate").alias("type"),
        F.lit(1.0).alias("weight"),
        F.array("memory_id").alias("memory_ids"),
        instant(now).alias("created_at"),
        F.struct(F.col(order).alias("text_order"), "sentence_pos", "pattern_pos").alias("found_at"),
    )


def _writes(stored: DataFrame | None, fresh: DataFrame, seq: Column, columns: list[str]) -> DataFrame:
    """Stored and fresh rows with ``_write``, their order of writing."""
    later = fresh.select(*columns, F.struct(F.lit(1).alias("batch"), seq.alias("seq")).alias("_write"))
    if stored is None:
        return later
    no_seq = F.lit(None).cast(later.schema["_write"].dataType["seq"].dataType).alias("seq")
    earlier = stored.select(*columns, F.struct(F.lit(0).alias("batch"), no_seq).alias("_write"))
    return earlier.unionByName(later)


ENTITY_COLUMNS = ["id", "name", "type", "metadata", "created_at", "updated_at"]
RELATION_COLUMNS = ["id", "from_id", "to_id", "type", "weight", "memory_ids", "created_at"]


def upsert_entities(stored: DataFrame | None, fresh: DataFrame, seq: Column | None = None) -> DataFrame:
    """Name and type from the newest write; creation time and metadata from the oldest."""
    writes = _writes(stored, fresh, F.lit(0) if seq is None else seq, ENTITY_COLUMNS)
    merged = writes.groupBy("id").agg(
        F.max_by(F.struct("name", "type"), "_write").alias("_new"),
        F.min_by(F.struct("metadata", "created_at"), "_write").alias("_old"),
        F.max("updated_at").alias("updated_at"),
    )
    return merged.select("id", "_new.*", "_old.*", "updated_at")


def upsert_relations(stored: DataFrame | None, fresh: DataFrame, seq: Column | None = None) -> DataFrame:
    """The newest write of each relation replaces it whole."""
    writes = _writes(stored, fresh, F.lit(0) if seq is None else seq, RELATION_COLUMNS)
    newest = writes.groupBy("id").agg(F.max_by(F.struct(*RELATION_COLUMNS[1:]), "_write").alias("_new"))
    return newest.select("id", "_new.*")


def merge_mentions(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Union of mentions; the earliest sighting of each is kept."""
    both = fresh if stored is None else stored.unionByName(fresh)
    return (
        both.groupBy("entity_id", "memory_id")
        .agg(F.min(F.struct("first_seen", "text_order")).alias("_first"))
        .select("entity_id", "memory_id", "_first.*")
    )


def build(
    texts: DataFrame,
    stored: Graph | None = None,
    order: str = "memory_id",
    now: datetime | str | Column | None = None,
) -> Graph:
    """Add a batch of texts to a graph. ``order`` is the column that orders the texts.

    The triples are written down first: all three tables come from them, and the
    texts are read once.
    """
    return from_triples(durable(extract_triples(texts)), stored, order, now)


def from_triples(
    triples: DataFrame,
    stored: Graph | None = None,
    order: str = "memory_id",
    now: datetime | str | Column | None = None,
) -> Graph:
    """Add triples to a graph."""
    return Graph(
        upsert_entities(stored and stored.entities, entities_of(triples, order, now)),
        merge_mentions(stored and stored.mentions, mentions_of(triples, order, now)),
        upsert_relations(
            stored and stored.relations, relations_of_triples(triples, order, now), F.col("found_at")
        ),
    )


@dataclass(frozen=True)
class Writes:
    """What batches of texts write into a graph, each row with its place in the order of all texts.

    A later batch does not need the graph, nor need batches come in the order of their texts: which write is the
    last is settled when the graph is read.
    """

    entities: DataFrame
    mentions: DataFrame
    relations: DataFrame


def writes_of(texts: DataFrame, order: str = "memory_id", now: datetime | str | Column | None = None) -> Writes:
    """Writes of a batch of texts, at most one per entity, mention and relation; its size is that of the batch."""
    triples, stamp = durable(extract_triples(texts)), instant(now)
    deciding = F.struct(F.col(order).alias("text_order"), *(-F.col(c) for c in ("sentence_pos", "pattern_pos", "side")))
    named = _mentions(triples).groupBy(F.col("entity_id").alias("id")).agg(F.max_by("name", deciding).alias("name"), F.max(deciding).alias("written"))
    found = relations_of_triples(triples, order, now)
    last = found.groupBy("id").agg(F.max_by(F.struct(*RELATION_COLUMNS[1:]), "found_at").alias("relation"), F.max("found_at").alias("written"))
    return Writes(named.withColumn("at", stamp), mentions_of(triples, order, now), last)


def settled(writes: Writes) -> Graph:
    """The graph that all writes together make, as one batch of all their texts would."""
    entities = writes.entities.groupBy("id").agg(F.max_by("name", "written").alias("name"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    entities = entities.withColumns({"type": entity_type(F.col("name")), "metadata": F.lit(None).cast("string")}).select(*ENTITY_COLUMNS)
    relations = writes.relations.groupBy("id").agg(F.max_by("relation", "written").alias("relation")).select("id", "relation.*")
    return Graph(entities, merge_mentions(None, writes.mentions), relations)


def add_counts(texts: DataFrame) -> DataFrame:
    """Per text: triples found, distinct entities and relations written (one per triple)."""
    ends = _mentions(extract_triples(texts))
    found = ends.groupBy("memory_id").agg(
        F.count_if(F.col("side") == 0).alias("triples_extracted"),
        F.count_distinct("entity_id").alias("entities_added"),
    )
    return (
        texts.select("memory_id")
        .join(found, "memory_id", "left")
        .fillna(0, ["triples_extracted", "entities_added"])
        .withColumn("relations_added", F.col("triples_extracted"))
    )


def counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    both = entities.select(F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(
        relations.select(F.lit(0).alias("e"), F.lit(1).alias("r"))
    )
    return both.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("entity_count"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("relation_count"),
    )


def lookup_entities(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """Requested entities; an absent one keeps its id and is otherwise null."""
    return ids.select("id").join(entities, "id", "left")


def find_entities(entities: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Entities whose name contains the text, in any case, by name."""
    hits = entities.where(text.lowered(F.col("name")).contains(text.lowered(F.lit(query))))
    return hits.orderBy("name", "id").limit(positive_or(limit, DEFAULT_GRAPH_LIMIT))


def _runs(rows: DataFrame, column: str, sizes: Sequence[int], shortest: int = 1) -> DataFrame:
    """Rows with ``_gram``: each run of ``sizes`` characters in ``column``, at every position."""
    positions = F.sequence(F.lit(1), F.char_length(column))
    placed = rows.where(F.char_length(column) >= shortest).withColumn("_at", F.explode(positions))
    pieces = F.array(*[F.struct(F.lit(n).alias("_size"), F.substring(F.col(column), F.col("_at"), F.lit(n)).alias("_gram")) for n in sizes])
    # Runs cut short by the end of the text are no runs.
    return (
        placed.select(*rows.columns, F.inline(pieces))
        .where(F.char_length("_gram") == F.col("_size"))
        .drop("_size")
    )


def name_index(entities: DataFrame) -> DataFrame:
    """Which names have which runs of one to three characters: (``gram``, ``id``), each once."""
    return _postings(entities).distinct()


def _postings(entities: DataFrame) -> DataFrame:
    names = entities.select("id", text.lowered(F.col("name")).alias("_lower"))
    return _runs(names, "_lower", range(1, GRAM + 1)).select(F.col("_gram").alias("gram"), "id")


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lower-cased queries, and the runs that any name they are in must have; shorter queries are their own run."""
    asked = queries.select("query_id", text.lowered(F.col("query")).alias("_query"))
    short = asked.where(F.char_length("_query") < GRAM).withColumn("_gram", F.col("_query"))
    return asked, _runs(asked, "_query", [GRAM], GRAM).unionByName(short)


def asked_grams(queries: DataFrame) -> DataFrame:
    """Runs (``gram``) that decide a table of queries."""
    return grouped(_asked(queries)[1].where("_gram <> ''").select(F.col("_gram").alias("gram")), ["gram"])


def find_entities_batch(
    queries: DataFrame, entities: DataFrame, limit: int | None = None, index: DataFrame | None = None
) -> DataFrame:
    """:func:`find_entities` for a table of ``query_id, query``, with ``rank`` from 1.

    Substring tests become an equi-join: a name containing a query contains all of
    its three-character runs, and the rarest of them is the join key. Runs and ids alone are joined, from ``index``
    (:func:`name_index`) if it is given; names are looked up for the candidates that this leaves. Up to a checked number
    of queries and of candidates, they go to the other side, which then stays where it is; more are joined
    by a shuffle. Left alone, Spark could broadcast the runs, whose number it underestimates.
    """
    limit = positive_or(limit, DEFAULT_GRAPH_LIMIT)
    measured = queries.limit(FEW_QUERIES + 1).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("query")), F.lit(0)).alias("bytes")
    )
    size = measured.first()
    few = size["n"] <= FEW_QUERIES and size["bytes"] <= FEW_BYTES
    _, keys = _asked(queries)
    postings = (_postings(entities) if index is None else index).select(F.col("gram").alias("_gram"), "id")
    wanted = grouped(keys, ["_gram"])
    found = postings.join(F.broadcast(wanted) if few else wanted.hint("merge"), "_gram", "left_semi")
    found = durable(found.distinct() if index is None else found)
    frequency = found.groupBy("_gram").agg(F.count("*").alias("_names"))
    rarest = (
        keys.join(frequency, "_gram", "left")
        .groupBy("query_id", "_query")
        .agg(F.min_by("_gram", F.struct(F.coalesce("_names", F.lit(0)), "_gram")).alias("_gram"))
    )
    candidates = durable(found.join(F.broadcast(rarest) if few else rarest.hint("merge"), "_gram").select("query_id", "_query", "id"))
    sought = F.broadcast(candidates) if candidates.count() <= FEW_CANDIDATES else candidates.hint("merge")
    names = entities.select("id", "name", text.lowered(F.col("name")).alias("_lower"))
    hits = names.join(sought, "id").where(F.col("_lower").contains(F.col("_query"))).select("query_id", "id", "name")
    # The empty query finds every name; its page needs only the first ones.
    # Their key is that query; written as a literal, Spark would make a join without a key of it.
    everything = names.orderBy("name", "id").limit(limit).select("id", "name", F.substring("name", 1, 0).alias("query"))
    unspecific = queries.select("query_id", "query").join(F.broadcast(everything), "query")
    by_name = Window.partitionBy("query_id").orderBy("name", "id")
    ranked = hits.unionByName(unspecific.select("query_id", "id", "name")).withColumn("rank", F.row_number().over(by_name))
    return ranked.where(F.col("rank") <= limit)


def _ends(relations: DataFrame) -> DataFrame:
    """Each relation under both of its ends, a self-loop once."""
    return relations.withColumn("entity_id", F.explode(F.array_distinct(F.array("from_id", "to_id"))))


def relations_of(ids: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations touching each requested entity, at either end, with ``entity_id``."""
    wanted = grouped(ids.select(F.col("id").alias("entity_id")), ["entity_id"])
    return _ends(relations).join(wanted, "entity_id")


def reach(starts: DataFrame, relations: DataFrame, depth: int) -> DataFrame:
    """Vertices within ``depth`` steps of each start: ``start_id, id, distance``, starts at 0.

    Breadth first, all starts together, one join per step. In an undirected walk
    the neighbours of a level lie in that level or next to it, so only
    the last two levels need to be taken out. A finished level is written
    down, as three later steps read it.
    """
    steps = relations.select(
        F.inline(
            F.array(
                F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("next_id")),
                F.struct(F.col("to_id").alias("id"), F.col("from_id").alias("next_id")),
            )
        )
    )
    level = starts.select(F.col("id").alias("start_id"), "id").distinct()
    before = level
    found = level.withColumn("distance", F.lit(0))
    for distance in range(1, depth + 1):
        following = (
            level.join(steps, "id")
            .select("start_id", F.col("next_id").alias("id"))
            .distinct()
            .join(level, ["start_id", "id"], "left_anti")
        )
        if distance > 1:
            following = following.join(before, ["start_id", "id"], "left_anti")
        if distance < depth:
            following = durable(following)
        found = found.unionByName(following.withColumn("distance", F.lit(distance)))
        before, level = level, following
    return found


def neighbours(starts: DataFrame, relations: DataFrame, entities: DataFrame, depth: int = 1) -> DataFrame:
    """Entities within ``depth`` steps of each start, without the start itself.

    Ids without an entity row are walked through but not returned. No depth, no rows.
    """
    found = reach(starts, relations, depth).where(F.col("distance") > 0)
    return found.join(entities, "id").select("start_id", "distance", *entities.columns)


def walk(starts: DataFrame, graph: Graph, depth: int | None = None) -> DataFrame:
    """:func:`neighbours` for callers: one step unless a depth is given, and never more than the maximum."""
    return neighbours(starts, graph.relations, graph.entities, clamp_depth(depth))


def neighbour_relations(starts: DataFrame, relations: DataFrame, depth: int = 1) -> DataFrame:
    """Relations walked on the way: those with an end fewer than ``depth`` steps away."""
    if depth <= 0:
        return relations.limit(0).withColumn("start_id", F.lit(None).cast("string"))
    inner = reach(starts, relations, depth - 1).select("start_id", F.col("id").alias("entity_id"))
    walked = _ends(relations).join(inner, "entity_id").select("start_id", "id").distinct()
    return walked.join(relations, "id").select("start_id", *relations.columns)
