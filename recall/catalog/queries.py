"""Registered queries: every operator over the whole of the driver's tables.

Each callable takes a session and a table folder and returns a DataFrame.
Result columns are scalars, so that any engine can be compared with them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.functions import metadata, text
from recall.functions.times import literal
from recall.operators import consolidate, embed, graph, ingest, listing, maintain, profile, rank, search, stats
from recall.operators.filters import MemoryFilter, lookup_hashes, lookup_ids
from recall.operators.triples import entity_id, entity_type, extract_triples
from recall.plans.checkpoint import durable, scratch_folder
from recall.schema import CORRECTION, FACT, MEMORIES, SCOPE
from recall.sources import fixtures, snapshots
from recall.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

# The fixed "now" of all time-dependent queries.
NOW = datetime(2024, 1, 8)
SINCE = datetime(2024, 1, 2)
UNTIL = datetime(2024, 1, 20, 12)
# Similarities of the test vectors are low; the defaults would find nothing.
LOW_THRESHOLD = 0.30
DIMENSIONS = 64

QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def six(c: Column | str) -> Column:
    return F.round(c, 6)


# --- scan, filter, lookup, list ---


@registered
def mem_scan(spark: SparkSession, folder: str) -> DataFrame:
    m = ingest.normalised(fixtures.memories(spark, folder))
    return listing.without_embedding(m).select(
        "id", "memory_type", *SCOPE, "metadata", "content_hash", "created_at", "updated_at"
    )


@registered
def mem_filter_scope_time(spark: SparkSession, folder: str) -> DataFrame:
    flt = MemoryFilter(agent_id="en", memory_type=FACT, since=SINCE, until=UNTIL)
    return flt.apply(fixtures.memories(spark, folder)).select("id", "user_id", "agent_id", "memory_type", "created_at")


@registered
def mem_filter_all(spark: SparkSession, folder: str) -> DataFrame:
    """User, application and run, alone and together; the number tells the filter."""
    rows = fixtures.memories(spark, folder)
    found = [
        MemoryFilter(user_id=user, app_id=app, run_id=run).apply(rows)
        for user, app, run in (("u4", "", "run2"), ("", "src1", "run1"), ("u8", "src2", ""), ("u12", "", ""))
    ]
    tagged = [x.select(F.lit(i).alias("filter"), "id", "user_id", "app_id", "run_id") for i, x in enumerate(found)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])


@registered
def mem_lookup_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = fixtures.table(spark, folder, "events").select(F.col("event_id").cast("string").alias("id"))
    return lookup_ids(ids, fixtures.memories(spark, folder)).select("id", "found", "memory_type", "content_hash")


@registered
def mem_lookup_hash(spark: SparkSession, folder: str) -> DataFrame:
    documents = fixtures.table(spark, folder, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("lookup_id"),
        text.content_hash(F.col("text")).alias("content_hash"),
        F.col("lang").alias("agent_id"),
    )
    turns = fixtures.table(spark, folder, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("lookup_id"),
        text.content_hash(F.col("text")).alias("content_hash"),
        F.lit("").alias("agent_id"),
    )
    return lookup_hashes(documents.unionByName(turns), fixtures.memories(spark, folder)).select(
        "lookup_id", "content_hash", "agent_id", "id"
    )


@registered
def mem_list_page(spark: SparkSession, folder: str) -> DataFrame:
    return listing.page(fixtures.memories(spark, folder), MemoryFilter(memory_type=FACT), 50, 20).select(
        "id", "memory_type", "created_at"
    )


@registered
def mem_list_deep(spark: SparkSession, folder: str) -> DataFrame:
    """A page from the middle of the list of all events, ranked in the partitions it lies in."""
    m = durable(fixtures.event_memories(spark, folder))
    return listing.page(m, None, 700, 4_000, shallow=0).select("id", "content_hash", "created_at")


@registered
def mem_list_total(spark: SparkSession, folder: str) -> DataFrame:
    return listing.total(fixtures.memories(spark, folder), MemoryFilter(memory_type=FACT))


@registered
def mem_recent_per_scope(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.memories(spark, folder).select("user_id", "id", "created_at")
    return listing.newest_per_scope(rows, ["user_id"], 20)


# --- statistics ---


@registered
def mem_stats_total(spark: SparkSession, folder: str) -> DataFrame:
    return listing.total(fixtures.memories(spark, folder))


@registered
def mem_stats_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return stats.count_by_type(fixtures.memories(spark, folder))


@registered
def mem_stats_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return stats.count_by_user(fixtures.memories(spark, folder))


@registered
def mem_stats_range(spark: SparkSession, folder: str) -> DataFrame:
    return stats.time_range(fixtures.memories(spark, folder), MemoryFilter(agent_id="en"))


@registered
def mem_stats_summary(spark: SparkSession, folder: str) -> DataFrame:
    entries = F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return stats.summary(fixtures.memories(spark, folder)).withColumn("by_type", F.array_join(entries, ","))


# --- ingest and maintenance ---


@registered
def ingest_validate(spark: SparkSession, folder: str) -> DataFrame:
    events = fixtures.table(spark, folder, "events")
    batch = events.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit("unknown"))
        .when(F.col("event_type") == "view", F.lit(FACT))
        .otherwise(F.lit(CORRECTION))
        .alias("memory_type"),
        F.when(F.col("value") < 10, F.lit("")).otherwise(F.col("props")).alias("content"),
    )
    return ingest.validate(batch).select("event_id", "memory_type", "reason")


@registered
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.table(spark, folder, "documents").select(
        "doc_id", text.content_hash(F.col("text")).alias("content_hash")
    )


@registered
def dedup_scope(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.memories(spark, folder).select("doc_id", "content_hash", *SCOPE)
    return ingest.dedup(rows, "doc_id").select(
        "doc_id", (F.col("first") == F.col("doc_id")).alias("is_new"), F.col("first").alias("first_doc_id")
    )


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    """All conversation turns, then all documents once more, scoped by language only."""
    turns = fixtures.conversation_batch(spark, folder).select(
        "content", "memory_type", "agent_id", "run_id", F.lit(0).alias("part"), "conv_id", "turn"
    )
    again = fixtures.table(spark, folder, "documents").select(
        F.col("text").alias("content"),
        F.lit(FACT).alias("memory_type"),
        F.col("lang").alias("agent_id"),
        F.lit("").alias("run_id"),
        F.lit(1).alias("part"),
        F.col("doc_id").alias("conv_id"),
        F.lit(0).cast("long").alias("turn"),
    )
    return turns.unionByName(again)


def _ingested(spark: SparkSession, folder: str) -> ingest.IngestResult:
    return ingest.ingest(
        _incoming(spark, folder),
        fixtures.memories(spark, folder),
        embed.NativeHashingEmbedder(DIMENSIONS),
        order_by=["part", "conv_id", "turn"],
        batch_id="b1",
        now=NOW,
    )


@registered
def ingest_new_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _ingested(spark, folder).new_rows.select(
        "content_hash",
        "memory_type",
        *SCOPE,
        "metadata",
        F.size("embedding").alias("dimensions"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@registered
def ingest_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    # Ids of rows accepted in the same batch are derived; stored ones are given.
    found = _ingested(spark, folder).duplicates
    of_stored = F.when(F.length("duplicate_of") < 36, F.col("duplicate_of"))
    return found.select("part", "conv_id", "turn", of_stored.alias("stored_id"))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """One change per event: new text, the same text, or none; most ids do not exist."""
    events = fixtures.table(spark, folder, "events")
    documents = fixtures.table(spark, folder, "documents")
    return events.join(documents, events.event_id == documents.doc_id, "left").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "view", F.col("text"))
        .when(F.col("event_type") != "click", F.concat(F.lit("updated "), F.col("props")))
        .alias("content"),
        F.when(F.col("event_type") != "purchase", F.lit('{"reviewed": true}')).alias("metadata"),
    )


def _updated(spark: SparkSession, folder: str) -> maintain.UpdateResult:
    return maintain.apply_updates(
        fixtures.memories(spark, folder),
        _changes(spark, folder),
        embedder=embed.NativeHashingEmbedder(DIMENSIONS),
        now=NOW,
    )


@registered
def update_apply(spark: SparkSession, folder: str) -> DataFrame:
    return _updated(spark, folder).memories.select(
        "id",
        "content_hash",
        "metadata",
        "created_at",
        "updated_at",
        F.coalesce(F.size("embedding"), F.lit(0)).alias("dimensions"),
    )


@registered
def update_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _updated(spark, folder).rejects.select("id", "reason")


@registered
def update_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of a conversation changes the memory of its number, in order."""
    turns = fixtures.table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("id"),
        F.when(F.col("role") == "user", F.col("text")).alias("content"),
        F.format_string('{"turn": %d, "k%d": %d}', "turn", F.col("turn") % 3, "turn").alias("metadata"),
        "turn",
    )
    result = maintain.apply_updates(
        fixtures.memories(spark, folder), turns, embedder=embed.NativeHashingEmbedder(DIMENSIONS), now=NOW, seq="turn"
    )
    keys = [F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("access_count", "turn", "k0", "k1", "k2")]
    return result.memories.select("id", "content_hash", "updated_at", *keys)


@registered
def metadata_merge(spark: SparkSession, folder: str) -> DataFrame:
    extra = F.concat(F.lit('{"pinned": true, "source": "'), F.col("user_id"), F.lit('"}'))
    return fixtures.memories(spark, folder).select(
        "id", metadata.merged(F.col("metadata"), extra).alias("metadata")
    )


@registered
def delete_apply(spark: SparkSession, folder: str) -> DataFrame:
    events = fixtures.table(spark, folder, "events")
    ids = events.where(F.col("event_type") == "error").select(F.col("event_id").cast("string").alias("id"))
    return maintain.delete(fixtures.memories(spark, folder), ids).select("id", "content_hash")


@registered
def store_update(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of ``update_apply`` in two calls, to a stored table."""
    root = scratch_folder(spark)
    snapshots.write_memories(_in_schema(fixtures.memories(spark, folder)), root, 16)
    changes = durable(_changes(spark, folder).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(2))))
    for part in (0, 1):
        maintain.update_stored(
            spark, root, changes.where(F.col("part") == part).drop("part"), embedder=embed.NativeHashingEmbedder(DIMENSIONS), now=NOW
        )
    return snapshots.read_memories(spark, root).select(
        "id",
        "content_hash",
        "metadata",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        F.coalesce(F.size("embedding"), F.lit(0)).alias("dimensions"),
    )


@registered
def store_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a stored table after errors were deleted; every event appended in batches by type."""
    root = scratch_folder(spark)
    # Not kept as a whole, which would be a second copy of the table: each batch joins its own events.
    rows = _in_schema(fixtures.event_memories(spark, folder))
    for kind in sorted(fixtures.TYPE_OF_EVENT.values()):
        snapshots.append_batch(rows.where(F.col("memory_type") == kind), root, kind, 16)
    gone = fixtures.table(spark, folder, "events").where(F.col("value") < 10).select(F.col("event_id").cast("string").alias("id"))
    maintain.delete_stored(spark, root, gone)
    return snapshots.read_rows(spark, root).select("id", "content_hash", F.col("batch").alias("memory_type"))


def _in_schema(memories: DataFrame) -> DataFrame:
    times = {c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")}
    return memories.withColumns(times).select(*MEMORIES.names)


class PatchyEmbedder(embed.HashingEmbedder):
    """A model without a vector for some texts, and one of a wrong size for others."""

    def embed_batch(self, texts: Sequence[str]) -> list:
        vectors = super().embed_batch(texts)
        return [None if len(t) % 5 == 0 else v[:3] if len(t) % 7 == 0 else v for t, v in zip(texts, vectors, strict=True)]


@registered
def ingest_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with empty texts and unknown types among them, through a model that fails for some."""
    turns = fixtures.conversation_batch(spark, folder).withColumn(
        "memory_type", F.when(F.col("turn") % 4 == 3, F.lit("note")).otherwise(F.col("memory_type"))
    ).withColumn("content", F.when(F.col("conv_id") % 9 == 0, F.lit("")).otherwise(F.col("content")))
    store = fixtures.memories(spark, folder)
    result = ingest.ingest(turns, store, PatchyEmbedder(DIMENSIONS), order_by=["conv_id", "turn"], batch_id="b2", now=NOW)
    return result.rejects.select("conv_id", "turn", "reason")


# --- embedding and search ---


@registered
def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.document_texts(spark, folder).withColumn("content_hash", text.content_hash(F.col("content")))
    embedded = embed.embed_distinct(rows, embed.NativeHashingEmbedder(DIMENSIONS))
    kept, _ = embed.check_dimensions(embedded, DIMENSIONS)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return kept.select("memory_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(squares), 4).alias("norm"))


@registered
def embed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all texts, components in millionths."""
    rows = fixtures.document_texts(spark, folder)
    vectors = embed.embed_keyed(rows, embed.NativeHashingEmbedder(DIMENSIONS), "memory_id", "content")
    millionths = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1_000_000).cast("string"))
    return vectors.select("memory_id", F.array_join(millionths, ",").alias("vector"))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "rank", six("score").alias("score"), six("distance").alias("distance"))


@registered
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(search.knn(fixtures.query_vectors(spark, folder), fixtures.memories(spark, folder), 5))


@registered
def knn_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    found = search.search(
        fixtures.query_vectors(spark, folder),
        fixtures.memories(spark, folder),
        5,
        flt=MemoryFilter(memory_type=FACT),
        columns=["user_id", "created_at"],
    )
    return found.select("query_id", "id", "rank", six("score").alias("score"), "user_id", "created_at")


def _scoped_queries(m: DataFrame) -> DataFrame:
    """Every memory asks for its own agent's earlier memories."""
    return m.where(F.col("embedding").isNotNull()).select(
        F.col("id").alias("query_id"), "embedding", "agent_id", F.col("created_at").alias("until")
    )


@registered
def knn_query_filters(spark: SparkSession, folder: str) -> DataFrame:
    m = fixtures.memories(spark, folder)
    return _hits(search.knn(_scoped_queries(m), m, 5))


@registered
def knn_cells(spark: SparkSession, folder: str) -> DataFrame:
    m = fixtures.memories(spark, folder)
    return _hits(search.knn(_scoped_queries(m), m, 5, strategy="cells"))


@registered
def knn_same_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Every event's memory asks for its own user's nearest ones of its own agent."""
    # Kept, as the search reads them more than once: without their texts.
    m = durable(fixtures.event_memories(spark, folder).select("id", "embedding", "user_id", "agent_id"))
    queries = m.select(F.col("id").alias("query_id"), "embedding", "user_id", "agent_id")
    return _hits(search.knn(queries, m, 3, strategy="scoped"))


@registered
def knn_min_score(spark: SparkSession, folder: str) -> DataFrame:
    queries, m = fixtures.query_vectors(spark, folder), fixtures.memories(spark, folder)
    return _hits(search.knn(queries, m, 10, min_score=LOW_THRESHOLD, strategy="cells"))


@registered
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    turns = fixtures.table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query"),
    )
    embedder = embed.NativeHashingEmbedder(DIMENSIONS)
    # Kept, as the search reads them more than once: without their texts.
    m = durable(embed.embed_distinct(fixtures.memories(spark, folder), embedder).drop("content"))
    hits, _ = search.text_search(turns, m, embedder, 5, columns=["memory_type"])
    return hits.select("query_id", "id", "rank", six("score").alias("score"), "memory_type")


@registered
def frequency_extract(spark: SparkSession, folder: str) -> DataFrame:
    events = fixtures.table(spark, folder, "events")
    # Numbers, strings, absent keys and broken JSON, by event type.
    given = (
        F.when(F.col("event_type") == "click", F.replace("props", F.lit('"k"'), F.lit('"access_count"')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"access_count": "'), F.col("value").cast("string"), F.lit('"}')))
        .when(F.col("event_type") == "error", F.col("props"))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"access_count": '), F.col("value").cast("string"), F.lit("}")))
        .otherwise(F.substring("props", 1, 4))
    )
    return events.select("event_id", metadata.access_count(given).alias("frequency"))


@registered
def recency_score(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.memories(spark, folder).select(
        "id", six(rank.recency(F.col("updated_at"), literal(NOW))).alias("recency")
    )


@registered
def hybrid_rank(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.search(
        fixtures.query_vectors(spark, folder),
        fixtures.memories(spark, folder),
        10,
        flt=MemoryFilter(memory_type=FACT),
        columns=["updated_at", "metadata"],
    )
    return rank.rerank(hits, now=NOW).select(
        "query_id",
        "id",
        six("similarity_score").alias("similarity_score"),
        six("recency_score").alias("recency_score"),
        six("frequency_score").alias("frequency_score"),
        six("final_score").alias("final_score"),
        "final_rank",
    )


@registered
def hybrid_rank_half_life(spark: SparkSession, folder: str) -> DataFrame:
    """Half-lives of a day, and one that is no half-life and leaves the default."""
    hits = search.search(fixtures.query_vectors(spark, folder), fixtures.memories(spark, folder), 5, columns=["updated_at", "metadata"])
    hits = durable(hits)
    day, default = (rank.rerank(hits, now=NOW, half_life=h) for h in (24.0, -1.0))
    columns = ["query_id", "id", six("recency_score").alias("recency_score"), "final_rank"]
    return day.select(F.lit("day").alias("half_life"), *columns).unionByName(default.select(F.lit("default").alias("half_life"), *columns))


# --- consolidation ---

SCOPE_OF_CYCLE = ("user_id",)


def _seeds_and_neighbours(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    m = fixtures.memories(spark, folder)
    seeds = durable(consolidate.find_seeds(m, SCOPE_OF_CYCLE))
    return seeds, consolidate.find_neighbours(seeds, m, LOW_THRESHOLD, SCOPE_OF_CYCLE)


@registered
def consolidate_clusters(spark: SparkSession, folder: str) -> DataFrame:
    seeds, near = _seeds_and_neighbours(spark, folder)
    return consolidate.greedy_clusters(seeds, near, SCOPE_OF_CYCLE, LOW_THRESHOLD)


def _cycle(spark: SparkSession, folder: str) -> consolidate.Consolidation:
    return consolidate.consolidate(
        fixtures.memories(spark, folder), SCOPE_OF_CYCLE, threshold=LOW_THRESHOLD, cutoff=LOW_THRESHOLD, now=NOW
    )


@registered
def consolidate_insights(spark: SparkSession, folder: str) -> DataFrame:
    return _cycle(spark, folder).insights.select(
        "user_id",
        F.sha2("content", 256).alias("content_hash"),
        F.array_join("source_ids", ",").alias("source_ids"),
        "insight_type",
        six("confidence").alias("confidence"),
    )


@registered
def consolidate_results(spark: SparkSession, folder: str) -> DataFrame:
    return _cycle(spark, folder).results


@registered
def consolidate_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    seeds, near = _seeds_and_neighbours(spark, folder)
    pairs = consolidate.contradictions(seeds, near, SCOPE_OF_CYCLE, LOW_THRESHOLD)
    return pairs.withColumn("score", six("score"))


@registered
def consolidate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies among the documents, by their own vectors and the default thresholds: 7 is none."""
    m = fixtures.memories(spark, folder).drop("embedding")
    embedded = durable(embed.embed_distinct(m, embed.NativeHashingEmbedder(DIMENSIONS)))
    return consolidate.consolidate(embedded, ("agent_id",), threshold=7, now=NOW).insights.select(
        "agent_id", F.array_join("source_ids", ",").alias("source_ids"), "insight_type", six("confidence").alias("confidence")
    )


@registered
def consolidate_large(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of scopes with thousands of seeds, in rounds."""
    # Not kept: it would have a copy of a text for each event, and texts are looked at for the seeds alone.
    m, scope = fixtures.event_memories(spark, folder), ("agent_id",)
    seeds = durable(consolidate.find_seeds(m, scope, 5_000))
    near = durable(consolidate.find_neighbours(seeds, m, LOW_THRESHOLD, scope, count=30))
    return consolidate.greedy_clusters(seeds, near, scope, LOW_THRESHOLD, walk_edges=1_000)


@registered
def text_excerpt_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Excerpts of texts with characters of two, three and four bytes."""
    wide = F.translate("text", "aeiot", "äé€𝄞ß")
    return fixtures.table(spark, folder, "documents").select("doc_id", text.clipped(wide, 80).alias("excerpt"))


@registered
def text_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.table(spark, folder, "documents").select(
        "doc_id", text.clipped(F.col("text"), 80).alias("excerpt")
    )


# --- knowledge graph ---


def _star_triples(spark: SparkSession, folder: str) -> DataFrame:
    return extract_triples(fixtures.star_sentences(spark, folder))


def _star_graph(spark: SparkSession, folder: str) -> graph.Graph:
    return graph.build(fixtures.star_sentences(spark, folder), now=NOW)


def _star_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The relations as a stored table, for queries that read it several times."""
    return durable(_star_graph(spark, folder).relations)


@registered
def graph_triples(spark: SparkSession, folder: str) -> DataFrame:
    return extract_triples(fixtures.document_texts(spark, folder)).select("memory_id", "subject", "predicate", "object")


@registered
def graph_triples_star(spark: SparkSession, folder: str) -> DataFrame:
    return _star_triples(spark, folder).select("memory_id", "subject", "predicate", "object")


@registered
def graph_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _star_graph(spark, folder).entities.select("id", "name", "type")


@registered
def graph_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return _star_graph(spark, folder).mentions.select("entity_id", "memory_id")


@registered
def graph_relations(spark: SparkSession, folder: str) -> DataFrame:
    return _star_graph(spark, folder).relations.select(
        "id", "from_id", "to_id", "type", "weight", F.array_join("memory_ids", ",").alias("memory_ids")
    )


@registered
def graph_upsert_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Upper-case part names written over the graph of the star sentences."""
    parts = fixtures.table(spark, folder, "part").select(F.upper("p_name").alias("name"), "p_partkey")
    fresh = parts.select(
        entity_id(F.col("name")).alias("id"),
        "name",
        F.lit("part").alias("type"),
        F.lit(None).cast("string").alias("metadata"),
        literal(UNTIL).cast("timestamp").alias("created_at"),
        literal(UNTIL).cast("timestamp").alias("updated_at"),
        "p_partkey",
    )
    stored = _star_graph(spark, folder).entities
    return graph.upsert_entities(stored, fresh, F.col("p_partkey")).select(
        "id",
        "name",
        "type",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
    )


@registered
def graph_entity_types(spark: SparkSession, folder: str) -> DataFrame:
    pages = fixtures.table(spark, folder, "pages").select(F.col("url").alias("name"))
    parts = fixtures.table(spark, folder, "part").select(F.col("p_name").alias("name"))
    names = pages.unionByName(parts)
    return names.select("name", entity_id(F.col("name")).alias("id"), entity_type(F.col("name")).alias("type"))


@registered
def graph_add_counts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.add_counts(fixtures.document_texts(spark, folder))


@registered
def graph_lookup(spark: SparkSession, folder: str) -> DataFrame:
    nations = fixtures.table(spark, folder, "nation").select(entity_id(F.col("n_name")).alias("id"))
    orders = fixtures.table(spark, folder, "orders").select(entity_id(F.col("o_orderpriority")).alias("id"))
    return graph.lookup_entities(nations.union(orders.distinct()), _star_graph(spark, folder).entities).select(
        "id", "name", "type"
    )


@registered
def graph_find(spark: SparkSession, folder: str) -> DataFrame:
    """Searches for every nation, every part size and the empty text."""
    return graph.find_entities_batch(_searches(spark, folder), durable(_star_graph(spark, folder).entities), 10)


@registered
def graph_find_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same searches against a stored graph with an index of its names."""
    entities, stored = durable(_star_graph(spark, folder).entities), scratch_folder(spark)
    snapshots.write_name_index(graph.name_index(entities), stored)
    queries = durable(_searches(spark, folder))
    index = snapshots.read_name_index(spark, stored, graph.asked_grams(queries))
    return graph.find_entities_batch(queries, entities, 10, index)


def _searches(spark: SparkSession, folder: str) -> DataFrame:
    nations = fixtures.table(spark, folder, "nation").select(F.col("n_name").alias("query"))
    sizes = fixtures.table(spark, folder, "part").select(F.col("p_size").cast("string").alias("query"))
    colours = fixtures.table(spark, folder, "part").select(F.upper(F.split("p_name", " ")[0]).alias("query"))
    empty = fixtures.table(spark, folder, "region").select(F.lit("").alias("query"))
    return nations.union(sizes).union(colours).union(empty).distinct().withColumn("query_id", F.col("query"))


def _places(spark: SparkSession, folder: str, name: str, column: str) -> DataFrame:
    return fixtures.table(spark, folder, name).select(entity_id(F.col(column)).alias("id"))


@registered
def graph_relations_of(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = _places(spark, folder, "supplier", "s_name")
    return graph.relations_of(suppliers, _star_graph(spark, folder).relations).select(
        "entity_id", "id", "from_id", "to_id", "type"
    )


@registered
def graph_khop2(spark: SparkSession, folder: str) -> DataFrame:
    g = _star_graph(spark, folder)
    nations = _places(spark, folder, "nation", "n_name")
    return graph.neighbours(nations, durable(g.relations), g.entities, 2).select("start_id", "id", "name", "distance")


@registered
def graph_khop3(spark: SparkSession, folder: str) -> DataFrame:
    g = _star_graph(spark, folder)
    regions = _places(spark, folder, "region", "r_name")
    return graph.neighbours(regions, durable(g.relations), g.entities, 3).select("start_id", "id", "distance")


@registered
def graph_khop_edges(spark: SparkSession, folder: str) -> DataFrame:
    nations = _places(spark, folder, "nation", "n_name")
    return graph.neighbour_relations(nations, _star_relations(spark, folder), 2).select(
        "start_id", "id", "from_id", "to_id"
    )


@registered
def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    g = _star_graph(spark, folder)
    return graph.counts(g.entities, g.relations)


@registered
def graph_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Walks of callers: one without a depth, one that asks for more than there is."""
    g = _star_graph(spark, folder)
    g = graph.Graph(g.entities, g.mentions, durable(g.relations))
    regions = _places(spark, folder, "region", "r_name")
    found = [graph.walk(regions, g, depth).select(F.lit(depth or 0).alias("asked"), "start_id", "id", "distance") for depth in (None, 9)]
    return found[0].unionByName(found[1])


def _grown_graph(spark: SparkSession, folder: str) -> graph.Graph:
    """The star sentences in two batches: the second is added to the stored graph of the first."""
    lines = durable(fixtures.star_sentences(spark, folder))
    first = F.col("memory_id") < "8"
    stored = scratch_folder(spark)
    snapshots.write_graph(graph.build(lines.where(first), now=NOW), stored)
    grown = scratch_folder(spark)
    snapshots.write_graph(graph.build(lines.where(~first), snapshots.read_graph(spark, stored), now=UNTIL), grown)
    return snapshots.read_graph(spark, grown)


@registered
def graph_add_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of a stored graph that was added to: created by the first batch that has them, changed by the last."""
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")]
    return _grown_graph(spark, folder).entities.select("id", "name", "type", *times)


@registered
def graph_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Relations and mentions of the same graph, as read back from its files."""
    g = _grown_graph(spark, folder)
    mentions = g.mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("memories"))
    return g.relations.join(mentions, F.col("from_id") == F.col("entity_id")).select(
        "id", "from_id", "to_id", "type", F.array_join("memory_ids", ",").alias("memory_ids"), "memories"
    )


# --- profiles ---


def _traits(spark: SparkSession, folder: str) -> DataFrame:
    return profile.observe(fixtures.observations(spark, folder))


@registered
def profile_traits(spark: SparkSession, folder: str) -> DataFrame:
    return _traits(spark, folder)


@registered
def profile_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Traits of the first days, then those of the later days merged in."""
    seen = fixtures.observations(spark, folder)
    split = literal(NOW).cast("timestamp_ntz")
    return profile.merge(
        profile.observe(seen.where(F.col("ts") < split)), profile.observe(seen.where(F.col("ts") >= split))
    )


@registered
def profile_lookup(spark: SparkSession, folder: str) -> DataFrame:
    customers = fixtures.table(spark, folder, "customer")
    wanted = customers.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.when(F.col("c_acctbal") > 0, F.lit("purchase")).otherwise(F.lit("refund")).alias("key"),
    )
    return profile.lookup(wanted, _traits(spark, folder)).select(
        "user_id", "key", "value", F.coalesce("occurrences", F.lit(0)).alias("occurrences")
    )


@registered
def profile_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.count(_traits(spark, folder))


@registered
def profile_top(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top(_traits(spark, folder), 2).select("user_id", "key", "occurrences", "rank")


@registered
def profile_summary(spark: SparkSession, folder: str) -> DataFrame:
    customers = fixtures.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    return profile.summaries(_traits(spark, folder), customers)


# --- streams, run to completion over the same tables ---


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = fixtures.table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read back what it wrote."""
    spark = stream.sparkSession
    target = scratch_folder(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{target}/checkpoint")
    if mode == "append":
        run = writer.outputMode(mode).format("parquet").start(f"{target}/rows")
    else:

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/rows")

        run = writer.outputMode(mode).foreachBatch(replace).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


@registered
def stream_triples(spark: SparkSession, folder: str) -> DataFrame:
    texts = _stream(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("memory_id"), F.col("text").alias("content")
    )
    return _finished(jobs.triple_stream(texts), "append").select("memory_id", "subject", "predicate", "object")


@registered
def graph_add_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The graph of the star sentences, which come in several micro-batches, not in their order."""
    target = scratch_folder(spark)
    lines = fixtures.star_sentences(spark, folder)
    lines.repartition(3, "content").write.parquet(f"{target}/in")
    arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/in")
    writer = jobs.graph_stream(arriving, f"{target}/graph")
    writer.trigger(availableNow=True).option("checkpointLocation", f"{target}/checkpoint").start().awaitTermination()
    g = graph.settled(snapshots.read_writes(spark, f"{target}/graph"))
    started = g.relations.groupBy("from_id").agg(F.count(F.lit(1)).alias("started"), F.max(F.element_at("memory_ids", 1)).alias("last_memory"))
    mentions = g.mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("memories"))
    joined = g.entities.join(mentions, F.col("id") == F.col("entity_id")).join(started, F.col("id") == F.col("from_id"), "left")
    return joined.select("id", "name", "type", "memories", F.coalesce("started", F.lit(0)).alias("started"), "last_memory")


@registered
def stream_traits(spark: SparkSession, folder: str) -> DataFrame:
    seen = _stream(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("key"),
        F.col("value").cast("string").alias("value"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    return _finished(jobs.trait_stream(seen), "complete")


@registered
def stream_type_stats(spark: SparkSession, folder: str) -> DataFrame:
    arriving = _stream(spark, folder, "events").select(
        F.col("event_type").alias("memory_type"), F.col("ts").alias("created_at")
    )
    return _finished(jobs.type_stats_stream(arriving), "complete")


@registered
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    arriving = _stream(spark, folder, "documents").select(
        F.col("text").alias("content"), F.lit(FACT).alias("memory_type"), F.col("lang").alias("agent_id"), "doc_id"
    )
    target = scratch_folder(spark)
    # A second stream on the same table, from a checkpoint of its own, adds the conversations and repeats nothing.
    talk = _stream(spark, folder, "conversations").select(
        F.col("text").alias("content"), F.lit(FACT).alias("memory_type"), F.lit("").alias("agent_id"), "conv_id", "turn"
    )
    for job, rows, order in (("documents", arriving, ["doc_id"]), ("talk", talk, ["conv_id", "turn"])):
        writer = jobs.ingest_stream(rows, f"{target}/memories", embed.NativeHashingEmbedder(DIMENSIONS), order_by=order, job=job)
        run = writer.trigger(availableNow=True).option("checkpointLocation", f"{target}/checkpoint-{job}").start()
        run.awaitTermination()
    return snapshots.read_memories(spark, f"{target}/memories").select(
        "content_hash", "memory_type", "agent_id", F.size("embedding").alias("dimensions")
    )
