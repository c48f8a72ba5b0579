"""Table schemas, closed value sets and default limits."""

from __future__ import annotations

from pyspark.sql import types as T

# Memory types, in declaration order.
FACT = "fact"
CONVERSATION = "conversation"
DECISION = "decision"
CODE_PATTERN = "code_pattern"
CORRECTION = "correction"
MEMORY_TYPES = (FACT, CONVERSATION, DECISION, CODE_PATTERN, CORRECTION)

# The four scope dimensions; '' means "unset".
SCOPE = ("user_id", "agent_id", "app_id", "run_id")

# Default sizes and limits.
DEFAULT_K = 10
DEFAULT_PAGE = 20
DEFAULT_GRAPH_LIMIT = 10
MAX_GRAPH_DEPTH = 3
SEEDS_PER_SCOPE = 200
NEIGHBOURS_PER_SEED = 10
NEIGHBOURS_PER_CORRECTION = 3
CLUSTER_THRESHOLD = 0.85
CONTRADICTION_CUTOFF = 0.7
SUMMARY_CONFIDENCE = 0.8
EXCERPT_LENGTH = 80
HALF_LIFE_HOURS = 168.0
SUMMARY_TRAITS = 10


def _string(name: str, nullable: bool = False) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable)


EMBEDDING = T.ArrayType(T.FloatType(), containsNull=False)

MEMORIES = T.StructType(
    [
        _string("id"),
        _string("content"),
        _string("memory_type"),
        *[_string(c) for c in SCOPE],
        _string("metadata"),
        _string("content_hash"),
        T.StructField("embedding", EMBEDDING, True),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

ENTITIES = T.StructType(
    [
        _string("id"),
        _string("name"),
        _string("type"),
        _string("metadata", True),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

# One row per (entity, memory): an entity can be mentioned by any share of all
# memories, so its memory ids are rows, not an array inside one entity row.
ENTITY_MEMORIES = T.StructType(
    [_string("entity_id"), _string("memory_id"), T.StructField("first_seen", T.TimestampType(), False)]
)

RELATIONS = T.StructType(
    [
        _string("id"),
        _string("from_id"),
        _string("to_id"),
        _string("type"),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("memory_ids", T.ArrayType(T.StringType(), False), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

TRAITS = T.StructType(
    [
        _string("user_id"),
        _string("key"),
        _string("value"),
        T.StructField("occurrences", T.LongType(), False),
        T.StructField("first_seen", T.TimestampType(), False),
        T.StructField("last_seen", T.TimestampType(), False),
    ]
)


def positive_or(value: int | None, default: int) -> int:
    """``value`` if it is a positive number, else ``default``."""
    return value if value is not None and value > 0 else default


def clamp_depth(depth: int | None) -> int:
    """Traversal depth accepted from callers: 1 when unset, never above the maximum."""
    return min(positive_or(depth, 1), MAX_GRAPH_DEPTH)
