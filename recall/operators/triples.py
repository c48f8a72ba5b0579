"""Texts to subject-predicate-object triples, and triples to graph rows. Stateless, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall.functions import text

# Marker found in a sentence, predicate it stands for; spaces count.
MARKERS = (
    (" uses ", "uses"),
    (" depends on ", "depends_on"),
    (" is a ", "is_a"),
    (" is an ", "is_a"),
    (" created ", "created"),
    (" built ", "created"),
    (" works with ", "works_with"),
    (" replaced ", "supersedes"),
    (" migrated to ", "supersedes"),
    (" switched to ", "supersedes"),
    (" is part of ", "part_of"),
    (" belongs to ", "part_of"),
    (" implemented ", "created"),
    (" added ", "created"),
    (" configured ", "configured"),
    (" prefers ", "prefers"),
    (" chose ", "prefers"),
)

# Words that make a name a technology.
TECHNOLOGIES = (
    "react", "go", "python", "rust", "docker", "kubernetes", "postgres", "redis", "nginx", "node",
    "typescript", "javascript", "vue", "angular", "django", "flask", "fastapi", "grpc", "graphql", "rest",
    "api", "sdk", "cli", "mcp", "openai", "gemini", "ollama", "pgvector", "git",
)

# File name endings.
FILE_ENDINGS = (".go", ".ts", ".py", ".js")

# Sizes in bytes.
SHORTEST_SENTENCE = 5
SHORTEST_NAME = 2
LONGEST_NAME = 100

# Passes every text that holds a marker in some case; the exact test follows it.
MAY_MATCH = "(?iu) (?:" + "|".join(marker.strip() for marker, _ in MARKERS) + ") "


def extract_triples(texts: DataFrame) -> DataFrame:
    """Triples of a table of texts with ``memory_id`` and ``content``; other columns come along.

    Every marker is tried on every sentence, at its first occurrence.
    ``sentence_pos`` and ``pattern_pos`` tell where a triple was found. A plain
    flat map: it runs on streams as it does on tables.
    """
    carried = [c for c in texts.columns if c != "content"]
    sentences = (
        # Most texts and sentences hold no marker and leave here.
        texts.where(F.col("content").rlike(MAY_MATCH))
        .select(*carried, F.posexplode(text.sentences(F.col("content"))).alias("sentence_pos", "_raw"))
        .where(F.col("_raw").rlike(MAY_MATCH))
        .select(*carried, "sentence_pos", text.trimmed(F.col("_raw")).alias("_sentence"))
        .where(F.octet_length("_sentence") >= SHORTEST_SENTENCE)
        .withColumn("_lower", text.lowered(F.col("_sentence")))
    )
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("_lower").contains(marker),
                    F.struct(
                        F.lit(number).alias("pattern_pos"),
                        F.lit(predicate).alias("predicate"),
                        F.locate(marker, F.col("_lower")).alias("_at"),
                        F.lit(len(marker)).alias("_length"),
                    ),
                )
                for number, (marker, predicate) in enumerate(MARKERS)
            ]
        )
    )
    matched = sentences.select(*carried, "sentence_pos", "_sentence", F.inline(hits))
    subject = F.substring(F.col("_sentence"), F.lit(1), F.col("_at") - 1)
    object_ = F.substring(F.col("_sentence"), F.col("_at") + F.col("_length"), F.char_length("_sentence"))
    # As an array element, a name is worked out once, not again for the size test.
    named = F.struct(
        text.clean_name(subject).alias("subject"), "predicate", text.clean_name(object_).alias("object")
    )
    return (
        matched.select(*carried, "sentence_pos", "pattern_pos", F.inline(F.array(named)))
        .where(_fits(F.col("subject")) & _fits(F.col("object")))
    )


def _fits(name: Column) -> Column:
    return F.octet_length(name).between(SHORTEST_NAME, LONGEST_NAME)


def entity_id(name: Column) -> Column:
    digest = F.sha2(text.lowered(name), 256)
    return F.concat(F.lit("ent_"), F.substring(digest, 1, 16))


def relation_id(from_id: Column, predicate: Column, to_id: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", from_id, predicate, to_id), 256)
    return F.concat(F.lit("rel_"), F.substring(digest, 1, 16))


def entity_type(name: Column) -> Column:
    """file, technology or concept, by the look of the name. Words match inside words."""
    low = text.lowered(name)
    is_path = low.contains(".") & (low.contains("/") | low.contains("\\"))
    is_file = is_path
    for ending in FILE_ENDINGS:
        is_file = is_file | low.endswith(ending)
    return (
        F.when(is_file, F.lit("file"))
        .when(low.rlike("|".join(TECHNOLOGIES)), F.lit("technology"))
        .otherwise(F.lit("concept"))
    )
