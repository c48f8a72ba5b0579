import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recall.operators import ingest
from recall.operators.embed import HashingEmbedder, check_dimensions, embed
from recall.schema import SCOPE
from tests.data import memories, memory, sha

NOW = datetime(2024, 5, 1)
BATCH = "content string, memory_type string, user_id string, agent_id string, app_id string, run_id string, metadata string, n long"


def batch(spark, rows):
    full = []
    for n, row in enumerate(rows):
        r = {"memory_type": "fact", "user_id": None, "agent_id": None, "app_id": None, "run_id": None, "metadata": None, **row}
        full.append((r["content"], r["memory_type"], r["user_id"], r["agent_id"], r["app_id"], r["run_id"], r["metadata"], n))
    return spark.createDataFrame(full, BATCH)


def run(spark, rows, store=(), embedder=None):
    return ingest.ingest(
        batch(spark, rows), memories(spark, list(store)), embedder or HashingEmbedder(16), order_by=["n"], batch_id="b", now=NOW
    )


def test_same_content_becomes_one_row(spark):
    result = run(spark, [{"content": "same content"}, {"content": "same content", "memory_type": "decision"}])
    row = result.new_rows.collect()
    assert len(row) == 1
    assert row[0].content_hash == sha("same content") and len(row[0].content_hash) == 64
    assert row[0].metadata == "{}" and row[0].user_id == ""
    assert row[0].memory_type == "fact"
    assert row[0].created_at == row[0].updated_at == NOW
    assert len(row[0].embedding) == 16
    repeated = result.duplicates.collect()
    assert [(r.n, r.duplicate_of) for r in repeated] == [(1, row[0].id)]


def test_validation_looks_at_the_type_first(spark):
    rows = [
        {"content": "", "memory_type": "unknown"},
        {"content": "x", "memory_type": ""},
        {"content": "x", "memory_type": "Fact"},
        {"content": "", "memory_type": "fact"},
        {"content": "  ", "memory_type": "correction"},
    ]
    result = run(spark, rows)
    reasons = {r.n: r.reason for r in result.rejects.collect()}
    assert reasons == {0: ingest.INVALID_TYPE, 1: ingest.INVALID_TYPE, 2: ingest.INVALID_TYPE, 3: ingest.EMPTY_CONTENT}
    assert result.new_rows.count() == 1


def test_scope_is_asymmetric(spark):
    scoped, plain = {"content": "c", "user_id": "alice"}, {"content": "c"}
    assert run(spark, [scoped, plain]).new_rows.count() == 1
    assert run(spark, [plain, scoped]).new_rows.count() == 2


def test_stored_rows_come_first(spark):
    store = [memory("old", "c", user_id="alice"), memory("other", "d")]
    result = run(spark, [{"content": "c"}, {"content": "c", "user_id": "bob"}], store)
    assert [r.user_id for r in result.new_rows.collect()] == ["bob"]
    assert [r.duplicate_of for r in result.duplicates.collect()] == ["old"]


def test_ids_are_stable_and_unique(spark):
    rows = [{"content": "c", "user_id": u} for u in ("a", "b", "c")]
    first = sorted(r.id for r in run(spark, rows).new_rows.collect())
    again = sorted(r.id for r in run(spark, rows).new_rows.repartition(3).collect())
    assert first == again and len(set(first)) == 3


class FailingEmbedder(HashingEmbedder):
    def embed_batch(self, texts):
        return [None if "bad" in t else [1.0] * (3 if "short" in t else self.dimensions) for t in texts]


def test_rows_without_a_proper_vector_are_rejected(spark):
    result = run(spark, [{"content": "bad"}, {"content": "short"}, {"content": "good"}], embedder=FailingEmbedder(4))
    assert {r.content: r.reason for r in result.rejects.collect()} == {
        "bad": "no embedding",
        "short": "wrong embedding size",
    }
    assert [r.content for r in result.new_rows.collect()] == ["good"]


def test_every_row_has_one_outcome(spark):
    rng = random.Random(5)
    rows = [
        {"content": rng.choice(["a", "b", "", "c"]), "memory_type": rng.choice(["fact", "nope"]), "user_id": rng.choice([None, "u"])}
        for _ in range(60)
    ]
    result = run(spark, rows)
    assert result.new_rows.count() + result.duplicates.count() + result.rejects.count() == 60


@pytest.mark.parametrize("seed", range(4))
def test_dedup_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [
        (n, sha(rng.choice("xyz" if rng.random() < 0.7 else "pqrstuvw")), *[rng.choice(["", "1", "2"]) for _ in SCOPE])
        for n in range(400)
    ]
    kept: list[tuple] = []
    expected = {}
    for row in rows:
        n, digest, *scope = row
        hit = next(
            (k for k in kept if k[1] == digest and all(w in ("", have) for w, have in zip(scope, k[2:]))), None
        )
        if hit is None:
            kept.append(row)
        expected[n] = n if hit is None else hit[0]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ["n", "content_hash", *SCOPE]).repartition(5)
    got = {r.n: r.first for r in ingest.dedup(df, "n").collect()}
    assert got == expected


def test_a_third_of_all_rows_with_one_text(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("content_hash"),
        *[F.when(F.col("id") % (i + 2) == 0, F.lit("")).otherwise((F.col("id") % 50).cast("string")).alias(c) for i, c in enumerate(SCOPE)],
    )
    result = ingest.dedup(rows, "n")
    assert result.count() == 30000
    # A kept row is never a repeat of another kept row.
    kept = result.where("first = n").select("n")
    assert result.select(F.col("first").alias("n")).distinct().exceptAll(kept).count() == 0


def test_embedding_is_deterministic_and_of_unit_length(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("",), (None,)], "content string")
    a, b, empty, none = [r.embedding for r in embed(df, HashingEmbedder(8)).collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6
    assert empty == [0.0] * 8 and none is None


def test_wrong_dimensions_are_split_off(spark):
    df = memories(spark, [memory("a", embedding=[1.0, 0.0]), memory("b", embedding=[1.0]), memory("c")])
    kept, refused = check_dimensions(df, 2)
    assert [r.id for r in kept.collect()] == ["a"]
    assert {r.id for r in refused.collect()} == {"b", "c"}
