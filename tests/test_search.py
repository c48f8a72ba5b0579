import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recall.functions import topk
from recall.operators import search
from recall.operators.embed import HashingEmbedder, NativeHashingEmbedder, embed
from recall.operators.filters import MemoryFilter
from recall.plans import neighbours
from tests.data import START, hours, memories, memory

QUERIES = "query_id string, embedding array<float>"


def brute(queries, rows, k, allowed=lambda q, r: True):
    """k nearest per query, one pair at a time."""
    out = {}
    for q in queries:
        a = np.asarray(q["embedding"], np.float32).astype(float)
        scored = []
        for r in rows:
            if r["embedding"] is None or not allowed(q, r):
                continue
            b = np.asarray(r["embedding"], np.float32).astype(float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            d = round(1 - min(1.0, max(-1.0, float(a @ b) / n)), 12) if n else float("inf")
            scored.append((d, r["id"]))
        out[q["query_id"]] = [i for _, i in sorted(scored)[:k]]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def clustered(seed, n, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return (centres[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32)


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE_BYTES", 8 * 6 * 7)
    monkeypatch.setattr(neighbours, "PIVOTS", 12)


def example(spark, seed):
    vectors = clustered(seed, 120)
    vectors[10:50] = vectors[9]  # a third of all rows are copies of one
    vectors[60] = 0
    rows = [
        memory(f"m{i:03}", embedding=v.tolist() if i % 17 else None, agent_id=["", "x", "y"][i % 3], created_at=START + hours(i))
        for i, v in enumerate(vectors)
    ]
    asked = clustered(seed + 100, 25)
    asked[3] = vectors[9]
    asked[4] = 0
    queries = [
        {"query_id": f"q{i:02}", "embedding": v.tolist(), "agent_id": ["", "x"][i % 2], "until": START + hours(4 * i)}
        for i, v in enumerate(asked)
    ]
    return rows, queries


@pytest.mark.parametrize("strategy", ["scan", "cells"])
@pytest.mark.parametrize("k", [1, 4])
def test_equals_brute_force(spark, small_slices, strategy, k):
    rows, queries = example(spark, k)
    q = spark.createDataFrame([(x["query_id"], x["embedding"]) for x in queries], QUERIES)
    got = search.knn(q, memories(spark, rows).repartition(4), k, strategy=strategy)
    assert ranked(got) == brute(queries, rows, k)


@pytest.mark.parametrize("strategy", ["scan", "cells"])
def test_filters_of_each_query(spark, small_slices, strategy):
    rows, queries = example(spark, 7)
    q = spark.createDataFrame(
        [(x["query_id"], x["embedding"], x["agent_id"], x["until"]) for x in queries],
        QUERIES + ", agent_id string, until timestamp",
    )
    got = search.knn(q, memories(spark, rows), 5, strategy=strategy)
    want = brute(queries, rows, 5, lambda q, r: q["agent_id"] in ("", r["agent_id"]) and r["created_at"] <= q["until"])
    assert ranked(got) == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("strategy", ["scan", "cells"])
def test_min_score_keeps_all_that_are_similar_enough(spark, small_slices, strategy):
    rows, queries = example(spark, 9)
    q = spark.createDataFrame([(x["query_id"], x["embedding"]) for x in queries], QUERIES)
    m = memories(spark, rows)
    full = search.knn(q, m, 30, strategy="scan").where("score >= 0.9")
    assert ranked(search.knn(q, m, 30, min_score=0.9, strategy=strategy)) == ranked(full)


def test_undefined_distances_come_last(spark):
    m = memories(spark, [memory("zero", embedding=[0.0, 0.0]), memory("far", embedding=[-1.0, 0.0]), memory("none")])
    q = spark.createDataFrame([("q", [2.0, 0.0])], QUERIES)
    for strategy in ("scan", "cells"):
        got = search.knn(q, m, 5, strategy=strategy).orderBy("rank").collect()
        assert [(r.id, r.score, r.distance) for r in got] == [("far", -1.0, 2.0), ("zero", None, None)]


def test_only_zero_vectors(spark):
    m = memories(spark, [memory("b", embedding=[0.0, 0.0]), memory("a", embedding=[0.0, 0.0])])
    q = spark.createDataFrame([("q", [2.0, 0.0])], QUERIES)
    for strategy in ("scan", "cells"):
        assert ranked(search.knn(q, m, 1, strategy=strategy)) == {"q": ["a"]}


def test_no_queries_no_hits(spark):
    q = spark.createDataFrame([], QUERIES)
    assert search.knn(q, memories(spark, [memory("a", embedding=[1.0])])).count() == 0


def test_default_k_and_pushed_filter(spark):
    m = memories(spark, [memory(f"{i:02}", embedding=[1.0, float(i)], memory_type="fact" if i % 2 else "decision") for i in range(40)])
    q = spark.createDataFrame([("q", [1.0, 0.0])], QUERIES)
    got = ranked(search.knn(q, m, 0, flt=MemoryFilter(memory_type="fact")))
    assert got == {"q": [f"{i:02}" for i in range(1, 21, 2)]}


def test_distance_of_two_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r.d for r in df.select(search.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [1.0, 0.0, None]


def test_text_search(spark):
    model = HashingEmbedder(64)
    m = embed(memories(spark, [memory("go", "Go is great"), memory("py", "Python is slow")]).drop("embedding"), model)
    q = spark.createDataFrame([("1", "great Go"), ("2", ""), ("3", None)], "query_id string, query string")
    hits, rejects = search.text_search(q, m, model, 1, columns=["content"])
    assert [(r.query_id, r.content) for r in hits.collect()] == [("1", "Go is great")]
    assert {r.query_id: r.reason for r in rejects.collect()} == {"2": search.EMPTY_QUERY, "3": search.EMPTY_QUERY}


def test_native_model_gives_the_same_vectors(spark):
    texts = ["", "one Two two", "İstanbul ΣΑΣ straße ÉCOLE x_1 ٣", "a-b.c  a\tb", "日本 語", None, "word " * 5000, "!!! ..."]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, query string")
    found = {r.id: r.embedding for r in NativeHashingEmbedder(16).vectors(rows, "id", "query").collect()}
    model = HashingEmbedder(16)
    for i, text in enumerate(texts):
        assert found[i] == (None if text is None else model.embed_batch([text])[0].tolist())


@pytest.mark.parametrize("strategy", ["scan", "cells", "scoped"])
def test_queries_of_a_scope(spark, small_slices, monkeypatch, strategy):
    vectors = clustered(5, 150)
    vectors[20:60] = vectors[19]
    users = ["hot" if i % 3 == 0 else f"u{i % 11}" for i in range(150)]
    rows = [memory(f"m{i:03}", embedding=v.tolist(), user_id=u, agent_id="xy"[i % 2]) for i, (v, u) in enumerate(zip(vectors, users, strict=True))]
    asked = [{"query_id": f"q{i}", "embedding": vectors[i].tolist(), "user_id": users[i], "agent_id": "" if i % 4 else "x"} for i in range(0, 150, 2)]
    queries = spark.createDataFrame([tuple(q.values()) for q in asked], f"{QUERIES}, user_id string, agent_id string").repartition(3)
    expected = brute(asked, rows, 4, lambda q, r: q["user_id"] == r["user_id"] and q["agent_id"] in ("", r["agent_id"]))
    found = search.knn(queries, memories(spark, rows), 4, strategy=strategy)
    assert ranked(found) == {q: ids for q, ids in expected.items() if ids}


def test_scoped_rows_before_the_last_exchange(spark, small_slices):
    """A query sends at most k rows for each slice of its own group, however many groups there are."""
    rows = [memory(f"m{i:03}", embedding=v.tolist(), user_id=f"u{i % 30}") for i, v in enumerate(clustered(6, 240))]
    m = memories(spark, rows)
    queries = m.select(F.col("id").alias("query_id"), "embedding", "user_id")
    request = neighbours.Request(2, 6, ("user_id",), float("inf"))
    partial = neighbours.scoped(queries, m, request, ["user_id"]).collect()
    slices = {}
    for r in partial:
        slices[r.query_id] = slices.get(r.query_id, 0) + 1
    # 240 memories in slices of 7 rows: some groups have several, none has more than a few.
    assert set(slices) == {r["id"] for r in rows} and max(slices.values()) <= 2 * 6


def test_vectors_of_another_size(spark):
    rows = [memory("a", embedding=[1.0, 0.0]), memory("b", embedding=[1.0, 0.0, 0.0]), memory("c", embedding=[0.0, 1.0])]
    queries = spark.createDataFrame([("q", [1.0, 0.0])], QUERIES)
    for strategy in ("scan", "cells"):
        assert ranked(search.knn(queries, memories(spark, rows), 5, strategy=strategy)) == {"q": ["a", "c"]}
    with pytest.raises(ValueError, match="2 to 3 dimensions"):
        search.knn(queries.union(spark.createDataFrame([("r", [1.0, 0.0, 0.0])], QUERIES)), memories(spark, rows), 5)


def test_equal_queries_and_memories_are_compared_once():
    """Every copy gets its answer, and all copies among the memories are found, by one comparison."""
    ids = pa.array([f"{i:03}" for i in range(300)])
    vectors = topk.unit(clustered(3, 300).astype(float))
    vectors[100:] = vectors[np.arange(200) % 4]
    asked = topk.Block(ids, vectors)
    best = topk.TopK(asked, 60)
    best.offer(asked)
    assert len(best.queries) == 100
    found = {}
    for row in best.result().to_pylist():
        found.setdefault(row["query_id"], []).append((row["distance"], row["id"]))
    distances = topk.distances(vectors, vectors)
    for i, name in enumerate(ids.to_pylist()):
        expected = sorted(zip(distances[i].tolist(), ids.to_pylist(), strict=True))[:60]
        assert [x for _, x in sorted(found[name])] == [x for _, x in expected]


@pytest.mark.parametrize("filtered", [False, True])
def test_vectors_without_clusters_are_not_sent_to_cells(spark, monkeypatch, filtered):
    """Where bounds exclude nothing, a row moves once for each slice of the other side, not once for each cell."""
    moved = []

    def compared(asked, stored, request, compared=neighbours._compared):
        moved.append((asked.count(), stored.count()))
        return compared(asked, stored, request)

    monkeypatch.setattr(neighbours, "_compared", compared)
    monkeypatch.setattr(neighbours, "SLICE_BYTES", 8 * 32 * 150)
    vectors = np.random.default_rng(8).normal(size=(300, 32)).astype(np.float32)
    rows = [memory(f"m{i:03}", embedding=v.tolist(), agent_id="xy"[i % 2]) for i, v in enumerate(vectors)]
    asked = [{"query_id": f"q{i:03}", "embedding": vectors[i].tolist(), "agent_id": "x" if filtered and i % 3 else ""} for i in range(300)]
    queries = spark.createDataFrame([tuple(q.values()) for q in asked], f"{QUERIES}, agent_id string")
    found = ranked(search.knn(queries, memories(spark, rows), 3, strategy="cells"))
    assert found == brute(asked, rows, 3, lambda q, r: q["agent_id"] in ("", r["agent_id"]))
    assert moved == [(600, 600)]


@pytest.mark.parametrize("strategy", ["cells", "blocks", "scoped"])
def test_searches_that_move_much_go_in_waves(spark, small_slices, monkeypatch, strategy):
    """What is moved never lies on disk as a whole, and the hits are the same."""
    monkeypatch.setattr(neighbours, "MOVED_BYTES", 40 * (4 * 6 + 64), raising=False)
    if strategy == "blocks":
        monkeypatch.setattr(neighbours, "_block_slices", lambda *_: (9, 18))
        monkeypatch.setattr(neighbours, "reachable", lambda queries, cells, request: np.ones((len(queries), len(cells.occupied)), bool))
    moved, compared = [], neighbours._compared

    def counted(asked, stored, request):
        moved.append(asked.count() + stored.count())
        return compared(asked, stored, request)

    monkeypatch.setattr(neighbours, "_compared", counted)
    vectors = clustered(5, 120) if strategy != "blocks" else np.random.default_rng(4).normal(size=(120, 6)).astype(np.float32)
    users = ["hot" if i % 2 == 0 else f"u{i % 3}" for i in range(120)]
    rows = [memory(f"m{i:03}", embedding=v.tolist(), user_id=u) for i, (v, u) in enumerate(zip(vectors, users, strict=True))]
    asked = [{"query_id": f"q{i}", "embedding": vectors[i].tolist(), "user_id": users[i] if strategy == "scoped" else ""} for i in range(0, 120, 2)]
    queries = spark.createDataFrame([tuple(q.values()) for q in asked], f"{QUERIES}, user_id string")
    expected = brute(asked, rows, 4, lambda q, r: q["user_id"] in ("", r["user_id"]))
    found = search.knn(queries, memories(spark, rows), 4, strategy="scoped" if strategy == "scoped" else "cells")
    assert ranked(found) == expected
    assert len(moved) > 3 and max(moved) <= sum(moved) / 2
