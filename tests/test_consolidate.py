from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall.operators import consolidate
from recall.schema import CLUSTER_THRESHOLD
from tests.data import START, hours, memories, memory
from tests.test_search import brute

NOW = datetime(2024, 2, 1)


def insights(result):
    return sorted(
        (r.user_id, r.insight_type, tuple(r.source_ids), r.content, round(r.confidence, 6)) for r in result.insights.collect()
    )


def test_two_close_memories_become_a_summary(spark):
    rows = [
        memory("a", "Go is fast", embedding=[1.0, 0.1], created_at=START),
        memory("b", "Go compiles quickly", embedding=[1.0, 0.0], created_at=START + hours(1)),
        memory("c", "unrelated", embedding=[0.0, 1.0], created_at=START + hours(2)),
    ]
    result = consolidate.consolidate(memories(spark, rows), ("user_id",), now=NOW)
    assert insights(result) == [
        ("", "summary", ("a", "b"), "Consolidated from 2 related memories. Latest: Go compiles quickly", 0.8)
    ]
    totals = result.results.first()
    assert (totals.processed_count, totals.merged_count) == (3, 2)
    assert result.insights.first().created_at == NOW


def test_correction_after_fact(spark):
    rows = [
        memory("f", 'uses "v1"', embedding=[1.0, 0.0], created_at=START),
        memory("late", "uses v3", embedding=[1.0, 0.01], created_at=START + hours(9)),
        memory("c", "uses v2", memory_type="correction", embedding=[1.0, 0.9], created_at=START + hours(1)),
        memory("alone", "z", user_id="bob", embedding=[-1.0, 0.0], created_at=START + hours(1)),
    ]
    result = consolidate.consolidate(memories(spark, rows), ("user_id",), threshold=1.0, now=NOW)
    contradictions = [r for r in result.insights.collect() if r.insight_type == "contradiction"]
    assert [list(r.source_ids) for r in contradictions] == [["f", "c"]]
    assert contradictions[0].content == (
        'Potential contradiction: fact "uses \\"v1\\"" may be superseded by correction "uses v2"'
    )
    assert contradictions[0].confidence == pytest.approx(1 / np.sqrt(1.81))
    processed = {r.user_id: (r.processed_count, r.merged_count) for r in result.results.collect()}
    assert processed["bob"] == (1, 0)


def test_threshold_setter():
    assert [consolidate.threshold_or_default(t) for t in (0.5, 1.0, 0, -1, 1.1)] == [0.5, 1.0] + [CLUSTER_THRESHOLD] * 3


def test_arguments_are_checked(spark):
    m = memories(spark, [memory("a")])
    with pytest.raises(ValueError):
        consolidate.consolidate(m, ())
    with pytest.raises(ValueError):
        consolidate.consolidate(m, ("user_id",), neighbour_scope="some")


def one_scope(rows, everything, threshold, cutoff):
    """One cycle as a loop: clusters as id tuples, and contradiction pairs."""
    recent = sorted(rows, key=lambda r: r["id"])
    recent = sorted(recent, key=lambda r: r["created_at"], reverse=True)[:200]
    if len(recent) < 2:
        return [], []
    by_id = {r["id"]: r for r in everything}

    def score(a, b):
        x, y = (np.asarray(v["embedding"], np.float32).astype(float) for v in (a, b))
        return float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))

    def nearest(r, k):
        return brute([{"query_id": "q", "embedding": r["embedding"]}], everything, k)["q"]

    visited, clusters, pairs = set(), [], []
    for seed in recent:
        if seed["id"] in visited or not seed["content"] or seed["embedding"] is None:
            continue
        visited.add(seed["id"])
        cluster = [seed["id"]]
        for other in nearest(seed, 10):
            if other not in visited and score(seed, by_id[other]) >= threshold:
                cluster.append(other)
                visited.add(other)
        if len(cluster) > 1:
            clusters.append(tuple(sorted(cluster, key=lambda i: (by_id[i]["created_at"], i))))
    facts = {r["id"]: r for r in recent if r["memory_type"] == "fact"}
    for c in recent:
        if c["memory_type"] != "correction" or not c["content"] or c["embedding"] is None:
            continue
        for other in nearest(c, 3):
            if other in facts and c["created_at"] >= facts[other]["created_at"] and score(c, facts[other]) > cutoff:
                pairs.append((other, c["id"]))
    return clusters, pairs


@pytest.mark.parametrize("seed", range(2))
def test_equals_a_loop_over_scopes(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 8))
    rows = []
    for i in range(420):
        vector = centres[rng.integers(0, 40)] + 0.35 * rng.normal(size=8)
        rows.append(
            memory(
                f"m{i:03}",
                "" if i % 41 == 0 else f"content {i}",
                user_id="big" if i % 3 else f"u{i % 4}",
                memory_type=["fact", "correction", "decision"][int(rng.integers(0, 3))],
                embedding=None if i % 29 == 0 else vector.astype(np.float32).tolist(),
                created_at=START + hours(int(rng.integers(0, 300))),
            )
        )
    result = consolidate.consolidate(memories(spark, rows).repartition(3), ("user_id",), now=NOW)
    got_clusters, got_pairs = {}, {}
    for r in result.insights.collect():
        target = got_clusters if r.insight_type == "summary" else got_pairs
        target.setdefault(r.user_id, []).append(tuple(r.source_ids))
    merged = {r.user_id: r.merged_count for r in result.results.collect()}
    for user in {r["user_id"] for r in rows}:
        clusters, pairs = one_scope([r for r in rows if r["user_id"] == user], rows, 0.85, 0.7)
        assert sorted(got_clusters.get(user, [])) == sorted(clusters)
        assert sorted(got_pairs.get(user, [])) == sorted(pairs)
        assert merged[user] == sum(map(len, clusters))
    assert sum(map(len, got_clusters.values())) > 10 and got_pairs


def test_neighbours_of_the_own_scope_only(spark):
    rows = [
        memory("a", "x", user_id="u", embedding=[1.0, 0.0]),
        memory("b", "y", user_id="v", embedding=[1.0, 0.0]),
        memory("c", "z", user_id="u", embedding=[0.0, 1.0]),
        memory("d", "z2", user_id="v", embedding=[0.0, -1.0]),
    ]
    m = memories(spark, rows)
    assert consolidate.consolidate(m, ("user_id",), now=NOW).insights.count() == 2
    assert consolidate.consolidate(m, ("user_id",), neighbour_scope="same", now=NOW).insights.count() == 0


def sequential(turns, takes):
    """Clusters by walking through the seeds in order."""
    visited, out = set(), []
    for seed in turns:
        if seed in visited:
            continue
        visited.add(seed)
        taken = [x for x in takes.get(seed, []) if x not in visited]
        visited.update(taken)
        out += [(seed, x) for x in ([seed, *taken] if taken else [])]
    return out


@pytest.mark.parametrize("walk_edges", [0, 40, 10**6])
@pytest.mark.parametrize("kind", ["random", "chain", "dense"])
def test_rounds_equal_the_sequential_pass(spark, walk_edges, kind):
    rng = np.random.default_rng(7)
    turns, near, expected = [], [], []
    for scope, n in (("a", 60), ("b", 9), ("c", 1)):
        ids = [f"{scope}{i:03}" for i in rng.permutation(n)]
        others = [f"x{i}" for i in range(n // 2)]
        takes = {}
        for place, seed in enumerate(ids):
            if kind == "chain":
                close = ids[max(0, place - 1) : place + 2]
                close = close if n < 20 else close[:10] if place < 16 else [seed]
            else:
                pool = [*ids, *others]
                close = [pool[i] for i in rng.integers(0, len(pool), 2 if kind == "random" else 12)]
            takes[seed] = list(dict.fromkeys([seed, *close]))
            near += [(seed, x, 1.0) for x in takes[seed]]
        turns += [(scope, seed, place + 1, True) for place, seed in enumerate(ids)]
        expected += [(scope, a, b) for a, b in sequential(ids, takes)]
    turns.append(("a", "silent", 1000, False))
    near.append(("silent", turns[0][1], 1.0))
    seeds = spark.createDataFrame(turns, "user_id string, id string, position int, searchable boolean")
    neighbours = spark.createDataFrame(near, "query_id string, id string, score double")
    found = consolidate.greedy_clusters(seeds, neighbours, ("user_id",), 0.5, walk_edges)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_caps_are_parameters(spark):
    rows = [memory(f"m{i:02}", f"t{i}", embedding=[1.0, 0.0], created_at=START + hours(i)) for i in range(30)]
    m = memories(spark, rows)
    # All vectors are equal, so every seed's neighbours are the smallest ids.
    assert consolidate.consolidate(m, now=NOW).results.first().merged_count == 11
    assert consolidate.consolidate(m, now=NOW, seeds=2, neighbours=4).results.first().merged_count == 5
    all_ = consolidate.consolidate(m, now=NOW, neighbours=30).insights.collect()
    assert [len(r.source_ids) for r in all_] == [30]


def test_texts_of_other_rows_are_not_looked_at(spark):
    """Seeds are found by scope, time and id; only then are their texts and vectors read."""
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") >= 2985, F.format_string("text %d", "id")).otherwise(F.raise_error("looked at")).alias("content"),
        F.lit("fact").alias("memory_type"),
        F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("user_id"),
        F.array(F.lit(1.0).cast("float")).alias("embedding"),
        F.timestamp_seconds(F.col("id")).alias("created_at"),
    )
    seeds = consolidate.find_seeds(rows, ("user_id",), 4).collect()
    assert sorted((r.user_id, r.position, r.id, r.excerpt) for r in seeds) == [
        (f"u{u}", p, str(n), f"text {n}") for u in range(3) for p, n in enumerate(range(2997 + u, 0, -3), 1) if p <= 4
    ]
