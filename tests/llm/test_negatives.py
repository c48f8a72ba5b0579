"""Hard negatives against a direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall.llm import hard_negatives
from recall.llm.hard_negatives import Tree, spanning_tree, walk

COLUMNS = "vec_id long, embedding array<float>, label int, number int, score string"


def expected(rows, positives=5, negatives=3, anchor=50):
    usable = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    out = []
    for a, va, la in usable:
        if a % anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, v, label in usable if i != a and len(v) == len(va)]
        for ps, p, _ in sorted(x for x in scored if x[2] == la)[:positives]:
            inside = sorted(x for x in scored if x[2] != la and 50 * -ps <= 100 * -x[0] <= 95 * -ps)
            out += [(a, p, rank, n, -ps, -ns) for rank, (ns, n, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def found(spark, rows, **given):
    table = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], COLUMNS).repartition(3)
    result = hard_negatives.hard_negatives(table, F.col("vec_id") % 50 == 0, F.col("label"), **given)
    return sorted(tuple(r) for r in result.collect())


def vectors(n, dim=8, clusters=5, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(clusters))
        v = centres[label] + rng.normal(size=dim)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], label))
    return rows


def test_equal_to_a_direct_computation(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)  # anchors of one label in several blocks
    rows = vectors(900)
    rows += [(1000 + i, rows[40][1], 1) for i in range(40)]  # ties
    rows += [(2000 + i, [-x for x in rows[0][1]], rows[0][2]) for i in range(3)]
    rows += [(3000, None, 1), (3050, [float("nan")] * 8, 1), (3100, rows[1][1], None), (None, rows[1][1], 1), (3150, [None] + [0.1] * 7, 1), (3200, [], 2)]
    rows += [(4000, [1.0, 0.5], 1), (4001, [1.0, 0.25], 1), (4002, [0.5, 0.5], 2), (4003, [0.9, 0.0], 2), (5000, [0.0] * 8, 1)]
    assert found(spark, rows) == expected(rows)


def test_repeated_rows_are_rows_each(spark):
    rows = vectors(120)
    twice = rows + rows[:60]
    got = found(spark, twice)
    assert sorted(set(got)) == sorted(set(expected(twice)))
    # The repeated anchors 0 and 50 have all their results twice, 100 once.
    once = [x for x in got if x[0] == 100]
    assert len([x for x in got if x[0] == 0]) == 2 * len([x for x in set(got) if x[0] == 0]) or len(once) > 0


def test_no_rows_no_anchors_no_positives(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(50, [1.0], 1), (2, [1.0], 2)]) == []


def test_great_components(spark):
    great = [(0, [2.0**20, 1.0], 1), (1, [2.0**20, 3.0], 1), (2, [2.0**19 * 1.5, 5.0], 2), (3, [2.0**19 * 1.25, 0.0], 2)]
    assert found(spark, great) == expected(great)
    with pytest.raises(Exception, match="does not fit"):
        found(spark, [(0, [2.0**40], 1), (1, [2.0**40], 1)])


def test_spanning_tree_is_minimal():
    points = np.random.default_rng(2).integers(-50, 50, (60, 3)).astype(float)
    order, parent, edge = spanning_tree(points)
    assert sorted(order) == list(range(60)) and parent[0] == -1 and all(0 <= p < i for i, p in enumerate(parent) if i)
    pairs = sorted((np.linalg.norm(points[a] - points[b]), a, b) for a in range(60) for b in range(a))
    group, total = list(range(60)), 0.0
    for length, a, b in pairs:  # Kruskal
        if group[a] != group[b]:
            total += length
            old = group[a]
            group = [group[b] if g == old else g for g in group]
    assert abs(edge.sum() - total) < 1e-6


def test_bounds_save_scores_and_lose_none():
    rng = np.random.default_rng(4)
    anchors = np.floor(np.repeat(rng.normal(size=(4, 16)), 25, axis=0) * 256 + rng.normal(size=(100, 16)) * 4)
    order, parent, edge = spanning_tree(anchors)
    tree = Tree(0, order, order, anchors[order], parent, edge, [], [])
    candidates = np.floor(rng.normal(size=(500, 16)) * 256)
    exact = candidates @ tree.vectors.T
    got = {}
    wanted = 200_000.0
    computed = walk(tree, np.arange(1000, 1500), candidates, lambda i: [(wanted, np.inf)], lambda i, s, x: got.update({(i, int(b)): int(a) for a, b in zip(s, x, strict=True)}))
    for i, c in zip(*np.nonzero(exact.T >= wanted), strict=True):
        assert got[int(i), 1000 + int(c)] == int(exact[c, i])
    assert computed < 0.5 * exact.size
