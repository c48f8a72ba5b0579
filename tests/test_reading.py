"""Filters, lookups, lists and statistics."""

from datetime import timedelta

import pytest

from recall.operators import listing, stats
from recall.operators.filters import MemoryFilter, lookup_hashes, lookup_ids, of_type, with_embedding
from recall.operators.ingest import normalised
from recall.schema import clamp_depth, positive_or
from tests.data import START, hours, memories, memory, sha


def rows(spark):
    return memories(
        spark,
        [
            memory("a", "x", user_id="alice", created_at=START),
            memory("b", "y", user_id="alice", agent_id="cursor", memory_type="decision", created_at=START + hours(1)),
            memory("c", "x", user_id="bob", app_id="my-app", created_at=START + hours(2), embedding=[1.0]),
            memory("d", "z", run_id="run-1", created_at=START + hours(3)),
        ],
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(spark):
    m = rows(spark)
    assert ids(MemoryFilter().apply(m)) == ["a", "b", "c", "d"]
    assert ids(MemoryFilter(user_id="alice").apply(m)) == ["a", "b"]
    assert ids(MemoryFilter(user_id="alice", agent_id="cursor").apply(m)) == ["b"]
    assert ids(MemoryFilter(app_id="my-app").apply(m)) == ["c"]
    assert ids(MemoryFilter(run_id="run-1").apply(m)) == ["d"]
    assert ids(MemoryFilter(memory_type="decision").apply(m)) == ["b"]
    assert ids(MemoryFilter(since=START + hours(1), until=START + hours(2)).apply(m)) == ["b", "c"]
    assert ids(MemoryFilter(since=START + hours(1) + timedelta(microseconds=1)).apply(m)) == ["c", "d"]
    assert ids(of_type(m, "fact")) == ["a", "c", "d"]
    assert ids(with_embedding(m)) == ["c"]


def test_lookup_ids(spark):
    got = lookup_ids(spark.createDataFrame([("a",), ("nope",)], "id string"), rows(spark)).collect()
    assert {r.id: (r.found, r.content) for r in got} == {"a": (True, "x"), "nope": (False, None)}


def test_lookup_hash(spark):
    wanted = spark.createDataFrame(
        [(1, sha("x"), ""), (2, sha("x"), "bob"), (3, sha("y"), "bob"), (4, sha("?"), "")],
        "n int, content_hash string, user_id string",
    )
    got = lookup_hashes(wanted, rows(spark)).collect()
    assert {r.n: r.id for r in got} == {1: "a", 2: "c", 3: None, 4: None}
    later = lookup_hashes(wanted, rows(spark), MemoryFilter(since=START + hours(1)))
    assert {r.n: r.id for r in later.collect()} == {1: "c", 2: "c", 3: None, 4: None}


def test_pages(spark):
    m = rows(spark)
    page = listing.page(m, MemoryFilter(user_id="alice"))
    assert "embedding" not in page.columns
    assert [r.id for r in page.collect()] == ["b", "a"]
    assert [r.id for r in listing.page(m, limit=2, offset=1).collect()] == ["c", "b"]
    assert listing.page(m, limit=-1).count() == 4
    assert listing.total(m, MemoryFilter(user_id="alice")).first().total == 2


def test_newest_per_scope(spark):
    got = listing.newest_per_scope(rows(spark), ["user_id"], 1).collect()
    assert {r.user_id: r.id for r in got} == {"alice": "b", "bob": "c", "": "d"}


def test_stats(spark):
    m = memories(spark, [memory("1"), memory("2", memory_type="decision"), memory("3", created_at=START + hours(5))])
    row = stats.summary(m).first()
    assert (row.total, row.by_type) == (3, {"fact": 2, "decision": 1})
    assert (row.oldest_at, row.newest_at) == (START, START + hours(5))
    empty = stats.summary(m, MemoryFilter(user_id="nobody")).first()
    assert (empty.total, empty.by_type, empty.oldest_at) == (0, {}, None)
    assert {r.user_id: r.total for r in stats.count_by_user(rows(spark)).collect()} == {"alice": 2, "bob": 1, "": 1}
    assert stats.time_range(m, MemoryFilter(user_id="x")).first().newest_at is None


def test_normalised_fills_absent_values(spark):
    df = spark.createDataFrame([("c", None, None)], "content string, user_id string, metadata string")
    row = normalised(df).first()
    assert (row.user_id, row.run_id, row.metadata) == ("", "", "{}")


def test_default_sizes():
    assert [positive_or(v, 10) for v in (None, 0, -3, 4)] == [10, 10, 10, 4]
    assert [clamp_depth(v) for v in (None, 0, 2, 9)] == [1, 1, 2, 3]


@pytest.mark.parametrize(("limit", "offset"), [(5, 0), (7, 93), (40, 55), (10, 195), (10, 200), (500, 0)])
def test_deep_pages_equal_shallow_ones(spark, limit, offset):
    rows = [memory(f"m{i * 37 % 200:03}", f"text {i}", created_at=START + hours(i // 30)) for i in range(200)]
    m = memories(spark, rows).repartition(5)
    columns = ["id", "content", "created_at"]
    shallow = [tuple(r) for r in listing.page(m, None, limit, offset).select(columns).collect()]
    deep = listing.page(m, None, limit, offset, shallow=0)
    assert "embedding" not in deep.columns
    assert sorted(tuple(r) for r in deep.select(columns).collect()) == sorted(shallow)


def test_deep_pages_rank_touched_partitions_only(spark, monkeypatch):
    m = memories(spark, [memory(f"m{i:04}", created_at=START + hours(i)) for i in range(2000)])
    seen = []
    real = listing.durable
    monkeypatch.setattr(listing, "durable", lambda df: seen.append(df) or real(df))
    assert listing.page(m, None, 20, 1000, shallow=0).count() == 20
    # The second table is made from the first by a filter on its partitions, which reaches the scan.
    plan = seen[1]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "_part" in plan.split("PushedFilters")[1].split("]")[0]
    assert listing.page(m, None, 20, 5000, shallow=0).count() == 0


def test_newest_of_a_hot_scope(spark, monkeypatch):
    """A scope with half of all rows sends at most n rows of each part to its last task."""
    rows = [memory(f"m{i:04}", user_id="hot" if i % 2 else f"u{i % 50}", created_at=START + hours(i * 7919 % 500)) for i in range(1000)]
    m = memories(spark, rows).repartition(6)
    found = {}
    for r in listing.newest_per_scope(m, ["user_id"], 4).collect():
        found.setdefault(r.user_id, []).append((r.position, r.id))
    for user, got in found.items():
        ordered = sorted((r for r in rows if r["user_id"] == user), key=lambda r: (-r["created_at"].timestamp(), r["id"]))
        assert sorted(got) == [(i + 1, r["id"]) for i, r in enumerate(ordered[:4])]
    narrow = m.select("user_id", "created_at", "id")
    plan = listing.newest_per_scope(narrow, ["user_id"], 4)._jdf.queryExecution().executedPlan().toString()
    # Ranked by part and scope, each with its limit before the shuffle.
    assert plan.count("WindowGroupLimit") >= 3
