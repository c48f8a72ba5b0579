import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recall.functions import text
from recall.operators import graph
from recall.operators.triples import entity_id, entity_type, extract_triples, relation_id
from recall.schema import ENTITIES, RELATIONS
from recall.sources import snapshots
from tests.data import sha

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "memory_id string, content string")


def triples(spark, content):
    found = extract_triples(texts(spark, ("m", content))).orderBy("sentence_pos", "pattern_pos")
    return [(r.subject, r.predicate, r.object) for r in found.collect()]


@pytest.mark.parametrize(
    "content, expected",
    [
        (
            "The project uses PostgreSQL. React depends on Node. User migrated to Go.",
            [("The project", "uses", "PostgreSQL"), ("React", "depends_on", "Node"), ("User", "supersedes", "Go")],
        ),
        ("A uses B", []),
        ('"Foo" uses "Bar baz" ', [("Foo", "uses", "Bar baz")]),
        ('We said: app uses "Foo".', [("We said: app", "uses", '"Foo"')]),
        ("  App\u00a0 USES  Redis cache!!\nIt is an old thing?", [("App", "uses", "Redis cache"), ("It", "is_a", "old thing")]),
        ("main.go uses net", [("go", "uses", "net")]),
        ("Bob created X and built y", [("Bob", "created", "X and built y")]),
        ("Bob created XY and built yz", [("Bob", "created", "XY and built yz"), ("Bob created XY and", "created", "yz")]),
        ("Kim uses one and uses two", [("Kim", "uses", "one and uses two")]),
        ("Ab uses " + "x" * 101, []),
        ("Ab uses " + "x" * 100, [("Ab", "uses", "x" * 100)]),
        ("İstanbul uses ΣΑΣ", [("İstanbul", "uses", "ΣΑΣ")]),
        ("no markers here", []),
        ("", []),
    ],
)
def test_extraction(spark, content, expected):
    assert triples(spark, content) == expected


def test_ids(spark):
    row = spark.range(1).select(
        entity_id(F.lit("React")).alias("e"), relation_id(F.lit("a"), F.lit("uses"), F.lit("b")).alias("r")
    ).first()
    assert row.e == "ent_" + sha("react")[:16] and row.r == "rel_" + sha("a:uses:b")[:16]


def test_entity_types(spark):
    names = {
        "PostgreSQL": "technology", "react": "technology", "docker-compose": "technology", "category": "technology",
        "src/main.go": "file", "main.py": "file", "C:\\a.txt": "file", "UserService": "concept", "a.b": "concept",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.t for r in df.select("n", entity_type(F.col("n")).alias("t")).collect()} == names


def test_shared_entities(spark):
    g = graph.build(texts(spark, ("m1", "App uses PostgreSQL"), ("m2", "APP uses Redis. app uses Redis.")), now=T1)
    names = {r.name for r in g.entities.collect()}
    assert names == {"APP", "PostgreSQL", "Redis"}
    app = entity_id(F.lit("app"))
    assert {r.memory_id for r in g.mentions.where(F.col("entity_id") == app).collect()} == {"m1", "m2"}
    assert g.relations.count() == 2
    counts = graph.counts(g.entities, g.relations).first()
    assert (counts.entity_count, counts.relation_count) == (3, 2)


def test_names_as_first_seen_in_one_list(spark):
    found = extract_triples(texts(spark, ("m", "App uses Redis. APP uses REDIS.")))
    assert {r.name for r in graph.entities_of(found).collect()} == {"App", "Redis"}


def test_adding_to_a_graph(spark):
    g = graph.build(texts(spark, ("m1", "App uses Redis")), now=T1)
    g2 = graph.build(texts(spark, ("m0", "APP uses Redis"), ("m3", "Bob uses Vim")), g, now=T2)
    e = {r.name: r for r in g2.entities.collect()}
    assert set(e) == {"APP", "Redis", "Bob", "Vim"}
    assert (e["APP"].created_at, e["APP"].updated_at) == (T1, T2)
    uses = g2.relations.where("created_at = timestamp'2024-01-02'").collect()
    assert sorted(tuple(r.memory_ids) for r in uses) == [("m0",), ("m3",)]
    assert g2.mentions.count() == 6


def test_upsert_keeps_first_metadata_and_unites_nothing_else(spark):
    stored = spark.createDataFrame([("e", "React", "technology", "{}", T1, T1)], ENTITIES)
    fresh = spark.createDataFrame([("e", "REACT", "concept", '{"a":1}', T2, T2)], ENTITIES)
    row = graph.upsert_entities(stored, fresh).first()
    assert (row.name, row.type, row.metadata, row.created_at, row.updated_at) == ("REACT", "concept", "{}", T1, T2)


def test_relation_upsert_replaces_whole(spark):
    rel = [("r", "a", "b", "uses", 1.0, ["m1"], T1)]
    newer = [("r", "a", "b", "uses", 0.5, ["m2"], T2)]
    row = graph.upsert_relations(spark.createDataFrame(rel, RELATIONS), spark.createDataFrame(newer, RELATIONS)).first()
    assert (row.weight, row.memory_ids, row.created_at) == (0.5, ["m2"], T2)


def test_counts_per_text(spark):
    got = graph.add_counts(texts(spark, ("a", "App uses Go. App uses go."), ("b", "nothing"))).collect()
    assert {r.memory_id: (r.triples_extracted, r.entities_added, r.relations_added) for r in got} == {"a": (2, 2, 2), "b": (0, 0, 0)}


def entities(spark, *names):
    return spark.createDataFrame([(n, n, "concept", None, T1, T1) for n in names], ENTITIES)


def relations(spark, edges):
    rows = [(f"r{i}", a, b, "uses", 1.0, [], T1) for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame(rows, RELATIONS)


@pytest.mark.parametrize("few", [0, 5000])
def test_find(spark, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW_QUERIES", few)
    e = entities(spark, "PostgreSQL", "pgvector", "Redis", "Ästhetik", "reader")
    assert [r.name for r in graph.find_entities(e, "postg").collect()] == ["PostgreSQL"]
    assert [r.name for r in graph.find_entities(e, "pg").collect()] == ["pgvector"]
    assert [r.name for r in graph.find_entities(e, "RE", 1).collect()] == ["PostgreSQL"]
    asked = ["postg", "pg", "RE", "ästh", "", "zzz", "e", "reader", "vec", "readers"]
    q = spark.createDataFrame([(x, x) for x in asked], "query_id string, query string")
    got = {}
    for r in graph.find_entities_batch(q, e, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.name)
    want = {x: [r.name for r in graph.find_entities(e, x, 3).collect()] for x in asked}
    assert got == {k: v for k, v in want.items() if v}


def test_lookup_and_relations(spark):
    e, r = entities(spark, "e1"), relations(spark, [("e1", "e2"), ("e3", "e3")])
    ids = spark.createDataFrame([("e1",), ("e2",), ("e3",), ("x",)], "id string")
    assert {x.id: x.name for x in graph.lookup_entities(ids, e).collect()} == {"e1": "e1", "e2": None, "e3": None, "x": None}
    got = sorted((x.entity_id, x.id) for x in graph.relations_of(ids, r).collect())
    assert got == [("e1", "r0"), ("e2", "r0"), ("e3", "r1")]


def walk(start, edges, known, depth):
    """One start at a time, edge by edge."""
    seen, walked, out, queue = {start}, set(), set(), [start]
    for _ in range(depth):
        following = []
        for at in queue:
            for i, (a, b) in enumerate(edges):
                if i in walked or at not in (a, b):
                    continue
                walked.add(i)
                other = a if b == at else b
                if other not in seen:
                    seen.add(other)
                    following.append(other)
                    if other in known:
                        out.add(other)
        queue = following
    return out, {f"r{i}" for i in walked}


@pytest.mark.parametrize("seed", range(3))
def test_neighbourhoods_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(16)] + [("hub", n) for n in nodes[:5]]
    known = set(rng.sample(nodes, 11)) | {"hub"}
    e, r = entities(spark, *sorted(known)), relations(spark, edges)
    starts = spark.createDataFrame([("n0",), ("n1",), ("hub",), ("nowhere",)], "id string")
    for depth in (0, 1, 2, 3):
        found, walked = {}, {}
        for x in graph.neighbours(starts, r, e, depth).collect():
            found.setdefault(x.start_id, set()).add(x.id)
        for x in graph.neighbour_relations(starts, r, depth).collect():
            walked.setdefault(x.start_id, set()).add(x.id)
        for start in ("n0", "n1", "hub", "nowhere"):
            want, edges_want = walk(start, edges, known, depth)
            assert found.get(start, set()) == want - {start}
            assert walked.get(start, set()) == edges_want


def test_chain(spark):
    e, r = entities(spark, "a", "b", "c"), relations(spark, [("a", "b"), ("b", "c")])
    start = spark.createDataFrame([("a",)], "id string")
    got = {x.id: x.distance for x in graph.neighbours(start, r, e, 2).collect()}
    assert got == {"b": 1, "c": 2}
    assert graph.neighbour_relations(start, r, 2).count() == 2


def test_excerpts_and_quotes(spark):
    df = spark.createDataFrame([("this is a longer string",), ("exactly10!",), (" \u3000x\n",), ('a"b\\\n\t',)], "s string")
    assert [r.c for r in df.select(text.clipped(F.col("s"), 10).alias("c")).collect()] == ["this is...", "exactly10!", "x", 'a"b\\']
    assert df.select(text.quoted(F.col("s")).alias("q")).collect()[3].q == '"a\\"b\\\\\\n\\t"'


def test_find_with_a_stored_index(spark, tmp_path):
    names = [f"Service {i} for {w}" for i, w in enumerate(["billing", "Search", "MAIL", "it", "x"] * 20)] + ["it", "I", "ÄÖÜ tool", "aaaaaa"]
    entities = spark.createDataFrame([(f"e{i:03}", n) for i, n in enumerate(names)], "id string, name string")
    snapshots.write_name_index(graph.name_index(entities), str(tmp_path / "i"), 16)
    asked = ["bill", "SEARCH", "it", "", "i", "äöü", "nothing", "service 1", "aaa"]
    queries = spark.createDataFrame([(q, q) for q in asked], "query_id string, query string")
    index = snapshots.read_name_index(spark, str(tmp_path / "i"), graph.asked_grams(queries))
    assert "PartitionFilters: [bucket" in index._jdf.queryExecution().toString()
    found = {}
    for r in sorted(graph.find_entities_batch(queries, entities, 4, index).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.id)
    for q in asked:
        expected = [r.id for r in graph.find_entities(entities, q, 4).collect()]
        assert found.get(q, []) == expected


def test_names_are_not_shuffled_for_few_candidates(spark):
    entities = spark.createDataFrame([(f"e{i:03}", f"name {i}") for i in range(200)], "id string, name string").repartition(4)
    queries = spark.createDataFrame([("q", "name 17"), ("p", "e 3")], "query_id string, query string")
    plan = graph.find_entities_batch(queries, entities, 5)._jdf.queryExecution().executedPlan().toString()
    # Names meet the candidates by a broadcast; only hits are ranked.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
