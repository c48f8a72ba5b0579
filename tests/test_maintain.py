import json
from datetime import datetime

from pyspark.sql import functions as F

from recall.functions import metadata
from recall.operators import maintain
from recall.operators.embed import HashingEmbedder
from tests.data import START, memories, memory, sha

NOW = datetime(2024, 6, 1)
CHANGES = "id string, content string, metadata string"


def updated(spark, rows, changes, embedder=HashingEmbedder(4)):
    result = maintain.apply_updates(
        memories(spark, rows), spark.createDataFrame(changes, CHANGES), embedder=embedder, now=NOW
    )
    return {r.id: r for r in result.memories.collect()}, {r.id: r.reason for r in result.rejects.collect()}


def test_update(spark):
    vector = [1.0, 0.0, 0.0, 0.0]
    rows = [memory(i, "old", embedding=vector, user_id="u", metadata='{"key":"value"}') for i in "abcde"]
    after, rejects = updated(
        spark,
        rows,
        [
            ("a", "new", None),
            ("b", "old", None),
            ("c", None, '{"reviewed":true}'),
            ("d", "", None),
            ("x", "new", None),
        ],
    )
    assert rejects == {"x": "memory not found"}
    assert after["a"].content == "new" and after["a"].content_hash == sha("new") and after["a"].embedding != vector
    assert after["a"].user_id == "u" and after["a"].created_at == START and after["a"].updated_at == NOW
    assert after["b"].embedding == vector and after["b"].updated_at == NOW
    assert json.loads(after["c"].metadata) == {"key": "value", "reviewed": True} and after["c"].embedding == vector
    assert after["d"].content == "" and after["d"].content_hash == sha("")
    assert after["e"].updated_at == START and len(after) == 5


class Failing(HashingEmbedder):
    def embed_batch(self, texts):
        return [None for _ in texts]


def test_failed_embedding_leaves_the_row(spark):
    after, rejects = updated(spark, [memory("a", "old")], [("a", "new", '{"k":1}')], Failing(4))
    assert rejects == {"a": "no embedding"}
    assert after["a"].content == "old" and after["a"].metadata == "{}" and after["a"].updated_at == START


def test_metadata_merge_is_shallow(spark):
    cases = [
        ('{"a":1,"n":{"x":1,"y":2}}', '{"n":{"y":3},"b":null}', {"a": 1, "n": {"y": 3}, "b": None}),
        ("not json", '{"b":2}', {"b": 2}),
        ('{"a":1}', "{}", {"a": 1}),
        ("{}", '{"s":"5","f":1.5}', {"s": "5", "f": 1.5}),
    ]
    df = spark.createDataFrame([(o, n) for o, n, _ in cases], "old string, new string")
    got = [json.loads(r.m) for r in df.select(metadata.merged(F.col("old"), F.col("new")).alias("m")).collect()]
    assert got == [w for *_, w in cases]
    kept = spark.createDataFrame([('{"a": 1}', None)], "old string, new string")
    assert kept.select(metadata.merged(F.col("old"), F.col("new")).alias("m")).first().m == '{"a": 1}'


def test_malformed_metadata_decodes_to_null(spark):
    df = spark.createDataFrame([("{bad",), ('{"a":1}',)], "m string")
    got = df.select(metadata.decoded(F.col("m")).isNull().alias("n")).collect()
    assert [r.n for r in got] == [True, False]


def test_several_changes_of_one_id(spark):
    changes = spark.createDataFrame(
        [
            ("a", "one", '{"x":1,"y":1}', 1),
            ("a", None, '{"y":null}', 2),
            ("a", "two", None, 3),
            ("a", None, '{"z":[1]}', 4),
            ("b", None, None, 1),
        ],
        CHANGES + ", seq int",
    )
    got = {r.id: r for r in maintain.squash_changes(changes, "seq").collect()}
    assert got["a"].content == "two" and json.loads(got["a"].metadata) == {"x": 1, "y": None, "z": [1]}
    assert got["b"].content is None and got["b"].metadata is None


def test_updates_with_repeated_ids(spark):
    stored = memories(spark, [memory("a", "old"), memory("b", "old")])
    changes = spark.createDataFrame(
        [("a", "one", None, 1), ("a", "two", '{"x":1}', 2), ("b", "new", None, 1)], CHANGES + ", seq int"
    )
    ordered = maintain.apply_updates(stored, changes, seq="seq")
    assert sorted((r.id, r.content) for r in ordered.memories.collect()) == [("a", "two"), ("b", "new")]
    assert ordered.rejects.count() == 0
    unordered = maintain.apply_updates(stored, changes.drop("seq"))
    assert sorted((r.id, r.content) for r in unordered.memories.collect()) == [("a", "old"), ("b", "new")]
    assert [(r.id, r.reason) for r in unordered.rejects.collect()] == [("a", maintain.REPEATED)] * 2


def test_delete(spark):
    left = maintain.delete(
        memories(spark, [memory("a"), memory("b")]), spark.createDataFrame([("a",), ("x",), ("a",)], "id string")
    )
    assert [r.id for r in left.collect()] == ["b"]
