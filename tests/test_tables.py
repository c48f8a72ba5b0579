"""Stored tables and streams."""

import os
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from recall.operators import graph, ingest, maintain, profile, stats
from recall.operators.embed import HashingEmbedder, NativeHashingEmbedder
from recall.operators.triples import extract_triples
from recall.plans import checkpoint
from recall.plans.checkpoint import discard, durable
from recall.sources import snapshots
from recall.streaming import dedup, jobs
from tests.data import memories, memory

NOW = datetime(2024, 1, 1)


def ids(spark, root):
    return sorted(r.id for r in snapshots.read_memories(spark, root).collect())


def test_batches(spark, tmp_path):
    root = str(tmp_path / "memories")
    assert snapshots.read_memories(spark, root).count() == 0 and snapshots.buckets_of(spark, root) is None
    snapshots.write_memories(memories(spark, [memory("a", embedding=[1.0]), memory("b", memory_type="decision")]), root, 4)
    snapshots.append_batch(memories(spark, [memory("c")]), root, "b1")
    snapshots.append_batch(memories(spark, [memory("d")]), root, "b1")  # replaces
    assert ids(spark, root) == ["a", "b", "d"] and snapshots.buckets_of(spark, root) == 4
    assert {r.id for r in snapshots.read_memories_before(spark, root, "b1").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="batch names"):
        snapshots.append_batch(memories(spark, []), root, "a/b")
    snapshots.append_batch(memories(spark, []), root, "nothing")
    assert ids(spark, root) == ["a", "b", "d"]


def test_a_broken_off_batch_blocks_nobody(spark, tmp_path):
    root = str(tmp_path / "memories")
    snapshots.create(spark, root, 4)
    (tmp_path / "memories/rows/batch=b1/_temporary/0").mkdir(parents=True)
    assert ids(spark, root) == []
    snapshots.append_batch(memories(spark, [memory("a")]), root, "b1")
    assert ids(spark, root) == ["a"]


def test_filters_skip_folders_and_row_groups(spark, tmp_path):
    root = str(tmp_path / "memories")
    snapshots.write_memories(memories(spark, [memory("a"), memory("b", memory_type="decision")]), root)
    hit = snapshots.read_rows(spark, root).where("memory_type = 'decision' AND bucket = 3 AND batch = 'base'").select("id")
    plan = hit._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "EqualTo(memory_type,decision)" in plan


def test_changes_rewrite_touched_folders_only(spark, tmp_path):
    root, table = str(tmp_path / "memories"), tmp_path / "memories/rows"
    snapshots.write_memories(memories(spark, [memory(f"m{i}", f"old {i}", embedding=[1.0]) for i in range(60)]), root, 8)
    snapshots.append_batch(memories(spark, [memory("late", "old", user_id="u")]), root, "b1")

    def files_():
        return {str(p.relative_to(table)): p.stat().st_mtime_ns for p in table.rglob("*.parquet")}

    before = files_()
    changes = spark.createDataFrame([("m7", "new", None), ("late", None, '{"k":1}'), ("none", "x", None)], "id string, content string, metadata string")
    folders = snapshots.touched_folders(spark, root, changes)
    assert len(folders) == 2 and {b for b, _ in folders} == {"base", "b1"}
    read = snapshots.read_folders(spark, root, folders)
    assert len(read.inputFiles()) >= 2 and "PartitionFilters: [concat_ws" in read._jdf.queryExecution().toString()
    assert {f"batch={r.batch}/bucket={r.bucket}" for r in read.collect()} == {f"batch={a}/bucket={b}" for a, b in folders}
    rejects = maintain.update_stored(spark, root, changes, embedder=HashingEmbedder(1), now=NOW)
    assert [(r.id, r.reason) for r in rejects.collect()] == [("none", maintain.NOT_FOUND)]
    touched = {f"batch={a}/bucket={b}" for a, b in folders}
    for path, time in before.items():
        assert (path.rsplit("/", 1)[0] in touched) != (files_().get(path) == time)
    now = {r.id: r for r in snapshots.read_memories(spark, root).collect()}
    assert len(now) == 61 and now["m7"].content == "new" and now["late"].metadata == '{"k":1}' and now["m8"].content == "old 8"
    removed = snapshots.read_outcome(spark, root, maintain.REMOVED).collect()
    assert [(r.id, r.content_hash) for r in removed] == [("m7", memory("m7", "old 7")["content_hash"])]

    maintain.delete_stored(spark, root, spark.createDataFrame([("late",), ("m7",), ("none",)], "id string"))
    assert len(ids(spark, root)) == 59 and not {"late", "m7"} & set(ids(spark, root))
    maintain.delete_stored(spark, root, snapshots.read_memories(spark, root).select("id"))
    assert ids(spark, root) == []
    maintain.delete_stored(spark, str(tmp_path / "none"), spark.createDataFrame([("a",)], "id string"))


def test_rows_appended_during_an_update_stay(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "memories")
    snapshots.write_memories(memories(spark, [memory(f"m{i}") for i in range(20)]), root, 2)
    real = snapshots.replace_folders

    def meanwhile(rows, at, folders):
        snapshots.append_batch(memories(spark, [memory(f"n{i}") for i in range(20)]), at, "b1")
        real(rows, at, folders)

    monkeypatch.setattr(snapshots, "replace_folders", meanwhile)
    maintain.delete_stored(spark, root, spark.createDataFrame([("m3",)], "id string"))
    assert ids(spark, root) == sorted([f"m{i}" for i in range(20) if i != 3] + [f"n{i}" for i in range(20)])


def test_graph_tables(spark, tmp_path):
    texts = spark.createDataFrame([("m", "App uses Redis")], "memory_id string, content string")
    built = graph.build(texts, now=NOW)
    snapshots.write_graph(built, str(tmp_path / "g"))
    back = snapshots.read_graph(spark, str(tmp_path / "g"))
    assert sorted(back.relations.collect()) == sorted(built.relations.select(*back.relations.columns).collect())
    grown = graph.build(texts.withColumn("memory_id", F.lit("n")), back, now=NOW)
    assert grown.mentions.count() == 4 and grown.entities.count() == 2


def test_graph_stream_equals_one_batch(spark, tmp_path):
    schema = "memory_id string, content string"
    rows = [("3", "App uses Redis. App uses Vim"), ("1", "app uses redis. It is a tool"), ("2", "APP depends on Go"), ("4", "nothing"), ("0", "Redis is a cache")]
    source, root = str(tmp_path / "in"), str(tmp_path / "graph")
    files(spark, source, [spark.createDataFrame(rows[i : i + 2], schema) for i in (0, 2, 4)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    finish(jobs.graph_stream(stream, root), tmp_path)
    grown = graph.settled(snapshots.read_writes(spark, root))
    whole = graph.build(spark.createDataFrame(rows, schema), now=NOW)
    for got, expected, columns in (
        (grown.entities, whole.entities, ["id", "name", "type"]),
        (grown.mentions, whole.mentions, ["entity_id", "memory_id", "text_order"]),
        (grown.relations, whole.relations, ["id", "from_id", "to_id", "type", "weight", "memory_ids"]),
    ):
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))


def test_durable_tables_go_to_the_shared_folder(spark):
    df = durable(spark.range(5).withColumn("s", F.struct("id")))
    assert df.count() == 5 and "InMemoryFileIndex" in df._jdf.queryExecution().toString()


def test_durable_tables_leave_no_shuffles(spark):
    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffles()
    rows = durable(spark.range(1000).repartition(5, "id").withColumn("s", F.lit("x")))
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and rows.count() == 1000
    folder = rows.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    discard(rows)
    assert not os.path.exists(folder)


def files(spark, folder, parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)


def finish(writer, tmp_path):
    run = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    run.awaitTermination()


def test_ingest_stream_equals_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "memories")
    schema = "content string, memory_type string, user_id string, n long"
    first = spark.createDataFrame([("a", "fact", "u", 1), ("a", "fact", "", 2), ("b", "bad", "", 3)], schema)
    second = spark.createDataFrame([("a", "fact", "v", 4), ("b", "fact", "", 5), ("b", "fact", "u", 6)], schema)
    files(spark, source, [first])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    model = HashingEmbedder(4)
    finish(jobs.ingest_stream(stream, root, model, order_by=["n"]), tmp_path)
    files(spark, source, [second])
    finish(jobs.ingest_stream(stream, root, model, order_by=["n"]), tmp_path)
    got = sorted((r.content, r.user_id) for r in snapshots.read_memories(spark, root).collect())
    assert got == [("a", "u"), ("a", "v"), ("b", ""), ("b", "u")]

    rejects = snapshots.read_outcome(spark, root, "rejects")
    assert [(r.n, r.reason) for r in rejects.collect()] == [(3, ingest.INVALID_TYPE)]
    duplicates = snapshots.read_outcome(spark, root, "duplicates").collect()
    assert {r.n for r in duplicates} == {2}


def stream_of(spark, folder, schema, job, root, tmp_path, model=None):
    (tmp_path / f"at-{job}").mkdir(exist_ok=True)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    writer = jobs.ingest_stream(rows, root, model or HashingEmbedder(4), order_by=["n"], job=job)
    run = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"at-{job}/checkpoint")).start()
    run.awaitTermination()
    return [p for p in run.recentProgress if p["numInputRows"]]


def test_stream_dedup_equals_one_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "content string, memory_type string, user_id string, agent_id string, run_id string, note string, at timestamp, n long"
    rows = [
        (rng.choice("abcde"), rng.choice(["fact", "fact", "bad"]), *(rng.choice(["", "", "x", "y", None]) for _ in range(3)), f"n {i}" if i % 3 else None, NOW.replace(microsecond=i), (1 << 60) + i)
        for i in range(90)
    ]
    source, root = str(tmp_path / "in"), str(tmp_path / "memories")
    files(spark, source, [spark.createDataFrame(rows[i : i + 30], schema) for i in range(0, 90, 30)])
    stream_of(spark, source, schema, "j", root, tmp_path)
    whole = ingest.ingest(spark.createDataFrame(rows, schema), memories(spark, []), HashingEmbedder(4), order_by=["n"], batch_id="j")
    keys = ["id", "content", "user_id", "agent_id", "run_id"]
    assert sorted(tuple(r) for r in snapshots.read_memories(spark, root).select(keys).collect()) == sorted(tuple(r) for r in whole.new_rows.select(keys).collect())
    for kind, column in (("duplicates", "duplicate_of"), ("rejects", "reason")):
        got, expected = snapshots.read_outcome(spark, root, kind), getattr(whole, kind)
        shown = ["n", "at", "note", "content", column]
        assert sorted((tuple(r) for r in got.select(shown).collect()), key=repr) == sorted((tuple(r) for r in expected.select(shown).collect()), key=repr)


def test_micro_batches_do_not_read_the_store_again(spark, tmp_path):
    schema, root = "content string, memory_type string, n long", str(tmp_path / "memories")
    snapshots.write_memories(memories(spark, [memory(f"m{i}", f"text {i}") for i in range(40)]), root, 2)
    source = str(tmp_path / "in")
    for k in range(4):
        files(spark, source, [spark.createDataFrame([(f"text {k}", "fact", k), (f"own {k // 2}", "fact", 100 + k)], schema)])
        progress = stream_of(spark, source, schema, "j", root, tmp_path)
        # The table's 40 rows come once; what the job itself appended never does.
        assert sum(p["numInputRows"] for p in progress) == (42 if k == 0 else 2)
    assert len(ids(spark, root)) == 42
    assert snapshots.read_outcome(spark, root, "duplicates").count() == 6


def test_a_micro_batch_leaves_no_intermediate_tables(spark, tmp_path):
    root, named = str(tmp_path / "memories"), set(checkpoint._named)
    source = str(tmp_path / "arriving")
    spark.createDataFrame([("a text", "fact", i) for i in range(4)], "content string, memory_type string, n long").write.parquet(source)
    stream = spark.readStream.schema("content string, memory_type string, n long").parquet(source)
    finish(jobs.ingest_stream(stream, root, NativeHashingEmbedder(4), order_by=["n"]), tmp_path)
    assert len(ids(spark, root)) == 1 and set(checkpoint._named) == named


def test_a_text_that_was_removed_comes_in_again(spark, tmp_path):
    schema, root, source = "content string, memory_type string, user_id string, n long", str(tmp_path / "memories"), str(tmp_path / "in")

    def arrive(*rows):
        files(spark, source, [spark.createDataFrame(list(rows), schema)])
        stream_of(spark, source, schema, "j", root, tmp_path)
        return sorted((r.content, r.user_id) for r in snapshots.read_memories(spark, root).collect())

    assert arrive(("a", "fact", "u", 1), ("b", "fact", "", 2)) == [("a", "u"), ("b", "")]
    maintain.delete_stored(spark, root, snapshots.read_memories(spark, root).where("content = 'a'").select("id"))
    assert arrive(("a", "fact", "", 3), ("a", "fact", "", 4), ("b", "fact", "", 5)) == [("a", ""), ("b", "")]
    assert arrive(("a", "fact", "", 6), ("a", "fact", "u", 7)) == [("a", ""), ("a", "u"), ("b", "")]


class Refusing(HashingEmbedder):
    def embed_batch(self, texts):
        return [None for _ in texts]


def test_a_text_without_a_vector_is_rejected_and_may_come_again(spark, tmp_path):
    schema, root, source = "content string, memory_type string, n long", str(tmp_path / "memories"), str(tmp_path / "in")
    files(spark, source, [spark.createDataFrame([("a", "fact", 1)], schema)])
    stream_of(spark, source, schema, "j", root, tmp_path, Refusing(4))
    assert ids(spark, root) == []
    files(spark, source, [spark.createDataFrame([("a", "fact", 2)], schema)])
    stream_of(spark, source, schema, "j", root, tmp_path)
    assert [r.content for r in snapshots.read_memories(spark, root).collect()] == ["a"]


def test_streams_of_a_table_know_of_each_other(spark, tmp_path):
    root, schema = str(tmp_path / "memories"), "content string, memory_type string, n long"
    for job, texts in (("a", "xy"), ("b", "yz"), ("c", "xz")):
        source = str(tmp_path / job)
        files(spark, source, [spark.createDataFrame([(t, "fact", i) for i, t in enumerate(texts)], schema)])
        stream_of(spark, source, schema, job, root, tmp_path)
    assert sorted(r.content for r in snapshots.read_memories(spark, root).collect()) == ["x", "y", "z"]
    # A new checkpoint must not take a used name.
    (tmp_path / "new").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "a"))
    with pytest.raises(Exception, match="name of its own"):
        finish(jobs.ingest_stream(stream, root, HashingEmbedder(4), order_by=["n"], job="a"), tmp_path / "new")


def collected(stream, mode, name):
    run = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def test_triple_stream_equals_table(spark, tmp_path):
    source = str(tmp_path / "in")
    texts = spark.createDataFrame([("1", "App uses Redis."), ("2", "Bob chose vim. It is a tool")], "memory_id string, content string")
    files(spark, source, [texts])
    got = collected(jobs.triple_stream(spark.readStream.schema(texts.schema).parquet(source)), "append", "triples_out")
    assert sorted(got.collect()) == sorted(extract_triples(texts).collect())


def test_trait_and_stats_streams_equal_tables(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(f"u{i % 3}", f"k{i % 2}", str(i), datetime(2024, 1, 1 + (i * 7) % 20), i) for i in range(40)]
    seen = spark.createDataFrame(rows, "user_id string, key string, value string, ts timestamp, seq long")
    files(spark, source, [seen.where("seq >= 20"), seen.where("seq < 20")])
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = collected(jobs.trait_stream(stream), "complete", "traits_out")
    assert sorted(got.collect()) == sorted(profile.observe(seen).collect())
    as_memories = seen.select(F.col("key").alias("memory_type"), F.col("ts").alias("created_at"))
    typed = stream.select(F.col("key").alias("memory_type"), F.col("ts").alias("created_at"))
    got = collected(jobs.type_stats_stream(typed), "complete", "stats_out")
    assert {r.memory_type: r.total for r in got.collect()} == {
        r.memory_type: r.total for r in stats.count_by_type(as_memories).collect()
    }


@pytest.mark.parametrize("few", [250_000, 30, 1])
def test_deleting_rows_of_many_buckets_shuffles_no_texts(spark, tmp_path, monkeypatch, few):
    """Ids go to the rows, some buckets at a time; only buckets with more of them than that are shuffled."""
    monkeypatch.setattr(maintain, "FEW_IDS", few)
    root = str(tmp_path / "memories")
    snapshots.write_memories(memories(spark, [memory(f"m{i}", f"text {i}") for i in range(200)]), root, 8)
    snapshots.append_batch(memories(spark, [memory(f"n{i}", f"text {i}") for i in range(100)]), root, "b1")
    gone = [f"m{i}" for i in range(0, 200, 5)] + [f"n{i}" for i in range(0, 100, 2)] + ["none"]
    plans, real = [], snapshots.stage

    def stage(parts, session):
        parts = list(parts)
        plans.extend(p._jdf.queryExecution().executedPlan().toString() for p in parts)
        return real(parts, session)

    monkeypatch.setattr(snapshots, "stage", stage)
    maintain.delete_stored(spark, root, spark.createDataFrame([(x,) for x in gone], "id string"))
    left = {r.id: r.content for r in snapshots.read_memories(spark, root).collect()}
    assert left == {f"{k}{i}": f"text {i}" for k, n in (("m", 200), ("n", 100)) for i in range(n) if f"{k}{i}" not in gone}
    assert few == 1 or not any("hashpartitioning" in p for p in plans)
    assert {r.id for r in snapshots.read_outcome(spark, root, maintain.REMOVED).collect()} == set(gone) - {"none"}


def test_a_delete_makes_no_second_copy_of_the_table(spark, tmp_path, monkeypatch):
    """Some buckets at a time are staged, replaced and deleted from the shared folder."""
    monkeypatch.setattr(maintain, "FEW_ROWS", 40, raising=False)
    root = str(tmp_path / "memories")
    snapshots.write_memories(memories(spark, [memory(f"m{i}", f"text {i}") for i in range(200)]), root, 8)
    staged, sizes, real = [], [], snapshots.stage

    def stage(parts, session):
        assert not any(os.path.exists(x) for x in staged)
        found = real(parts, session)
        sizes.append(found.count())
        staged.append(found.inputFiles()[0].removeprefix("file:").partition("/batch=")[0])
        return found

    monkeypatch.setattr(snapshots, "stage", stage)
    maintain.delete_stored(spark, root, spark.createDataFrame([(f"m{i}",) for i in range(0, 200, 5)], "id string"))
    assert ids(spark, root) == sorted(f"m{i}" for i in range(200) if i % 5)
    assert sum(sizes) == 160 and max(sizes) <= 80 and not any(os.path.exists(x) for x in staged)


class Looked:
    """A map of keys to values that counts how often it is looked into."""

    def __init__(self):
        self.kept, self.times = {}, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.times += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.kept[key] = value


def test_a_call_decides_many_keys_and_looks_each_up_once():
    store, decide = Looked(), dedup._Decide()
    decide.init(store)
    arrived = Row("content_hash", *dedup.SCOPE, "id", "order", "own", "payload", "lane")

    def verdicts(*rows):
        made = [arrived(key, "", "", "", "", f"id{n}", {"source": 1, "n": n}, own, f"{key}{n}", lane) for n, key, own, lane in rows]
        return {r.payload: (r.duplicate_of, r.waits) for r in decide.handleInputRows((0,), iter(made), None)}

    # The rows of a key come in any order; those that answer only get no verdict.
    first = verdicts((5, "a", True, ""), (2, "a", True, ""), (3, "b", True, ""), (1, "b", False, ""), (9, "c", True, "waits"))
    assert first == {"a5": ("id2", False), "a2": (None, False), "b3": ("id1", False), "c9": (None, True)}
    assert store.times == 2
    assert verdicts((0, "a", True, ""), (7, "a", True, ""), (8, "d", True, "")) == {"a0": ("id2", False), "a7": ("id2", False), "d8": (None, False)}
    assert store.times == 4


def test_a_stream_calls_by_bucket(spark, tmp_path):
    """Keys are kept by bucket, and all rows have their verdict."""
    source, root = str(tmp_path / "in"), str(tmp_path / "memories")
    files(spark, source, [spark.range(9000).selectExpr("concat('t', id % 6000) content", "'fact' memory_type", "id n")])
    progress = stream_of(spark, source, "content string, memory_type string, n long", "j", root, tmp_path)
    assert progress[0]["stateOperators"][0]["operatorName"].startswith("transformWithState")
    assert len(ids(spark, root)) == 6000 and snapshots.read_outcome(spark, root, "duplicates").count() == 3000
