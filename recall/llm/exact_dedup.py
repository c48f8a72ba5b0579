"""Exact duplicates by owners in compressed radix tries.

Every task first inserts the whole texts that it reads into a Patricia trie, whose terminal nodes hold the ids seen
there; so copies within a task become one terminal before anything moves. The terminals are then shuffled by length and
content hash and inserted, as full byte strings, into the trie of their partition, which tells how many rows a text has and which
of them owns it. Hashes only say where texts meet: texts are equal if they end at the same terminal.

Tries have a budget in bytes. Beyond it the heaviest subtree is spilled: its terminals are written out and
cut off. A text that comes again later gets another terminal, which the next step joins with the first; the partitions
are sorted by length and hash, so there a spilled terminal never comes again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recall.plans.checkpoint import durable
from recall.plans.grouping import grouped

LARGEST, SMALLEST = "largest", "smallest"
#: Bytes of a task's trie: labels, nodes and ids.
BUDGET = 48 * 1024 * 1024
NODE_BYTES, ID_BYTES = 300, 40
#: Bytes of texts in one batch that leaves a task.
OUT_BYTES = 8 * 1024 * 1024
#: Terminals of one text that meet in one partition: more are merged in parts first.
FAN = 64
#: Texts that are merged in parts: the most frequent ones; the list is broadcast. It steers the work only.
HOT_TEXTS = 4096


class _Node:
    __slots__ = ("label", "children", "held")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.held: list | None = None


def _common(a: bytes, at: int, b: bytes) -> int:
    """Length of the longest common prefix of ``a`` from ``at`` and ``b``, which share a byte."""
    low, high = 1, min(len(a) - at, len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[at : at + middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie over byte strings; each terminal node holds a list, empty at first."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.root, self.size = _Node(b""), 0

    def terminal(self, data: bytes) -> list:
        """What the terminal of ``data`` holds; the terminal is made if there is none."""
        node, at = self.root, 0
        while at < len(data):
            child = node.children.get(data[at])
            if child is None:
                child = node.children[data[at]] = _Node(data[at:])
                self.size += NODE_BYTES + len(child.label)
                node = child
                break
            if not data.startswith(child.label, at):
                shared = _common(data, at, child.label)
                fork = node.children[data[at]] = _Node(child.label[:shared])
                child.label = child.label[shared:]
                fork.children[child.label[0]] = child
                self.size += NODE_BYTES
                child = fork
            node, at = child, at + len(child.label)
        if node.held is None:
            node.held = []
        return node.held

    @staticmethod
    def _below(prefix: bytes, top: _Node) -> Iterator[tuple[bytes, list]]:
        todo = [(prefix, top)]
        while todo:
            before, node = todo.pop()
            whole = before + node.label
            if node.held is not None:
                yield whole, node.held
            todo += [(whole, x) for x in node.children.values()]

    def drain(self) -> Iterator[tuple[bytes, list]]:
        """All texts and what their terminals hold; the trie is empty then."""
        root = self.root
        self._clear()
        yield from self._below(b"", root)

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Cut off the heaviest subtree, and return its texts and what they hold."""
        weights: dict[int, int] = {}
        order = [self.root]
        for node in order:
            order += node.children.values()
        for node in reversed(order):
            held = ID_BYTES * len(node.held) if node.held else 0
            weights[id(node)] = NODE_BYTES + len(node.label) + held + sum(weights[id(x)] for x in node.children.values())
        node, prefix, total, heaviest = self.root, b"", weights[id(self.root)], self.root
        while node.children:
            heaviest = max(node.children.values(), key=lambda x: weights[id(x)])
            if weights[id(heaviest)] <= 0.75 * total or not heaviest.children:
                break
            prefix, node = prefix + node.label, heaviest
        if not node.children or weights[id(heaviest)] < total // 4:
            yield from self.drain()
            return
        del node.children[heaviest.label[0]]
        self.size = total - weights[id(heaviest)]
        yield from self._below(prefix + node.label, heaviest)


def _wins(a, b, keep: str) -> bool:
    """Whether id ``a`` owns rather than ``b``; null ids own only where all are null."""
    if a is None or b is None:
        return b is None and a is not None
    return a > b if keep == LARGEST else a < b


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += ID_BYTES + len(row[text_at] or b"")
        if size >= OUT_BYTES or len(held) >= 50_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _local(keep: str, out: pa.Schema, budget: int):
    """Terminals of the rows (id, text) of a task: (node, length, hash, text, best, best_at, ids).

    ``best_at`` is the place of the first row with the best id in ``ids``.
    """

    def terminals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() << 33
        trie = Trie()

        def written(found: Iterator[tuple[bytes, list]]) -> Iterator[tuple]:
            nonlocal node
            for data, ids in found:
                at = 0
                for i, x in enumerate(ids):
                    if _wins(x, ids[at], keep):
                        at = i
                hashed = xxhash.xxh64_intdigest(data) - (1 << 63)
                yield node, len(data), hashed, data, ids[at], at, ids
                node += 1

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for x, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    # bytes.lower changes A-Z only.
                    trie.terminal(data.as_py().lower()).append(x)
                    trie.size += ID_BYTES
                    if trie.size > budget:
                        yield from written(trie.spill())
            yield from written(trie.drain())

        yield from _batches(rows(), out, 3)

    return terminals


def _merged(keep: str, out: pa.Schema, budget: int):
    """Joins the sorted terminals (length, hash, salt, hot, node, owner, best, n, text) of a partition.

    Returns a link (root, node) for each, and (root, owner, best, n, digest) for each text; hot ones with length, hash and text.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, run = Trie(), None

        def written(found: Iterator[tuple[bytes, list]]) -> Iterator[tuple]:
            for data, (root, owner, best, n, hot, hashed) in found:
                kept = (len(data), hashed, data) if hot else (None, None, None)
                yield root, None, owner, best, n, hashlib.sha256(data).hexdigest(), hot, *kept

        def rows() -> Iterator[tuple]:
            nonlocal run
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(8)]
                for (length, hashed, _, hot, node, owner, best, n), text in zip(zip(*columns, strict=True), batch.column(8), strict=True):
                    if (length, hashed) != run:
                        # All texts in the trie are finished, but for the parts of hot ones, which are joined again.
                        if trie.size > budget:
                            yield from written(trie.spill())
                        run = length, hashed
                    held = trie.terminal(text.as_py())
                    if not held:
                        held += [node, owner, best, n, hot, hashed]
                    else:
                        if _wins(best, held[2], keep) or (best == held[2] and owner < held[1]):
                            held[1:3] = owner, best
                        held[3] += n
                    yield held[0], node, None, None, None, None, hot, None, None, None
            yield from written(trie.drain())

        yield from _batches(rows(), out, 9)

    return links


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = LARGEST, budget: int = BUDGET
) -> DataFrame:
    """A row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of the lower-cased text.

    Texts are equal if their UTF-8 bytes are, after A-Z are lower-cased; a null text is an empty one. Of equal texts the row
    with the largest (or smallest) id stays. Null ids are counted and own only groups of null ids. Rows that repeat an id and text are rows of
    the group each, and just one of them stays; rows of one id with different texts are in different groups. An empty
    table gives an empty result. Other columns are ignored.
    """
    if keep not in (LARGEST, SMALLEST):
        raise ValueError(f"keep must be {LARGEST} or {SMALLEST}")
    kind = docs.select(F.col(f"`{id_column}`")).schema[0].dataType
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("text"))
    long, text = T.LongType(), T.BinaryType()

    def schema(**fields: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(name, x) for name, x in fields.items()])

    local = schema(node=long, length=long, hash=long, text=text, best=kind, best_at=T.IntegerType(), ids=T.ArrayType(kind))
    linked = schema(root=long, node=long, owner=long, best=kind, n=long, digest=T.StringType(), hot=T.BooleanType(), length=long, hash=long, text=text)
    terminals = durable(rows.mapInArrow(_local(keep, to_arrow_schema(local), budget), local))
    counts = grouped(terminals, ["length", "hash"], F.count(F.lit(1)).alias("parts")).where(F.col("parts") > FAN)
    hot = durable(counts.orderBy(F.desc("parts"), "length", "hash").limit(HOT_TEXTS))

    def merge(parts: DataFrame, salt: Column, is_hot: Column) -> DataFrame:
        keys = ("length", "hash", "salt")
        dealt = parts.select("length", "hash", salt.alias("salt"), is_hot.alias("hot"), "node", "owner", "best", "n", "text")
        placed = dealt.repartition(*keys).sortWithinPartitions(*keys, "node")
        return durable(placed.mapInArrow(_merged(keep, to_arrow_schema(linked), budget), linked))

    parts = F.col("parts")
    salted = terminals.withColumns({"owner": F.col("node"), "n": F.size("ids").cast("long")}).join(F.broadcast(hot), ["length", "hash"], "left")
    first = merge(salted, F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(parts / FAN)), F.lit(0)).cast("long"), parts.isNotNull())
    totals = first.where("node is null")
    again = merge(totals.where("hot").withColumn("node", F.col("root")), F.lit(0).cast("long"), F.lit(False))

    above = again.where("node is not null").select(F.col("node").alias("root"), F.col("root").alias("top"))
    links = first.where("node is not null").select("root", "node").join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    columns = ["root", "owner", "best", "n", "digest"]
    texts = totals.where("not hot").select(columns).union(again.where("node is null").select(columns))
    resolved = links.join(texts, "root").drop("root")
    # A terminal's rows are some of one task's, so this join has no hot key.
    placed = terminals.select("node", "best_at", "ids").join(resolved, "node").select("*", F.posexplode("ids").alias("at", "id"))
    return placed.select(
        F.col("id").alias(id_column),
        F.col("best").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("node") == F.col("owner")) & (F.col("at") == F.col("best_at"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
