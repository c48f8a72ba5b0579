"""Hard negatives by bounds along a spanning tree of the anchors.

The anchors of a label are the nodes of a minimum spanning tree. A candidate is scored exactly against the root. Along
an edge, a score changes by at most the length of the edge times the candidate's norm; so the parent's score, or what is
known of it, bounds the child's. Only candidates whose bounds reach the child's window are scored again: for
positives what may be among its best, for negatives the range that its positives allow. Vectors are whole
numbers, so scores are exact; bounds are loosened by one to cover rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall.llm.numbering import NUMBER, numbered
from recall.plans.checkpoint import scratch_folder

POSITIVES, NEGATIVES = 5, 3
SCALE = 256
#: Scores of negatives in percent of the positive's.
LOW, HIGH = 50, 95
#: Anchors of one pass over the table: at most so many, and so many bytes of their vectors.
BLOCK, BLOCK_BYTES = 2048, 16 * 1024 * 1024
#: Bounds (candidates times anchors) that a task holds at once.
CELLS = 2_000_000
FLOAT_EXACT, LONG_EXACT = 2.0**53, 2.0**62


@dataclass
class Tree:
    """Anchors of one label and vector length, parents before children."""

    label: int
    number: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    #: Least and greatest score of each positive's negatives; without a positive an empty range.
    low: list[list[int]]
    high: list[list[int]]


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree by Prim's method; parents are places in the order, the root's is -1."""
    count = len(vectors)
    squares = np.einsum("ij,ij->i", vectors, vectors)
    order, parent, edge = np.zeros(count, int), np.full(count, -1), np.zeros(count)
    best, source, left = np.full(count, np.inf), np.zeros(count, int), np.ones(count, bool)
    node = 0
    for step in range(count):
        order[step], left[node] = node, False
        if step:
            parent[step], edge[step] = source[node], np.sqrt(best[node])
        away = np.maximum(squares + squares[node] - 2 * (vectors @ vectors[node]), 0)
        nearer = left & (away < best)
        best[nearer], source[nearer] = away[nearer], step
        node = int(np.where(left, best, np.inf).argmin())
    # Differences of large squares lose digits: lengths are taken from the vectors themselves.
    for step in range(1, count):
        edge[step] = np.linalg.norm(vectors[order[step]] - vectors[order[parent[step]]])
    return order, parent, edge


def inner(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows and a vector, as long; beyond that an error."""
    if not len(rows):
        return np.zeros(0, np.int64)
    reach = float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max()) * np.linalg.norm(vector))
    if reach < FLOAT_EXACT:
        return (rows @ vector).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, vector, strict=True)) for row in rows]
    if max(map(abs, exact)) >= 1 << 62:
        raise ValueError("a score does not fit into 62 bits")
    return np.array(exact, np.int64)


def quantised(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, floor(scale * vector)) of the usable rows of (id, label, vector), by vector length.

    Rows with a null id, label or vector, or with a null or non-finite component, are not usable.
    """
    fine = np.logical_and.reduce([np.asarray(batch.column(i).is_valid()) for i in range(3)])
    ids, labels, vectors = (batch.column(i).filter(pa.array(fine)) for i in range(3))
    lengths = np.asarray(vectors.value_lengths(), np.int64)
    values = np.floor(np.asarray(vectors.flatten().cast(pa.float64()).fill_null(float("nan"))) * scale)
    starts, ids, labels = np.cumsum(lengths) - lengths, np.asarray(ids, np.int64), np.asarray(labels, np.int64)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        matrix = values[starts[rows][:, None] + np.arange(size)]
        finite = np.isfinite(matrix).all(axis=1)
        rows, matrix = rows[finite], matrix[finite]
        if len(rows):
            yield ids[rows], labels[rows], matrix


class _Best:
    """The best scores of one list: higher first, ties to the smaller id."""

    __slots__ = ("size", "scores", "ids")

    def __init__(self, size: int):
        self.size, self.scores, self.ids = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """What a score must reach to count."""
        return float(self.scores[-1]) if len(self.scores) == self.size else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.size:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        if len(scores):
            scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
            order = np.lexsort((ids, -scores))[: self.size]
            self.scores, self.ids = scores[order], ids[order]


def walk(tree: Tree, ids: np.ndarray, vectors: np.ndarray, windows, take) -> int:
    """Score candidates against all anchors of a tree, as far as bounds ask; returns the number of scores that were computed.

    ``windows(i)`` gives the (least, greatest) scores that matter to anchor i; ``take(i, scores, ids)`` gets
    those candidates that may lie in them, with exact scores, never the anchor's own id.
    """
    norms = np.linalg.norm(vectors, axis=1)
    low, high = np.zeros((2, len(tree.ids), len(ids)))
    computed = 0
    for i, parent in enumerate(tree.parent):
        if parent < 0:
            near = np.arange(len(ids))
        else:
            reach = tree.edge[i] * norms * (1 + 1e-9) + 1
            np.subtract(low[parent], reach, out=low[i])
            np.add(high[parent], reach, out=high[i])
            wanted = np.zeros(len(ids), bool)
            for least, greatest in windows(i):
                wanted |= (high[i] >= least) & (low[i] <= greatest)
            near = np.flatnonzero(wanted)
        if len(near):
            scores = inner(vectors if len(near) == len(ids) else vectors[near], tree.vectors[i])
            low[i, near] = high[i, near] = scores
            computed += len(near)
            other = ids[near] != tree.ids[i]
            take(i, scores[other], ids[near][other])
    return computed


def _slices(tree: Tree, chosen: np.ndarray) -> Iterator[np.ndarray]:
    step = max(64, CELLS // len(tree.ids))
    for at in range(0, len(chosen), step):
        yield chosen[at : at + step]


def _positives(trees: list[Tree], scale: int, count: int):
    """Per task, the best candidates of each anchor's label: (number, id, score)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [[_Best(count) for _ in tree.ids] for tree in trees]
        for batch in batches:
            for ids, labels, vectors in quantised(batch, scale):
                for tree, found in zip(trees, lists, strict=True):
                    if tree.vectors.shape[1] == vectors.shape[1]:
                        for rows in _slices(tree, np.flatnonzero(labels == tree.label)):
                            walk(tree, ids[rows], vectors[rows], lambda i: [(found[i].least, np.inf)], lambda i, s, x: found[i].offer(s, x))  # noqa: B023
        rows = [(n, x, s) for tree, found in zip(trees, lists, strict=True) for n, held in zip(tree.number.tolist(), found, strict=True) for x, s in zip(held.ids.tolist(), held.scores.tolist(), strict=True)]
        yield _columns(rows, ["number", "id", "score"])

    return best


def _negatives(trees: list[Tree], scale: int, count: int):
    """Per task, the best candidates of other labels in each positive's range: (number, place, id, score)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [[[_Best(count) for _ in low] for low in tree.low] for tree in trees]
        for batch in batches:
            for ids, labels, vectors in quantised(batch, scale):
                for tree, found in zip(trees, lists, strict=True):
                    if tree.vectors.shape[1] != vectors.shape[1]:
                        continue

                    def windows(i: int) -> list[tuple[float, float]]:
                        return [(max(float(a), x.least), float(b)) for a, b, x in zip(tree.low[i], tree.high[i], found[i], strict=True)]  # noqa: B023

                    def take(i: int, scores: np.ndarray, who: np.ndarray) -> None:
                        for a, b, x in zip(tree.low[i], tree.high[i], found[i], strict=True):  # noqa: B023
                            inside = (scores >= a) & (scores <= b)
                            x.offer(scores[inside], who[inside])

                    for rows in _slices(tree, np.flatnonzero(labels != tree.label)):
                        walk(tree, ids[rows], vectors[rows], windows, take)
        rows = [
            (n, place, x, s)
            for tree, found in zip(trees, lists, strict=True)
            for n, places in zip(tree.number.tolist(), found, strict=True)
            for place, held in enumerate(places)
            for x, s in zip(held.ids.tolist(), held.scores.tolist(), strict=True)
        ]
        yield _columns(rows, ["number", "place", "id", "score"])

    return best


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _trees(anchors: pa.Table, scale: int, found: dict[int, list[int]], low: int, high: int) -> list[Tree]:
    """The anchors (number, id, label, vector) of a block, a tree per label and vector length."""
    trees = []
    for batch in anchors.combine_chunks().to_batches():
        rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3)], ["id", "label", "vector"])
        ids = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for numbers, labels, vectors in quantised(rows, scale):
            for label in np.unique(labels).tolist():
                mine = np.flatnonzero(labels == label)
                order, parent, edge = spanning_tree(vectors[mine])
                mine = mine[order]
                scores = [found.get(n, []) for n in numbers[mine].tolist()]
                # Whole numbers that keep low * positive <= 100 * negative <= high * positive.
                trees.append(
                    Tree(
                        label,
                        numbers[mine],
                        np.array([ids[n] for n in numbers[mine].tolist()], np.int64),
                        vectors[mine],
                        parent,
                        edge,
                        [[-(-low * s // 100) for s in x] for x in scores],
                        [[high * s // 100 for s in x] for x in scores],
                    )
                )
    return trees


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, id_column: str = "vec_id", vector_column: str = "embedding",
    *, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """A row per anchor, positive and negative: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` and ``label`` are columns over ``vectors``. Scores are inner products of floor(scale * x). An anchor's
    positives are its best rows of its label, a positive's negatives the best rows of other labels with
    ``low`` to ``high`` percent of the positive's score; ties go to the smaller id. Rows with a null id, label or vector, or a null or non-finite
    component, take no part; nor do vectors of another length than the anchor's. A row is never the partner of a row
    with its id. Repeated rows are rows each: they take ranks of their own, and a repeated anchor has its results
    repeatedly. Without rows the result is empty. A score beyond 62 bits is an error. Other columns are ignored.

    Anchors are dealt with in blocks, by label, of a bounded number of bytes; the table is read twice for each. Only a block's anchors
    and their few positives come to the driver.
    """
    spark = vectors.sparkSession
    id_, vector = F.col(f"`{id_column}`").cast("long"), F.col(f"`{vector_column}`")
    rows = vectors.select(id_.alias("id"), label.cast("long").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    candidates = rows.select("id", "label", "vector")
    asked, count = numbered(rows.where("asks").select("id", "label", "vector"), "label", "id")
    longest = asked.agg(F.max(F.size("vector"))).first()[0] or 1
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * longest)))
    folder = scratch_folder(spark)
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], columns).write.parquet(f"{folder}/block=-1")
    best = [F.desc("score"), "id"]
    for start in range(0, count, size):
        block = asked.where(F.col(NUMBER).between(start, start + size - 1))
        anchors = block.select(NUMBER, "id", "label", "vector").toArrow()
        near = candidates.mapInArrow(_positives(_trees(anchors, scale, {}, low, high), scale, positives), "number long, id long, score long")
        place = F.row_number().over(Window.partitionBy("number").orderBy(*best))
        near = near.withColumn("place", place).where(F.col("place") <= positives).toArrow().sort_by([("number", "ascending"), ("place", "ascending")])
        found: dict[int, list[int]] = {}
        for n, s in zip(near["number"].to_pylist(), near["score"].to_pylist(), strict=True):
            found.setdefault(n, []).append(s)
        # At most five rows for each anchor of the block.
        pairs = spark.createDataFrame(near, "number long, id long, score long, place int")
        pairs = pairs.join(block.select(F.col(NUMBER).alias("number"), F.col("id").alias("anchor_id")), "number")
        pairs = pairs.select("number", (F.col("place") - 1).alias("place"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        far = candidates.mapInArrow(_negatives(_trees(anchors, scale, found, low, high), scale, negatives), "number long, place long, id long, score long")
        rank = F.row_number().over(Window.partitionBy("number", "place").orderBy(*best))
        far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
        result = far.join(F.broadcast(pairs), ["number", "place"])
        result = result.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        result.write.parquet(f"{folder}/block={start // size}")
    return spark.read.schema(columns).option("basePath", folder).parquet(folder).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
