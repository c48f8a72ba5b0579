"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query. Global histograms of the scores, refined around the
k-th value pass by pass, locate it without moving scores; ties at it are located in the same way by id.
A last pass keeps what lies at or above the cut: about k rows per query, from whatever number of tasks.
Vectors are whole numbers, so bins shrink to single values and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall.llm.numbering import NUMBER, numbered
from recall.plans.checkpoint import scratch_folder

K = 10
SCALE = 1024
BINS = 256
#: Queries that are sent to all tasks at once; more go in further waves over the table.
WAVE = 2048
#: Bytes of their vectors.
WAVE_BYTES = 32 * 1024 * 1024
#: Refinement of a query ends when so many times k candidates are left.
SLACK = 4
#: Scores that a task holds at once.
CELLS = 1_000_000
LOWEST, HIGHEST = -(1 << 62), (1 << 62) - 1


def quantised(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(scale * vector) of the usable rows of (id, vector), one pair per vector length.

    Not usable: a null id, a null vector, or one that holds null or non-finite components.
    """
    ids, vectors = batch.column(0), batch.column(1)
    fine = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid())
    ids, vectors = ids.filter(pa.array(fine)), vectors.filter(pa.array(fine))
    lengths = np.asarray(vectors.value_lengths(), np.int64)
    flat = vectors.flatten()
    values = np.floor(np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))) * SCALE)
    starts, ids = np.cumsum(lengths) - lengths, np.asarray(ids, np.int64)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        matrix = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(matrix).all(axis=1)
        yield ids[rows[good]], matrix[good]


def inner(ids: np.ndarray, candidates: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs: in floating point, in longs or in numbers of any size, whichever is exact.

    A score beyond 62 bits is an error that names the candidate, unless the query has its id: nobody asks for that one.
    """
    reach = np.abs(candidates).max(initial=0) * np.abs(queries).sum(axis=1).max(initial=0)
    if reach < 2.0**53:
        return (candidates @ queries.T).astype(np.int64)
    if reach < 2.0**62:
        return candidates.astype(np.int64) @ queries.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    scores = whole(candidates) @ whole(queries).T
    scores[ids[:, None] == query_ids] = 0
    beyond = np.flatnonzero((np.abs(scores) > HIGHEST).any(axis=1))
    if len(beyond):
        raise ValueError(f"a score of vector {ids[beyond[0]]} does not fit into 62 bits")
    return scores.astype(np.int64)


@dataclass
class Wave:
    """The queries of a wave and where each one's cut is known to lie.

    ``low`` and ``width`` span the bins of the key that is refined: the score, or once ``tie`` holds the
    k-th score, minus the id of rows that have it. ``above`` rows are better than all bins.
    """

    ids: np.ndarray
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: positions in ids, matrix
    low: np.ndarray
    width: np.ndarray
    above: np.ndarray
    tied: np.ndarray
    tie: np.ndarray
    open: np.ndarray

    def keys(self, ids: np.ndarray, matrix: np.ndarray, only_open: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of candidates: their ids, positions of the queries, scores (rows: candidates)."""
        at, queries = self.vectors.get(matrix.shape[1], (np.zeros(0, int), None))
        if only_open:
            chosen = self.open[at]
            at, queries = at[chosen], None if queries is None else queries[chosen]
        if not len(at):
            return
        step = max(1, CELLS // len(at))
        for start in range(0, len(ids), step):
            part = slice(start, start + step)
            yield ids[part], at, inner(ids[part], matrix[part], self.ids[at], queries)


def _histogram(wave: Wave, k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(wave.ids) * BINS, np.int64)
        for batch in batches:
            for ids, matrix in quantised(batch):
                for own, at, scores in wave.keys(ids, matrix, only_open=True):
                    keys = np.where(wave.tied[at], np.where(scores == wave.tie[at], -own[:, None], LOWEST), scores)
                    bins = (keys - wave.low[at]) // wave.width[at]
                    bins = np.where((bins >= 0) & (bins < BINS) & (own[:, None] != wave.ids[at]), bins, -1)
                    cells = (at * BINS + bins)[bins >= 0]
                    counts += np.bincount(cells, minlength=len(counts))
        filled = np.flatnonzero(counts)
        query, bins = np.divmod(filled, BINS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int64)), pa.array(bins.astype(np.int64)), pa.array(counts[filled]), pa.array(k - wave.above[query])],
            ["query", "bin", "n", "need"],
        )

    return count


def _cut(wave: Wave, k: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix in quantised(batch):
                for own, at, scores in wave.keys(ids, matrix, only_open=False):
                    better = scores > np.where(wave.tied[at], wave.tie[at], wave.low[at] - 1)
                    ties = wave.tied[at] & (scores == wave.tie[at]) & (-own[:, None] >= wave.low[at])
                    row, column = np.nonzero((better | ties) & (own[:, None] != wave.ids[at]))
                    query, found, score = wave.ids[at[column]], own[row], scores[row, column]
                    # Rows that repeat an id cannot be told apart, so k of a slice are enough.
                    order = np.lexsort((found, -score, query))
                    query, found, score = query[order], found[order], score[order]
                    first = np.searchsorted(query, query, side="left")
                    top = np.arange(len(query)) - first < k
                    yield pa.RecordBatch.from_arrays([pa.array(x[top]) for x in (query, found, score)], ["query_id", "vec_id", "score"])

    return keep


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most, low, high = 0.0, None, None
    for batch in batches:
        for ids, matrix in quantised(batch):
            if len(ids):
                most = max(most, float(np.abs(matrix).max(initial=0)))
                low = int(ids.min()) if low is None else min(low, int(ids.min()))
                high = int(ids.max()) if high is None else max(high, int(ids.max()))
    kinds = (pa.float64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((most, low, high), kinds, strict=True)], ["most", "low", "high"])


def _wave(rows: list[tuple[int, list[float]]], most: float) -> Wave:
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["id", "v"])
    ids, vectors, reach = [], {}, []
    for own, matrix in quantised(batch):
        vectors[matrix.shape[1]] = (np.arange(len(ids), len(ids) + len(own)), matrix)
        ids += own.tolist()
        reach += [min(int(most * x), HIGHEST) for x in np.abs(matrix).sum(axis=1)]
    n, reach = len(ids), np.array(reach, np.int64)
    zeros, no = np.zeros(n, np.int64), np.zeros(n, bool)
    return Wave(np.array(ids, np.int64), vectors, -reach, 2 * (reach // BINS) + 2, zeros.copy(), no, zeros.copy(), ~no)


def _refine(table: DataFrame, wave: Wave, k: int, low_id: int, high_id: int) -> None:
    """Narrow the cut of every open query until few candidates are left of it."""
    down = Window.partitionBy("query").orderBy(F.desc("bin"))
    while wave.open.any():
        counts = table.mapInArrow(_histogram(wave, k), "query long, bin long, n long, need long")
        summed = counts.groupBy("query", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        reached = summed.withColumn("upto", F.sum("n").over(down)).where("upto >= need and upto - n < need")
        found = {r["query"]: r for r in reached.select("query", "bin", "n", "upto").toLocalIterator()}  # a row per query of the wave
        for q in np.flatnonzero(wave.open):
            if q not in found:  # fewer than k candidates in all
                wave.low[q], wave.open[q] = LOWEST, False
                continue
            r = found[q]
            wave.low[q] += r["bin"] * wave.width[q]
            inside, wave.above[q] = r["n"], wave.above[q] + r["upto"] - r["n"]
            if wave.above[q] + inside <= SLACK * k:
                wave.open[q] = False
            elif wave.width[q] > 1:
                wave.width[q] = -(-wave.width[q] // BINS)
            elif wave.tied[q]:
                wave.open[q] = False
            else:
                wave.tied[q], wave.tie[q] = True, wave.low[q]
                wave.low[q], wave.width[q] = -high_id, -(-(high_id - low_id + 1) // BINS)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(``query_id``, ``rank`` from 1, ``vec_id``, ``score``): the k best candidates of each query.

    The score is the inner product of floor(1024 * x), x as double. Ties go to the smaller id. A candidate with
    the query's own id is not one of its hits. Vectors that are null, or hold null or non-finite components,
    take no part, nor do rows without an id; vectors of different lengths do not meet. Repeated candidate
    rows all take part; of query rows with one id, that with the smallest vector does. Other columns are ignored.
    Queries go in waves of at most ``WAVE`` and ``WAVE_BYTES``, of which the driver holds one. A score beyond 62 bits is an error.
    """
    spark = candidates.sparkSession
    table = candidates.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    asked = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where("id is not null and v is not null")
    asked, count = numbered(asked.groupBy("id").agg(F.min("v").alias("v")), "id")
    extent = table.mapInArrow(_extent, "most double, low long, high long")
    most, low, high = extent.agg(F.max("most"), F.min("low"), F.max("high")).first()
    folder = scratch_folder(spark)
    schema = "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    longest = asked.agg(F.max(F.size("v"))).first()[0] or 1
    size = max(1, min(WAVE, WAVE_BYTES // (8 * longest)))
    for start in range(0, count if high is not None else 0, size):
        rows = asked.where(F.col(NUMBER).between(start, start + size - 1)).select("id", F.col("v").cast("array<double>")).collect()
        wave = _wave([tuple(r) for r in rows], most)
        if len(wave.ids):
            _refine(table, wave, k, low, high)
            table.mapInArrow(_cut(wave, k), schema).write.mode("append").parquet(folder)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = spark.read.schema(schema).parquet(folder).withColumn("rank", F.row_number().over(best))
    return hits.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
