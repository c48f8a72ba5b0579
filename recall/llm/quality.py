"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed to be roughly normal. Each class has a mean and a covariance,
shrunk towards the pooled one and that towards its diagonal. The score is a logistic function of the
difference of Mahalanobis log densities, by Cholesky factors that are computed once. Sums over all labelled
rows are all that the fit needs; they are made where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall.plans.checkpoint import durable

#: Share of the pooled covariance in that of a class, and of the diagonal in the pooled one.
SHRINK, TO_DIAGONAL = 0.2, 0.1
#: Log-density difference that one unit of the logistic function's argument stands for.
TEMPERATURE = 4.0
THRESHOLD = 0.7
#: Standard deviations at which a transformed statistic is cut off.
REACH = 6.0

#: Bytes beyond which a word is no word of a language.
LONGEST_WORD = 36

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = slice(65, 91)
DIGITS = slice(48, 58)
PLAIN_MARKS = [ord(c) for c in ".,;:'\"-()?\n\t\r "]
FEATURES = ("words", "word_bytes", "upper", "symbols", "marks", "variety", "repeats", "line_words", "same_lines", "ragged")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text; an empty or null text has those of no words."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    # Keys and digests count as words of no length: they tell nothing about the prose around them.
    lengths = [len(w) for w in words if len(w) <= LONGEST_WORD]
    latin = int(counts[65:91].sum() + counts[97:123].sum())
    marks = int(counts[[46, 44]].sum())
    odd = int(counts[33:128].sum() - latin - counts[DIGITS].sum() - counts[[c for c in PLAIN_MARKS if 32 < c < 128]].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ragged = sum(not LETTERS[w[-1]] and w[-1] not in b"0123456789.,;:?!\"')" for w in words)

    def share(part: float, whole: float) -> float:
        """Log odds of a share, drawn towards an even one by half a case."""
        return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))

    return [
        float(np.log1p(n)),
        float(np.log1p(sum(lengths) / max(len(lengths), 1))),
        share(counts[UPPER].sum(), latin) / 2,
        float(np.log1p(100 * odd / max(len(data), 1))),
        float(np.sqrt(marks / max(n, 1))),
        float(np.log1p(distinct) / max(np.log1p(n), 0.7)),
        float(np.log1p(100 * repeats / max(n, 1))),
        float(np.log1p(n / max(len(lines), 1))),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(100 * ragged / max(n, 1))),
    ]


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and ``statistics`` of every row, repeated rows and null texts too."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics(x.as_py()) for x in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [id_column, "statistics"])

    rows = docs.select(F.col(id_column), F.col(text_column).alias("_text"))
    return rows.mapInArrow(measured, T.StructType([rows.schema[0], T.StructField("statistics", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    """Centre and scale of the statistics, then by class (0, 1): mean, Cholesky factor and log weight."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    weights: list[float]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each row of statistics; higher: class 1 is likelier."""
        if not len(rows):
            return np.zeros(0)
        x = np.clip((rows - self.centre) / self.scale, -REACH, REACH)
        density = [
            weight - np.log(np.diag(factor)).sum() - 0.5 * (np.linalg.solve(factor, (x - mean).T) ** 2).sum(axis=0)
            for mean, factor, weight in zip(self.means, self.factors, self.weights, strict=True)
        ]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -700, 700)))


def _moments(centre: np.ndarray, scale: np.ndarray):
    """Per task and class: the sums of 1, x and x x' in one flat row of numbered values."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(centre)
        total = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            label = np.asarray(batch.column(0))
            x = np.clip((np.asarray(batch.column(1).flatten()).reshape(-1, size) - centre) / scale, -REACH, REACH)
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        place = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], ["place", "value"])

    return sums


def fit(found: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> Model:
    """The model of ``features`` rows whose id has a label 0 or 1.

    Every labelled row counts, however often it repeats; other labels and nulls count for nothing. The driver gets
    sums only. Without rows of both classes there is nothing to tell apart, and all scores are one half.
    """
    marks = labels.where(F.col(label_column).isin(0, 1)).select(id_column, F.col(label_column).cast("int").alias("_label"))
    rows = durable(found.select(id_column, "statistics").join(marks, id_column).select("_label", "statistics"))
    size = len(FEATURES)
    spread = rows.select(*(x for i in range(size) for x in (F.avg(F.col("statistics")[i]), F.stddev_pop(F.col("statistics")[i])))).first()
    centre = np.array([x or 0.0 for x in spread[0::2]])
    scale = np.array([max(x or 0.0, 1e-3) for x in spread[1::2]])
    summed = rows.mapInArrow(_moments(centre, scale), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(2 * (1 + size + size * size))
    for r in summed.collect():  # a few hundred sums, whatever the number of rows
        total[r["place"]] = r["value"]
    total = total.reshape(2, -1)
    counts = total[:, 0]
    means, covariances = [], []
    for k in (0, 1):
        mean = total[k, 1 : 1 + size] / max(counts[k], 1)
        means.append(mean)
        covariances.append(total[k, 1 + size :].reshape(size, size) / max(counts[k], 1) - np.outer(mean, mean))
    if not counts.all():
        return Model(centre, scale, [np.zeros(size)] * 2, [np.eye(size)] * 2, [0.0, 0.0])
    pooled = (counts[0] * covariances[0] + counts[1] * covariances[1]) / counts.sum()
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(size)
    factors = [np.linalg.cholesky((1 - SHRINK) * c + SHRINK * pooled) for c in covariances]
    return Model(centre, scale, means, factors, [float(np.log(n / counts.sum())) for n in counts])


def scored(found: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """Id and ``score`` of every ``features`` row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows))], [id_column, "score"])

    rows = found.select(id_column, "statistics")
    return rows.mapInArrow(score, T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())]))


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns, whatever their names.

    The statistics are taken once more from the text: that is cheaper than a shuffle of the texts.
    """
    place = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_py()) for x in batch.column(place)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(rows) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    """Is the row set aside from learning? By a checksum of its id; a null id is."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(True))
