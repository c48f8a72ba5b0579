"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are vectors over the benchmark's words, weighted by inverse document frequency. A
randomised singular value decomposition of that matrix, made from sums over tasks, gives latent
directions. Every window of every document is compared with the benchmark's passages by the cosine
in that space; pairs above a threshold are then checked word by word: longest common
subsequence with the item and presence of its answer. Items of a few words have no direction of their own; they
are looked for as sequences of words.

Texts are cut into words once: from then on they are arrays of word numbers. Weights and directions are fitted once, to the
whole benchmark; items are then searched in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall.llm.numbering import NUMBER, numbered
from recall.plans.checkpoint import durable, scratch_folder

#: Words of a window, and of its steps.
WINDOW, STEP = 48, 16
RANK, OVERSAMPLE = 96, 16
COSINE = 0.45
#: Shares of the item's words, in order: with its answer present, and without.
COMMON, COMMON_ALONE = 0.6, 0.75
ANSWER = 0.6
#: Items with fewer words are looked for as they stand.
LEAST_WORDS = 8
#: Items, and their words, that are sent to all tasks at once; more go in further blocks over the documents.
BLOCK, BLOCK_WORDS = 4096, 1_000_000
#: Words of the benchmark: every task holds a row of numbers for each, some 100 MB in all.
MAX_VOCABULARY = 1 << 18
#: Words whose vectors a task holds at once.
SLICE = 100_000
#: Bytes of word numbers that a task sums up for each byte of its sums.
LONG_TASK = 16
SEED = 11

# All that is not a letter, digit or part of a character beyond ASCII separates words.
SPACE = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(SPACE).split()


def answer_of(text: str) -> str:
    """The last sentence of an item, taken for its answer where it has none of its own."""
    return SENTENCE.split(text.strip())[-1]


def common_words(mask: dict[int, int], size: int, region: list[int]) -> int:
    """Length of the longest common subsequence; ``mask`` has the bit set of each word's places in the item."""
    state = full = (1 << size) - 1
    for places in [mask[word] for word in region if word in mask]:
        hit = state & places
        state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def _masks(ids: list[int]) -> dict[int, int]:
    mask: dict[int, int] = {}
    for place, word in enumerate(ids):
        mask[word] = mask.get(word, 0) | 1 << place
    return mask


@dataclass
class Item:
    """One item: its id, word numbers and those of its answer."""

    item_id: int
    ids: list[int]
    answer: list[int]

    def __post_init__(self):
        self.mask, self.answer_mask = _masks(self.ids), _masks(self.answer)

    def check(self, region: list[int]) -> tuple[float, float] | None:
        """Shares of the item's and its answer's words in order in ``region``, if they tell of a leak."""
        share = common_words(self.mask, len(self.ids), region) / len(self.ids)
        if share < COMMON:
            return None
        answer = common_words(self.answer_mask, len(self.answer), region) / len(self.answer) if self.answer else 1.0
        return (share, answer) if answer >= ANSWER or share >= COMMON_ALONE else None


@dataclass
class Benchmark:
    """A block of items in the latent space."""

    items: list[Item]
    rows: np.ndarray  # directions weighted by inverse document frequency: a row per word of the whole benchmark, and a last one of zeros
    queries: np.ndarray = field(init=False)  # unit vectors of the items' passages
    owner: np.ndarray = field(init=False)  # the item of each
    sizes: np.ndarray = field(init=False)  # words of each item
    words: np.ndarray = field(init=False)  # different words of all items in a row, with how often they occur, and where each item's lie
    times: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)
    ends: np.ndarray = field(init=False)
    short: dict[int, list[Item]] = field(init=False)  # short items by their first word

    def __post_init__(self):
        queries, owner, self.short = [], [], {}
        self.sizes = np.array([len(x.ids) for x in self.items], np.int64)
        counts = np.array([len(x.mask) for x in self.items], np.int64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.words = np.array([w for x in self.items for w in x.mask], np.int64)
        self.times = np.array([m.bit_count() for x in self.items for m in x.mask.values()], np.int64)
        for i, item in enumerate(self.items):
            if len(item.ids) < LEAST_WORDS:
                if item.ids:
                    self.short.setdefault(item.ids[0], []).append(item)
                continue
            for at in range(0, max(len(item.ids) - WINDOW // 2, 1), WINDOW):
                queries.append(self.rows[item.ids[at : at + WINDOW]].sum(axis=0))
                owner.append(i)
        self.queries = _unit(np.array(queries, np.float32).reshape(len(queries), self.rows.shape[1]))
        self.owner = np.array(owner, int)


def _numbered_words(vocabulary: dict[bytes, int], held) -> Callable:
    """Adds ``numbers`` to rows (what is kept, text): numbers of the words of the whole text, -1 for words that no item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get if held is not None else vocabulary.get
        for batch in batches:
            texts, start = batch.column(1), 0
            while start < batch.num_rows or start == 0:
                lists, size, end = [], 0, start
                while end < batch.num_rows and size < 4_000_000:
                    lists.append([get(w, -1) for w in words(texts[end].as_py())])
                    size, end = size + len(lists[-1]), end + 1
                numbers = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), numbers], ["row", "numbers"])
                start = end
                if start >= batch.num_rows:
                    break

    return run


def _with_numbers(docs: DataFrame, kept: Column, text_column: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(``row``, ``numbers``) of each row, as a table."""
    rows = docs.select(kept.alias("row"), F.col(f"`{text_column}`").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([rows.schema[0], T.StructField("numbers", T.ArrayType(T.IntegerType()))])
    return durable(rows.mapInArrow(_numbered_words(vocabulary, held), schema))


def _flat(batch: pa.RecordBatch, place: int) -> tuple[np.ndarray, np.ndarray]:
    """All word numbers of a batch, and where each text ends."""
    lists = batch.column(place)
    numbers = np.asarray(lists.flatten())
    return numbers, np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))


def _frequencies(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs = np.zeros(size, np.int64), 0
        for batch in batches:
            numbers, ends = _flat(batch, 0)
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                seen = np.zeros(size + 1, bool) if end - start > size else None
                if seen is None:
                    distinct = np.unique(numbers[start:end])
                    found[distinct[distinct >= 0]] += 1
                else:
                    seen[numbers[start:end]] = True
                    found += seen[:size]
            docs += len(ends)
        word = np.append(np.flatnonzero(found), -1)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(np.append(found[word[:-1]], docs))], ["word", "n"])

    return count


def _passages(numbers: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into passages of ``size`` words, one a row, filled up with -1; and how many each text has."""
    starts = np.concatenate(([0], ends[:-1]))
    counts = -(-(ends - starts) // size)
    firsts = (np.cumsum(counts) - counts) * size
    cut = np.full(int(counts.sum()) * size, -1, numbers.dtype)
    cut[np.arange(len(numbers)) + np.repeat(firsts - starts, ends - starts)] = numbers
    return cut.reshape(-1, size), counts


def _sums(passages: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per passage, the sum of its words' rows; the last row, that of unknown words, is zero."""
    total = rows[passages[:, 0]]
    for place in range(1, passages.shape[1]):
        total += rows[passages[:, place]]
    return total


def _add_by_word(total: np.ndarray, ids: np.ndarray, place: np.ndarray, images: np.ndarray) -> None:
    """Add the image of each occurrence's passage to its word's row."""
    counts = np.bincount(ids, minlength=len(total))
    # Frequent words by a matrix product, the others one occurrence of each at a time.
    frequent = np.flatnonzero(counts > 32)
    slot = np.full(len(total), -1)
    slot[frequent] = np.arange(len(frequent))
    often = slot[ids] >= 0
    shape = len(frequent), len(images)
    times = np.bincount(slot[ids[often]] * shape[1] + place[often], minlength=shape[0] * shape[1]).reshape(shape)
    total[frequent] += times.astype(np.float32) @ images
    ids, place = ids[~often], place[~often]
    order = np.argsort(ids, kind="stable")
    ids, place = ids[order], place[order]
    turn = np.arange(len(ids)) - np.searchsorted(ids, ids)
    for n in range(int(turn.max(initial=-1)) + 1):
        now = np.flatnonzero(turn == n)
        total[ids[now]] += images[place[now]]


def _slices(numbers: np.ndarray, ends: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of about ``SLICE`` words; long texts are cut at multiples of ``step``."""
    most = SLICE - SLICE % step
    starts = np.concatenate(([0], ends[:-1]))
    pieces = np.concatenate([np.arange(a, b, most) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    limits = np.append(pieces[1:], len(numbers))
    at = 0
    while at < len(pieces):
        upto = max(at + 1, int(np.searchsorted(limits, pieces[at] + most, side="right")))
        yield numbers[pieces[at] : limits[upto - 1]], limits[at:upto] - pieces[at]
        at = upto


def _sketch(weights: np.ndarray, test: np.ndarray):
    """Per task: A' A times the ``test`` vectors, A being its passages with rows of about unit length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(test.shape, np.float64)
        weighted = np.append((weights[:, None] * test), np.zeros((1, test.shape[1])), axis=0).astype(np.float32)
        squares = np.append(weights**2, 0)
        for batch in batches:
            for numbers, ends in _slices(*_flat(batch, 0), WINDOW):
                passages, _ = _passages(numbers, ends, WINDOW)
                if not len(passages):
                    continue
                norms = np.maximum(squares[passages].sum(axis=1), 1e-9)
                images = _sums(passages, weighted) / norms[:, None].astype(np.float32)
                place, at = np.nonzero(passages >= 0)
                _add_by_word(total, passages[place, at], place, images)
        total *= weights[:, None]
        word = np.flatnonzero(total.any(axis=1))
        flat = pa.array(total[word].ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(word.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(word) + 1) * test.shape[1], pa.int32()), flat)], ["word", "row"]
        )

    return sums


def fit(table: DataFrame, size: int) -> np.ndarray:
    """Rows of latent directions of ``size`` words, and a row of zeros, from all passages of a table of ``numbers``: a randomised SVD in one pass after the word counts.

    The driver holds one row of numbers per word of the benchmark, however many documents there are. Tasks are long enough
    for their sums to be small beside what they read.
    """
    numbers = table.select("numbers")
    rank = min(RANK + OVERSAMPLE, max(size, 1))
    counted = numbers.mapInArrow(_frequencies(size), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"]: r["n"] for r in counted.collect()}
    weights = np.log((1 + counts.get(-1, 0)) / (1 + np.array([counts.get(i, 0) for i in range(size)]))) + 0.1
    test = np.random.default_rng(SEED).standard_normal((size, rank))
    read = 4 * (table.agg(F.sum(F.size("numbers"))).first()[0] or 0)
    tasks = max(2 * table.sparkSession.sparkContext.defaultParallelism, read // (LONG_TASK * 8 * test.size + 1))
    partial = numbers.coalesce(int(tasks)).mapInArrow(_sketch(weights, test), "word long, row array<double>")
    summed = partial.groupBy("word").agg(*(F.sum(F.col("row")[i]).alias(f"x{i}") for i in range(rank)))
    image = np.zeros((size, rank))
    for r in summed.collect():
        image[r[0]] = r[1:]
    # Nystrom: A'A is about image (test' image)^-1 image', which a Cholesky factor turns into a thin SVD.
    core = test.T @ image
    core = (core + core.T) / 2
    core += np.eye(rank) * max(np.trace(core), 1e-9) * 1e-10
    values, vectors = np.linalg.eigh(core)
    root = vectors / np.sqrt(np.maximum(values, np.abs(values).max(initial=1e-12) * 1e-12))
    left, spread, _ = np.linalg.svd(image @ root, full_matrices=False)
    # Divided by the singular values, the few directions that all text of a language shares count no more than the others.
    live = np.flatnonzero(spread[:RANK] > spread.max(initial=0) * 1e-6)
    directions = weights[:, None] * left[:, live] / spread[live]
    return np.append(directions, np.zeros((1, len(live))), axis=0).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def window_vectors(directions: np.ndarray, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit latent vectors of all windows of several texts, the text of each and the word it starts at."""
    steps, counts = _passages(numbers, ends, STEP)
    sums = _sums(steps, directions)
    text = np.repeat(np.arange(len(ends)), counts)
    place = np.arange(len(sums)) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = sums.copy()
    for more in range(1, WINDOW // STEP):
        inside = np.flatnonzero(place + more < counts[text])
        windows[inside] += sums[inside + more]
    # A window at the end of a text is a part of the one before.
    whole = np.flatnonzero((place == 0) | (place <= counts[text] - WINDOW // STEP))
    return _unit(windows[whole]), text[whole], place[whole] * STEP


def candidates(bench: Benchmark, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, first words of windows, items and cosines of all pairs of a window and an item above the threshold."""
    vectors, text, start = window_vectors(bench.rows, numbers, ends)
    found = []
    for at in range(0, len(vectors), 4096):
        cosines = vectors[at : at + 4096] @ bench.queries.T
        window, query = np.nonzero(cosines >= COSINE)
        found.append((at + window, query, cosines[window, query]))
    window, query, cosine = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
    return text[window], start[window], bench.owner[query], cosine


def possible(bench: Benchmark, numbers: np.ndarray, first: np.ndarray, end: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which stretches of words have so many of an item's words at all that enough can stand in order."""
    order = np.argsort(numbers, kind="stable")
    keys = numbers[order].astype(np.int64) * (len(numbers) + 1) + order
    counts = bench.ends[items] - bench.starts[items]
    pair = np.repeat(np.arange(len(items)), counts)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts) + bench.starts[items][pair]
    base = bench.words[at] * (len(numbers) + 1)
    present = np.searchsorted(keys, base + first[pair]) < np.searchsorted(keys, base + end[pair])
    return np.bincount(pair, bench.times[at] * present, len(items)) >= COMMON * bench.sizes[items]


def leaks(bench: Benchmark, numbers: np.ndarray, ends: np.ndarray) -> list[dict[int, tuple[int, float, float, float]]]:
    """Per text, by item id: first word of the best window, cosine, share of the item's words and of its answer's."""
    found: list[dict[int, tuple[int, float, float, float]]] = [{} for _ in ends]
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)

    def better(text: int, item: Item, hit: tuple[int, float, float, float]) -> None:
        if hit[2:] > found[text].get(item.item_id, (0, 0.0, -1.0, -1.0))[2:]:
            found[text][item.item_id] = hit

    at = 0
    while at < len(ends) and len(bench.queries):  # texts that are dealt with together
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, side="right")))
        origin = starts[at]
        part, limits = numbers[origin : ends[upto - 1]], ends[at:upto] - origin
        text, start, items, cosines = candidates(bench, part, limits)
        sizes, begin = bench.sizes[items], starts[at + text] - origin
        first = np.maximum(begin, begin + start - sizes)
        end = np.minimum(limits[text], begin + start + WINDOW + sizes)
        for i in np.flatnonzero(possible(bench, part, first, end, items)).tolist():
            item = bench.items[items[i]]
            if checked := item.check(part[first[i] : end[i]].tolist()):
                better(at + int(text[i]), item, (int(start[i]), float(cosines[i]), *checked))
        at = upto
    if bench.short:
        anchors = np.array(sorted(bench.short))
        for place in np.flatnonzero(np.isin(numbers, anchors)).tolist():
            text = int(np.searchsorted(ends, place, side="right"))
            for item in bench.short[int(numbers[place])]:
                if place + len(item.ids) <= ends[text] and numbers[place : place + len(item.ids)].tolist() == item.ids:
                    better(text, item, (place - int(starts[text]), 1.0, 1.0, 1.0))
    return found


@dataclass
class _Items:
    """The items of a benchmark: their vocabulary, and a table of their word numbers."""

    vocabulary: dict[bytes, int]
    table: DataFrame
    count: int
    longest: int

    def blocks(self, directions: np.ndarray) -> Iterator[Benchmark]:
        """Items in blocks that fit into every task."""
        size = max(1, min(BLOCK, BLOCK_WORDS // max(self.longest, 1)))
        for start in range(0, self.count, size):
            part = self.table.where(F.col(NUMBER).between(start, start + size - 1)).orderBy(NUMBER).select("item_id", "ids", "answer").collect()
            yield Benchmark([Item(r["item_id"], list(r["ids"]), list(r["answer"])) for r in part], directions)


def _items(items: DataFrame, id_column: str, text_column: str, answer_column: str | None) -> _Items:
    """Items with words; repeated items are checked each."""
    answer = F.col(f"`{answer_column}`") if answer_column else F.lit(None)
    rows = items.select(F.col(f"`{id_column}`").cast("long").alias("item_id"), F.col(f"`{text_column}`").alias("text"), answer.cast("string").alias("answer"))
    rows = durable(rows.where("text is not null"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {w for text in batch.column(0) for w in words(text.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.binary())], ["word"])

    # Answers of their own may have words that their items lack; they are words of the benchmark all the same.
    texts = rows.select("text").union(rows.where("answer is not null").select("answer"))
    known = texts.mapInArrow(distinct, "word binary").distinct()
    listed = known.limit(MAX_VOCABULARY + 1).collect()
    if len(listed) > MAX_VOCABULARY:
        raise ValueError(f"the benchmark has more than {MAX_VOCABULARY} different words: give it in parts")
    vocabulary = {word: i for i, word in enumerate(sorted(bytes(r[0]) for r in listed))}

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, answers = [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole.append([vocabulary[w] for w in words(text)])
                answers.append([vocabulary[w] for w in words(answer_of(text) if own is None else own)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, kind), pa.array(answers, kind)], ["item_id", "ids", "answer"])

    table, count = numbered(rows.mapInArrow(ids, "item_id long, ids array<int>, answer array<int>"), "item_id")
    longest = table.agg(F.max(F.size("ids"))).first()[0] or 0
    return _Items(vocabulary, table, count, longest)


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", answer_column: str | None = None) -> DataFrame:
    """A row per document and item that leaked into it: id, ``item_id``, ``start_word``, ``cosine``, ``common`` and ``answer``.

    ``common`` is the share of the item's words that occur in order around the window, ``answer`` that of its answer's.
    Items with fewer than ``LEAST_WORDS`` words leak where their words stand in a row; items without words never do.
    Null and empty texts hold no leak; repeated rows are found each; documents without a leak have no row. Of several windows that hold
    an item the best counts, the first of equal ones. Other columns are ignored.

    Weights and directions depend on all documents and the whole benchmark, not on how its items are dealt in blocks.
    """
    wanted = _items(items, "item_id", "text", answer_column)
    table = _with_numbers(docs, F.col(f"`{id_column}`"), text_column, wanted.vocabulary)
    schema = T.StructType([T.StructField(id_column, table.schema[0].dataType)])
    for name, kind in (("item_id", "long"), ("start_word", "long"), ("cosine", "double"), ("common", "double"), ("answer", "double")):
        schema = schema.add(name, kind)

    def search(bench) -> Callable:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, hits = [], []
                for i, held in enumerate(leaks(bench.value, *_flat(batch, 1))):
                    row += [i] * len(held)
                    hits += [(item_id, *hit) for item_id, hit in held.items()]
                columns = list(zip(*hits, strict=True)) if hits else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names
                )

        return found

    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession)
    spark.createDataFrame([], schema).write.parquet(f"{folder}/block=-1")
    for n, bench in enumerate(wanted.blocks(fit(table, len(wanted.vocabulary))) if wanted.count else ()):
        held = spark.sparkContext.broadcast(bench)
        table.mapInArrow(search(held), schema).write.parquet(f"{folder}/block={n}")
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


def clean(docs: DataFrame, items: DataFrame, text_column: str = "text", answer_column: str | None = None) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, with all their columns, whatever their names."""
    wanted = _items(items, "item_id", "text", answer_column)
    if not wanted.count:
        return docs
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    table = _with_numbers(docs, whole, text_column, wanted.vocabulary)

    def without(bench) -> Callable:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not held for held in leaks(bench.value, *_flat(batch, 1))], pa.bool_()))

        return keep

    left = table
    for bench in wanted.blocks(fit(table, len(wanted.vocabulary))):
        left = left.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(bench)), table.schema)
    return left.select("row.*")
