"""Near duplicates by SimHash, with candidates by pigeonring filtering.

Two fingerprints of 64 bits are cut into 8 segments of 8 bits that lie in a ring. If they differ in at most d
bits, some segment starts a chain in which, for every length l, the first l segments together differ in at most
l * d / 8 bits. Where that budget is 0 the segments are equal; where it is 1, all but one of the next
segments are equal too. Equal segments by start and left-out segment are the join key (32 bits
at d = 3); the budgets of the rest of the chain prune before the full check. Only distinct fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall.llm.components import components
from recall.plans.checkpoint import durable
from recall.plans.grouping import grouped

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = 8
WIDTH = 8
#: Fingerprints of one key that one task compares with as many others of it.
BLOCK = 512
#: Shingles that are hashed before their bits are counted: bounds memory for long texts.
SLICE = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits that are set in over half of the hashes of the word shingles, repeats included.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at 0x20 and 0x09-0x0D, no others.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    cuts = list(zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(cuts), SLICE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts[at : at + SLICE]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(cuts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and ``fp`` (long) of every row; a null text is an empty one, whose fingerprint is zero."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [id_column, "fp"])

    rows = docs.select(F.col(id_column), F.col(text_column).alias("_text"))
    return rows.mapInArrow(hashed, T.StructType([rows.schema[0], T.StructField("fp", T.LongType())]))


def chain(max_bits: int) -> tuple[int, int]:
    """Number of leading segments with a budget of 0, and with one of at most 1 (7 at most, to fit a key)."""
    return min(SEGMENTS - 1, (SEGMENTS - 1) // max_bits), min(SEGMENTS - 1, (2 * SEGMENTS - 1) // max_bits)


def _rotated(fp: Column, start: int) -> Column:
    """The ring read from segment ``start``."""
    turn = start * WIDTH
    return F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn)) if turn else fp


def _keys(fp: Column, max_bits: int) -> list[Column]:
    """One key per start of a chain and left-out segment; the number of both is in the upper bits."""
    exact, loose = chain(max_bits)
    keys = []
    for start in range(SEGMENTS):
        ring = F.shiftrightunsigned(_rotated(fp, start), 64 - loose * WIDTH)
        for place, left_out in enumerate(range(exact, loose) or [None]):
            mask = (1 << loose * WIDTH) - 1
            if left_out is not None:
                mask -= 255 << (loose - 1 - left_out) * WIDTH
            number = start * max(1, loose - exact) + place
            keys.append(ring.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(number << loose * WIDTH)))
    return keys


def _budgets(max_bits: int) -> list[tuple[np.uint64, int]]:
    """Masks of a chain's first segments with their budgets, for lengths beyond the exact ones."""
    exact, _ = chain(max_bits)
    full = (1 << 64) - 1
    return [(np.uint64(full ^ (full >> n * WIDTH)), n * max_bits // SEGMENTS) for n in range(exact + 1, SEGMENTS + 1)]


def _within(one, others: np.ndarray, budgets: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Which of ``others`` keep all budgets against ``one``; the last budget is the full check."""
    differing = one ^ others
    kept = np.ones(len(differing), bool)
    for mask, most in budgets:
        kept &= np.bitwise_count(differing & mask) <= most
    return kept


def _trees(fps: np.ndarray, start: int, budgets: list[tuple[np.uint64, int]]) -> list[tuple[int, int]]:
    """(fingerprint, smallest one reached) for the components of one group: fewer rows than fingerprints.

    Each round compares one fingerprint with all that are not reached yet, so dense groups take few rounds.
    """
    turn = np.uint64(start * WIDTH)
    ring = (fps << turn) | (fps >> (np.uint64(64) - turn)) if start else fps
    signed, left, found = fps.view(np.int64), np.arange(len(fps)), []
    while len(left):
        reached, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = _within(ring[queue.pop()], ring[left], budgets)
            reached += (new := left[near].tolist())
            queue += new
            left = left[~near]
        if len(reached) > 1:
            members = signed[reached]
            low = int(members.min())
            found += [(int(x), low) for x in members if x != low]
    return found


def _linked(max_bits: int):
    """Links within each group of the sorted rows (key, p, q, fp); groups may span batches."""
    budgets, (exact, loose) = _budgets(max_bits), chain(max_bits)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([np.asarray(batch.column(i)) for i in range(4)])
            now = now if held is None else np.concatenate((held, now), axis=1)
            cuts = np.flatnonzero(np.any(now[:3, 1:] != now[:3, :-1], axis=0)) + 1
            last = cuts[-1] if len(cuts) else 0
            held = now[:, last:]
            yield from grouped_links(now[:, :last], cuts[:-1])
        if held is not None:
            yield from grouped_links(held, np.zeros(0, int))

    def grouped_links(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        found = []
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.shape[1]], strict=True):
            if end - start > 1:
                ring = int(rows[0, start] >> loose * WIDTH) // max(1, loose - exact)
                found += _trees(rows[3, start:end].view(np.uint64), ring, budgets)
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (``a``, ``b``) of the distinct values ``fp`` whose components are those of all pairs within ``max_bits``.

    A key that very many fingerprints share is cut into blocks, and every two blocks are compared by a
    task of their own, which returns a tree for each component instead of its pairs.
    """
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError(f"max_bits must be below {SEGMENTS}")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keyed = fps.select(F.explode(F.array(*_keys(F.col("fp"), max_bits))).alias("key"), "fp")
    shared = grouped(keyed, ["key"], F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    mine = F.pmod(F.xxhash64("fp"), blocks)
    dealt = (
        keyed.join(shared, "key")
        .select("key", "fp", mine.alias("_mine"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_other"))
        .select("key", F.least("_mine", "_other").alias("p"), F.greatest("_mine", "_other").alias("q"), "fp")
    )
    groups = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return groups.mapInArrow(_linked(max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, ``fp`` and ``component_id``, the smallest id that links reach.

    Rows link if their fingerprints differ in at most ``max_bits`` bits; equal texts always do. Null and empty
    texts have fingerprint zero and link like any other. Repeated rows fall into one component.
    Rows with a null id belong to components but name none unless all ids are null. Other columns are ignored.
    """
    rows = durable(fingerprints(docs, shingle, id_column, text_column))
    least = durable(grouped(rows, ["fp"], F.min(id_column).alias("_least")))
    roots = components(links(least, max_bits))
    labelled = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    labelled = durable(labelled)
    ids = grouped(labelled, ["root"], F.min("_least").alias("component_id"))
    named = durable(labelled.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(id_column, "fp", "component_id")
