"""Token counts by way of a cache of digests.

A text is known by the SHA-256 of its normalised content, a tokenizer by that of its file with the
name and version of its library. Counts of known digests are joined; only distinct unknown texts are
encoded, once each, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from recall.plans.grouping import grouped

CACHE_SCHEMA = "digest binary, n_tokens long"
LIMIT = 512
#: Characters that are encoded in one call: bounds the memory of a task.
SLICE_CHARS = 1_000_000
#: Chunks whose counts a worker remembers; beyond it forgets them all and goes on.
KNOWN_CHUNKS = 1_000_000

DOUBLE_SPACE = re.compile(r"\s\s")
OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


def _library(path: str) -> str:
    return {".json": "tokenizers", ".model": "sentencepiece"}[os.path.splitext(path)[1]]


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and its library's version: the cache's first key."""
    library = _library(path)
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library} {version(library)}\n".encode() + file.read()).hexdigest()


class _ChunkCounts:
    """Counts of a byte-level BPE without a normaliser, by chunks of text.

    Such a tokenizer never joins a character to white space after it, so a text's tokens are those of
    its chunks "white space, then the rest of a word", each encoded alone. Most chunks recur; the
    library encodes those that this worker has not met yet.
    """

    def __init__(self, encode: Callable[[list[str]], list[int]]):
        self.encode = encode
        self.known: dict[str, int] = {}

    def chunks(self, text: str) -> list[str]:
        if not DOUBLE_SPACE.search(text):
            first, *rest = text.split(" ")
            return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]
        if not OTHER_SPACE.search(text):
            return CHUNK.findall(text)
        return [text]

    def __call__(self, texts: list[str]) -> list[int]:
        parts = [self.chunks(x) for x in texts]
        fresh = list({c for chunks in parts for c in chunks if c not in self.known})
        if len(self.known) + len(fresh) > KNOWN_CHUNKS:
            self.known, fresh = {}, list({c for chunks in parts for c in chunks})
        self.known.update(zip(fresh, self.encode(fresh), strict=True))
        return [sum(map(self.known.__getitem__, chunks)) for chunks in parts]


def _splits_at_spaces(tokenizer) -> bool:
    """Is this a byte-level BPE for which ``_ChunkCounts`` holds?"""
    spec = json.loads(tokenizer.to_str())
    cut = spec["pre_tokenizer"] or {}
    plain = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"])
        for t in spec["added_tokens"]
    )
    return (
        spec["normalizer"] is None
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space", True)
        and plain
    )


@lru_cache(maxsize=4)
def _encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Number of tokens of each text, without begin, end or added special tokens."""
    if _library(path) == "tokenizers":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(texts: list[str]) -> list[int]:
            return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        return _ChunkCounts(encode) if _splits_at_spaces(tokenizer) else encode
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]


def _counted(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, counts, start, chars = batch.column(1), [], 0, 0
            lengths = np.asarray(pc.binary_length(texts))
            for end, n in enumerate(lengths, 1):
                chars += n
                if chars >= SLICE_CHARS or end == len(lengths):
                    counts += encode(texts.slice(start, end - start).to_pylist())
                    start, chars = end, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Counts in the cache of one tokenizer; a folder that does not exist yet is empty."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    limit: int = LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    ``cache`` is a folder that all executors reach; it holds one table per tokenizer digest and
    grows by the counts of this call. ``normalise`` must not change counts: the default keeps the
    text as it is, since byte-level vocabularies see every byte. A null text counts as an empty one.
    Repeated rows are counted each, encoded once. Rows with a null id are kept. Other columns of
    ``docs`` are ignored. A second writer of the same cache does no harm: equal digests have equal counts.
    """
    spark = docs.sparkSession
    folder = f"{cache.rstrip('/')}/{tokenizer_digest(tokenizer)}"
    content = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column), content.alias("_text"))
    digest = F.unhex(F.sha2(normalise(F.col("_text")).cast("binary"), 256))

    # Copies meet before the shuffle, so a text that a third of the rows share is sent once per task.
    distinct = rows.groupBy(digest.alias("digest")).agg(F.first(normalise(F.col("_text"))).alias("text"))
    misses = distinct.join(read_cache(spark, folder), "digest", "left_anti")
    misses.mapInArrow(_counted(tokenizer), CACHE_SCHEMA).write.mode("append").parquet(folder)

    counts = grouped(read_cache(spark, folder), ["digest"], F.max("n_tokens").alias("n_tokens"))
    sized = rows.select(id_column, digest.alias("digest"), F.octet_length("_text").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest", "left").select(
        id_column, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
