"""Scope-aware deduplication of a stream on keyed state.

State is kept by content hash and scope: the id of the earliest row that a row of that scope would repeat. A row answers for
the at most 16 scopes that blanking its own dimensions gives (see :mod:`recall.operators.scope`), so a micro-batch
looks up its own keys only, never the stored rows. A key's state is one id. A call of Python for each key would cost
some ten times what looking it up does, so keys are dealt to buckets: a call decides the keys of a bucket, and looks up
each of them by itself. It holds the bucket's share of a micro-batch, a ``BUCKETS``-th.

A text that fills much of a micro-batch meets in one state key. Before that, every batch of rows within a
task is reduced to the first row of each text and scope; the others wait under keys of their own, and take over
the first one's verdict afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from recall.operators.scope import BITS, BLANKINGS
from recall.schema import SCOPE

KEYS = ["content_hash", *SCOPE]
VERDICT = T.StructType([T.StructField(c, T.StringType()) for c in [*KEYS, "payload", "duplicate_of"]] + [T.StructField("waits", T.BooleanType())])
FIRST = T.StructType([T.StructField("first", T.StringType())])
#: Parts of the keys that are called one after the other; a micro-batch costs so many calls at most. Checkpoints keep keys by bucket.
BUCKETS = 4_096
#: The store that looks up a key of a bucket by itself.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _place(order) -> tuple:
    """Order values as a tuple that compares, nulls first."""
    values = order.values() if isinstance(order, dict) else order
    return tuple((v is not None, v if v is not None else 0) for v in values)


def _events(schema: pa.Schema):
    """Per Arrow batch: first rows of a text and scope, those that wait, and each answer once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, answers, first = [], {}, {}
            rows = sorted(batch.to_pylist(), key=lambda r: _place(r["order"]))
            for n, row in enumerate(rows):
                key = tuple(row[c] for c in KEYS)
                if row["own"] and (key in first or row["lane"]):
                    out.append({**row, "lane": row["lane"] or f"{row['order']!r}{n}"})
                    continue
                if row["own"]:
                    first[key] = True
                    out.append(row)
                for blank in BLANKINGS:
                    if any(blank & bit and not row[c] for c, bit in BITS.items()) or (blank == 0 and row["own"]):
                        continue
                    asked = {c: "" if blank & bit else row[c] for c, bit in BITS.items()}
                    answers.setdefault((row["content_hash"], *asked.values()), {**row, **asked, "own": False, "payload": None})
            yield pa.RecordBatch.from_pylist([*out, *answers.values()], schema)

    return run


class _Decide(StatefulProcessor):
    """Verdicts on the rows of a bucket's keys: null for the first row of a key, the first one's id for the others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", T.StructType([T.StructField(c, T.StringType()) for c in KEYS]), FIRST)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known, fresh, verdict = {}, {}, Row(*VERDICT.names)
        for row in rows:
            names = row[: len(KEYS)]
            if row.lane:
                yield verdict(*names, row.payload, None, True)
                continue
            if names not in known and names not in fresh:
                found = self.first.getValue(names)
                if found is None:
                    fresh[names] = []
                else:
                    known[names] = found[0]
            if names in fresh:
                fresh[names].append((_place(row.order), row.id, row.own, row.payload))
            elif row.own:
                yield verdict(*names, row.payload, known[names], False)
        # The earliest row of a key that was not known before is its first one from now on.
        for names, found in fresh.items():
            place, first = min((x[:2] for x in found), key=lambda x: x[0])
            self.first.updateValue(names, (first,))
            for at, _, own, payload in found:
                if own:
                    yield verdict(*names, payload, None if at == place else first, False)

    def close(self) -> None:
        pass


def verdicts(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """Stream of verdicts on a stream of rows: their scope key, ``payload``, ``duplicate_of`` and ``waits``.

    Both have ``content_hash``, the scope columns, ``id`` and ``order`` (a struct, unique by row); ``arriving`` also ``payload`` (text that
    is handed through) and ``refused``, for rows that are no candidates. ``known`` are stored rows: they answer, but get no verdict.
    """
    columns = [*KEYS, "id", "order", "own", "payload", "lane"]
    kind = arriving.schema["order"].dataType
    schema = T.StructType([T.StructField(c, {"order": kind, "own": T.BooleanType()}.get(c, T.StringType())) for c in columns])
    lane = F.when(F.col("refused"), F.xxhash64("order").cast("string")).otherwise(F.lit(""))
    mine = arriving.withColumns({"own": F.lit(True), "lane": lane}).select(columns)
    theirs = known.withColumns({"own": F.lit(False), "lane": F.lit(""), "payload": F.lit(None).cast("string")}).select(columns)
    events = mine.unionByName(theirs).mapInArrow(_events(to_arrow_schema(schema)), schema)
    bucket = F.pmod(F.xxhash64(*KEYS, "lane"), F.lit(BUCKETS)).alias("bucket")
    return events.select("*", bucket).groupBy("bucket").transformWithState(_Decide(), VERDICT, "append", "none")
