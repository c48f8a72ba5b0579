import os
import subprocess
import sys
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from recall.functions import metadata
from recall.operators.rank import Weights, recency, rerank
from recall.schema import CLUSTER_THRESHOLD
from tests.data import hours

NOW = datetime(2024, 3, 1)
RESULTS = "query_id string, id string, score double, updated_at timestamp, metadata string"


def test_weights_sum_to_one():
    w = Weights()
    assert w.similarity + w.recency + w.frequency == pytest.approx(1)
    assert CLUSTER_THRESHOLD == 0.85


def test_recency(spark):
    df = spark.createDataFrame([(NOW - hours(h),) for h in (0, 168, 1680, -5)], "t timestamp")
    got = [r.r for r in df.select(recency(F.col("t"), F.lit(NOW)).alias("r")).collect()]
    assert got[:2] == [1.0, 0.5] and got[2] < 0.01 and got[3] == 1.0
    day = df.select(recency(F.col("t"), F.lit(NOW), 84).alias("r")).collect()[1].r
    ignored = df.select(recency(F.col("t"), F.lit(NOW), -1).alias("r")).collect()[1].r
    assert (day, ignored) == (0.25, 0.5)


def test_frequency(spark):
    cases = {
        None: 1, "{}": 1, '{"access_count": 5.0}': 5, '{"access_count": 3}': 3, '{"access_count": 0}': 1,
        '{"access_count": -2}': 1, '{"access_count": "5"}': 1, '{"access_count": "Infinity"}': 1,
        '{"access_count": true}': 1, '{"access_count": null}': 1, '{"access_count": 12345678901}': 12345678901,
        "{broken": 1, "[1]": 1,
    }
    df = spark.createDataFrame([(c,) for c in cases], "m string")
    got = {r.m: r.f for r in df.select("m", metadata.access_count(F.col("m")).alias("f")).collect()}
    assert got == cases


def test_rerank(spark):
    rows = [
        ("q", "old_high_sim", 0.95, NOW - hours(720), '{"access_count": 1.0}'),
        ("q", "new_med_sim", 0.70, NOW - hours(1), '{"access_count": 5.0}'),
        ("other", "alone", 0.5, NOW, '{"access_count": 9}'),
    ]
    got = {r.id: r for r in rerank(spark.createDataFrame(rows, RESULTS), now=NOW).collect()}
    assert got["new_med_sim"].final_rank == 1 and got["old_high_sim"].final_rank == 2
    assert got["old_high_sim"].final_score == pytest.approx(0.57 + 0.25 * 2 ** (-720 / 168) + 0.15 * 0.2)
    assert got["new_med_sim"].final_score == pytest.approx(0.819, abs=1e-3)
    assert got["alone"].frequency_score == 1.0
    assert rerank(spark.createDataFrame([], RESULTS), now=NOW).count() == 0


def test_naive_times_do_not_follow_the_machines_zone():
    """Run apart, since a JVM takes its zone at the start."""
    code = (
        "from datetime import datetime\n"
        "from pyspark.sql import functions as F\n"
        "from recall.functions.times import instant\n"
        "from recall.session import build_session\n"
        "spark = build_session('zone', 'local[1]', spark__ui__enabled='false')\n"
        "print('AT', spark.range(1).select(F.unix_micros(instant(datetime(2024, 1, 8)))).first()[0])\n"
    )
    env = os.environ | {"TZ": "America/New_York"}
    said = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120, check=True)
    assert f"AT {int(datetime(2024, 1, 8, tzinfo=UTC).timestamp()) * 1_000_000}" in said.stdout
