"""Small hand-made and random inputs."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

from recall.schema import MEMORIES

START = datetime(2024, 1, 1)


def sha(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()


def memory(id: str, content: str = "text", **given) -> dict:
    row = {
        "id": id,
        "content": content,
        "memory_type": "fact",
        "user_id": "",
        "agent_id": "",
        "app_id": "",
        "run_id": "",
        "metadata": "{}",
        "embedding": None,
        "created_at": START,
        "updated_at": START,
    }
    row.update(given)
    row.setdefault("content_hash", sha(row["content"]))
    return row


def memories(spark, rows: list[dict]):
    return spark.createDataFrame([tuple(r[c] for c in MEMORIES.names) for r in rows], MEMORIES)


def hours(n: float) -> timedelta:
    return timedelta(hours=n)
