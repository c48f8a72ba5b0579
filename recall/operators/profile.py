"""Per-user traits, folded from single observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall.schema import SUMMARY_TRAITS

NO_PROFILE = "No profile data yet."


def observe(observations: DataFrame, seq: str = "seq") -> DataFrame:
    """Traits per user and key: latest value, count, first and last time seen.

    ``observations`` has ``user_id``, ``key``, ``value``, ``ts`` and ``seq``, which
    settles equal times. All four aggregates combine on the map side, whatever the
    share of one user or key.
    """
    return observations.groupBy("user_id", "key").agg(
        F.max_by("value", F.struct("ts", seq)).alias("value"),
        F.count("*").alias("occurrences"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def merge(traits: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fold newly observed traits into stored ones; at equal times the fresh value wins."""
    both = traits.withColumn("_age", F.lit(0)).unionByName(fresh.withColumn("_age", F.lit(1)))
    return both.groupBy("user_id", "key").agg(
        F.max_by("value", F.struct("last_seen", "_age")).alias("value"),
        F.sum("occurrences").alias("occurrences"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def lookup(keys: DataFrame, traits: DataFrame) -> DataFrame:
    """Trait of each requested ``(user_id, key)``; null where there is none."""
    return keys.select("user_id", "key").join(traits, ["user_id", "key"], "left")


def count(traits: DataFrame) -> DataFrame:
    return traits.groupBy("user_id").agg(F.count("*").alias("traits"))


def top(traits: DataFrame, n: int) -> DataFrame:
    """Each user's ``n`` most observed traits, with ``rank`` from 1."""
    most_first = Window.partitionBy("user_id").orderBy(F.desc("occurrences"), F.asc("key"))
    return traits.withColumn("rank", F.row_number().over(most_first)).where(F.col("rank") <= n)


def summaries(traits: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Text profile of each user from the top traits.

    With ``users``, exactly those are answered, including ones without traits.
    """
    lines = (
        top(traits, SUMMARY_TRAITS)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "key", "value"))).alias("_top"))
    )
    body = F.array_join(
        F.transform("_top", lambda t: F.concat(F.lit("- "), t["key"], F.lit(": "), t["value"], F.lit("\n"))),
        "",
    )
    texts = lines.select(
        "user_id",
        F.concat(F.lit("Profile for "), "user_id", F.lit(":\n"), body).alias("summary"),
    )
    if users is None:
        return texts
    return (
        users.select("user_id")
        .distinct()
        .join(texts, "user_id", "left")
        .withColumn("summary", F.coalesce("summary", F.lit(NO_PROFILE)))
    )
