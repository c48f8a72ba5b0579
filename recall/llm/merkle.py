"""Merkle manifest of a dataset, by cogrouped subtree exchange.

The rows of a group are the leaves of a hash tree, and the groups' roots those of a last tree. Leaves are cut into
superblocks of consecutive ones, each a whole subtree of the same height, so a group of any size is reduced by many
tasks; their roots are the leaves of the next round. On the way back each superblock is cogrouped with the one row it needs from
outside: the nodes beside its root's path to the top. One function finishes the local tree, joins proofs and
folds them for all leaves of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall.llm.numbering import NUMBER, numbered
from recall.plans.checkpoint import durable

FAN = 2
#: Levels of a superblock: 4,096 leaves.
HEIGHT = 12
ABSENT = "-"

# A proof has an entry per level: how many of the run's other nodes stand before, ':' and these nodes.
_NODES = "gid long, at long, n long, digest string"
_OUTER = "gid long, at long, subroot string, root string, path array<string>"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_above(n: int, fan: int) -> int:
    """Levels that reduce ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def local_tree(digests: Sequence[str], levels: int, fan: int) -> list[list[str]]:
    """The nodes of each level, from the given ones to ``levels`` above them; a run may have a single node."""
    tree = [list(digests)]
    for _ in range(levels):
        below = tree[-1]
        tree.append([sha256("".join(below[i : i + fan])) for i in range(0, len(below), fan)])
    return tree


def local_proofs(tree: list[list[str]], fan: int) -> list[list[tuple[int, str]]]:
    """Per level below the top, per node: (number of the run's others before it, the others)."""
    proofs = []
    for nodes in tree[:-1]:
        level = []
        for i in range(0, len(nodes), fan):
            run = nodes[i : i + fan]
            level += [(place, "".join(run[:place] + run[place + 1 :])) for place in range(len(run))]
        proofs.append(level)
    return proofs


def fold(leaf: str, proof: Sequence[tuple[int, str]]) -> str:
    """The root that a leaf and its proof give."""
    node, size = leaf, len(leaf)
    for place, others in proof:
        node = sha256(others[: place * size] + node + others[place * size :])
    return node


def _parsed(path: Sequence[str]) -> list[tuple[int, str]]:
    return [(int(place), others) for place, others in (entry.split(":", 1) for entry in path)]


def encoded(*columns: Column) -> Column:
    """One text of several values: each as its UTF-8 byte count, ':' and itself, nulls as '-'; different values never give one text."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit(ABSENT)) for x in texts))


def leaf(*columns: Column) -> Column:
    """Digest of a row's values."""
    return F.sha2(encoded(*columns).cast("binary"), 256)


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / size).cast("long"))


def _climb(nodes: DataFrame, largest: int, fan: int, height: int) -> list[DataFrame]:
    """The given nodes and those of each round above them, until every group has one."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        n = int(rows["n"].iloc[0])
        levels = min(height, levels_above(n, fan))
        top = local_tree(rows["digest"].tolist(), levels, fan)[-1]
        # A superblock is a whole subtree: one node is left of it.
        return pd.DataFrame({"gid": rows["gid"].iloc[0], "at": rows["block"].iloc[0], "n": -(-n // fan**levels), "digest": top})

    rounds = [nodes]
    while largest > 1:
        below = _blocks(rounds[-1].select("gid", "at", "n", "digest"), fan**height)
        rounds.append(durable(below.groupBy("gid", "block").applyInPandas(reduce, _NODES)))
        largest = -(-largest // fan**height)
    return rounds


def _proofs(fan: int, height: int, named: T.StructType | None, with_proof: bool):
    """Cogrouped function of a superblock and its outer nodes: the outer nodes of the round below, or results of leaves."""

    def finish(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("at")
        digests = inner["digest"].tolist()
        above = outer.iloc[0]
        tree = local_tree(digests, min(height, levels_above(int(inner["n"].iloc[0]), fan)), fan)
        levels = local_proofs(tree, fan)
        tail = list(above["path"])
        if named is None:
            paths = [[f"{p}:{x}" for p, x in (level[i // fan**up] for up, level in enumerate(levels))] + tail for i in range(len(digests))]
            return pd.DataFrame({"gid": inner["gid"], "at": inner["at"], "subroot": above["subroot"], "root": above["root"], "path": paths})
        far, rows = _parsed(tail), []
        for i, (digest, claimed) in enumerate(zip(digests, inner["claimed"], strict=True)):
            proof = [level[i // fan**up] for up, level in enumerate(levels)] + far
            found = (sha256("".join(x for _, x in proof)), fold(claimed, proof))
            rows.append((*found, [f"{p}:{x}" for p, x in proof]) if with_proof else found)
        out = pd.DataFrame(rows, columns=["proof_sha256", "folded_root", "proof"][: 2 + with_proof], index=inner.index)
        out.insert(0, "id", inner["id"])
        out["leaf"], out["subroot"], out["root"] = inner["digest"], above["subroot"], above["root"]
        out["verified"] = out["folded_root"] == above["root"]
        return out[named.names]

    return finish


def _descend(rounds: list[DataFrame], outer: DataFrame, fan: int, height: int) -> DataFrame:
    """Outer nodes of the first round's superblocks, from those of the groups' roots."""
    for nodes in reversed(rounds[1:]):
        outer = _exchange(nodes, outer, fan, height, _proofs(fan, height, None, False), _OUTER)
    return outer


def _exchange(nodes: DataFrame, outer: DataFrame, fan: int, height: int, finish, schema) -> DataFrame:
    inner = _blocks(nodes, fan**height).groupBy("gid", "block")
    return durable(inner.cogroup(outer.withColumnRenamed("at", "block").groupBy("gid", "block")).applyInPandas(finish, schema))


def manifest(
    rows: DataFrame, id_column: str = "doc_id", group_column: str = "lang", leaf_column: str = "leaf", claimed_column: str | None = None,
    *, fan: int = FAN, height: int = HEIGHT, with_proof: bool = False,
) -> DataFrame:
    """A row per row of ``rows``: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    The leaves of a group stand by id, rows of one id by their leaf, null ids first; groups by their UTF-8 bytes, null
    first. Every ``fan`` consecutive nodes become the digest of their texts in a row. ``folded_root`` is what the proof makes of the
    ``claimed`` leaf (the leaf itself if no such column is named); ``verified`` tells whether that is the root. ``with_proof`` adds the proof itself,
    an entry per level: the number of siblings to the left, ':' and the siblings. Equal rows are leaves each. An empty
    table gives an empty result. Other columns are ignored.
    """
    given, claimed = (F.col(f"`{c or leaf_column}`") for c in (leaf_column, claimed_column))
    narrow = rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{group_column}`").alias("grp"), given.alias("digest"), F.coalesce(claimed, given).alias("claimed"))
    # The digests are made once; all that follows moves digests, not texts.
    placed, _ = numbered(durable(narrow), "grp", "id", "digest", "claimed")
    # A group is named by the number of its first row, so names are in the groups' order.
    groups = durable(placed.groupBy("grp").agg(F.min(NUMBER).alias("gid"), F.count(F.lit(1)).alias("n")))
    nodes = placed.alias("p").join(groups.alias("g"), F.col("p.grp").eqNullSafe(F.col("g.grp")))
    nodes = durable(nodes.select("id", "gid", (F.col(NUMBER) - F.col("gid")).alias("at"), "n", "digest", "claimed"))
    largest = groups.agg(F.max("n")).first()[0] or 0
    rounds = _climb(nodes, largest, fan, height)

    tops, count = numbered(rounds[-1].select("gid", F.col("digest").alias("subroot")), "gid")
    tops = durable(tops.select(F.lit(0).cast("long").alias("gid"), F.col(NUMBER).alias("at"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("digest"), F.col("gid").alias("group")))
    over = _climb(tops, count, fan, height)
    start = over[-1].select("gid", "at", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<string>").alias("path"))
    paths = _exchange(tops, _descend(over, start, fan, height), fan, height, _proofs(fan, height, None, False), _OUTER)
    # One row per group.
    outer = tops.join(paths.select("at", "root", "path"), "at").select(F.col("group").alias("gid"), F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), "root", "path")
    outer = _descend(rounds, durable(outer), fan, height)

    text, fields = T.StringType(), ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    named = T.StructType([T.StructField("id", narrow.schema[0].dataType), *(T.StructField(x, text) for x in fields), T.StructField("verified", T.BooleanType())])
    if with_proof:
        named = named.add("proof", T.ArrayType(text))
    return _exchange(nodes, outer, fan, height, _proofs(fan, height, named, with_proof), named).withColumnRenamed("id", id_column)
