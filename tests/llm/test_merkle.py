"""Merkle manifests against a direct computation."""

import hashlib

import pytest
from pyspark.sql import functions as F

from recall.llm import merkle

COLUMNS = "doc_id long, lang string, text string, claimed string, row_number int, block string, gid long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes, fan):
    """The root, and per node the proof as (siblings before, siblings after) per level."""
    proofs, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for at in range(0, len(nodes), fan):
            run = nodes[at : at + fan]
            for place in range(len(run)):
                for leaf in members[at + place]:
                    proofs[leaf].append((run[:place], run[place + 1 :]))
            above.append(digest("".join(run)))
            owners.append(sum(members[at : at + fan], []))
        nodes, members = above, owners
    return nodes[0], proofs


def expected(rows, fan=2):
    groups = {}
    for i, lang, text, claimed in rows:
        leaf = digest(value(i) + value(lang) + value(text))
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf, claimed or leaf, i))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = []
    for name in names:
        groups[name].sort(key=lambda x: x[:4])
        inner.append(climb([x[2] for x in groups[name]], fan))
    root, tops = climb([x for x, _ in inner], fan) if inner else ("", [])
    out = []
    for name, (subroot, proofs), top in zip(names, inner, tops, strict=True):
        for (_, _, leaf, claimed, i), proof in zip(groups[name], proofs, strict=True):
            whole, node = proof + top, claimed
            for before, after in whole:
                node = digest("".join([*before, node, *after]))
            out.append((i, leaf, subroot, root, digest("".join("".join(b + a) for b, a in whole)), node, node == root))
    return sorted(out, key=repr)


def found(spark, rows, **given):
    docs = spark.createDataFrame([(i, lang, text, claimed, 1, "b", 2) for i, lang, text, claimed in rows], COLUMNS).repartition(3)
    docs = docs.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("lang"), F.col("text")))
    return sorted((tuple(r)[:7] for r in merkle.manifest(docs, claimed_column="claimed", **given).collect()), key=repr)


def rows(n):
    return [(i, ["en", "de", None, "é", "z", ""][0 if i % 3 == 0 else i % 6], f"text {i}", "f" * 64 if i % 7 == 0 else None) for i in range(n)]


@pytest.mark.parametrize(("n", "fan"), [(0, 2), (1, 2), (2, 2), (150, 2), (80, 3)])
def test_equal_to_a_direct_computation(spark, n, fan):
    assert found(spark, rows(n), fan=fan, height=2) == expected(rows(n), fan)


def test_nulls_repeats_and_long_texts(spark):
    given = [(None, "en", "no id", None), (None, None, None, None), (5, "en", "", None), (5, "en", "", None), (5, "en", "other", None), (6, "en", "long " * 100_000, None)]
    assert found(spark, given) == expected(given)
    assert all(x[6] for x in found(spark, given))


def test_one_group_and_one_leaf_each(spark):
    one = [(i, "en", "t", None) for i in range(70)]
    assert found(spark, one, height=3) == expected(one)
    each = [(i, f"l{i:03d}", "t", None) for i in range(70)]
    assert found(spark, each, height=3) == expected(each)


def test_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", f"t{i}") for i in range(41)], "doc_id long, lang string, text string")
    docs = docs.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("text")))
    for r in merkle.manifest(docs, with_proof=True, height=2).collect():
        proof = [(int(p), x) for p, x in (entry.split(":") for entry in r.proof)]
        assert merkle.fold(r.leaf, proof) == r.root and r.verified
        assert merkle.fold("0" * 64, proof) != r.root


def test_different_values_have_different_leaves(spark):
    pairs = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("1:a", "bc"), (None, "-"), ("-", None), ("", "")], "x string, y string")
    assert pairs.select(merkle.leaf(F.col("x"), F.col("y"))).distinct().count() == 6
