"""Exact dedup against a plain grouping, and its tries against a dictionary."""

import hashlib
import random
from collections import defaultdict

import pytest

from recall.llm import exact_dedup
from recall.llm.exact_dedup import Trie, exact_duplicates

DOCS = "doc_id long, text string, node string, `a.b` string, row_number int"


def lowered(text):
    return (text or "").encode().lower()


def expected(rows, best=max):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lowered(text)].append(i)
    out, stayed = [], set()
    for i, text in rows:
        data = lowered(text)
        ids = [x for x in groups[data] if x is not None]
        keep = best(ids) if ids else None
        kept = i == keep and data not in stayed
        if kept:
            stayed.add(data)
        out.append((i, keep, len(groups[data]), kept, hashlib.sha256(data).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **given):
    return sorted((tuple(r) for r in exact_duplicates(docs, **given).collect()), key=repr)


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS).repartition(parts)


ROWS = [
    *[(i, f"Text number {i % 7} " + "with a long common start " * (i % 3)) for i in range(60)],
    *[(100 + i, t) for i, t in enumerate(["ÄÖ", "äÖ", "ÄÖ", "İ", "i̇", "", None, "", " ", "a", "aa", "aaa", "A", "long " * 200_000, "LONG " * 200_000])],
    (None, "a"),
    (None, "only without an id"),
    (None, "only without an id"),
    (7, "one id, two texts"),
    (7, "one id, two texts!"),
    (30, "Text number 2 "),
    (30, "TEXT NUMBER 2 "),
    (30, "Text number 2 "),
]


def test_every_row_gets_its_owner(spark):
    assert found(table(spark, ROWS)) == expected(ROWS)
    assert found(table(spark, ROWS), keep="smallest") == expected(ROWS, min)


def test_no_rows(spark):
    assert found(table(spark, [])) == []


def test_small_budgets_and_hot_texts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN", 3)
    monkeypatch.setattr(exact_dedup, "HOT_TEXTS", 2)
    rows = [(i, "hot" if i % 3 else f"text {i % 40}") for i in range(600)] + ROWS
    for budget in (1, 4000):
        assert found(table(spark, rows, 16), budget=budget) == expected(rows)


def test_texts_that_share_length_and_hash_are_told_apart(spark, monkeypatch):
    docs = table(spark, [(1, "abc"), (2, "abd"), (3, "ABC"), (4, "abd"), (5, "abe")])
    monkeypatch.setattr(exact_dedup.F, "translate", None)  # nothing but the tries may decide
    real = exact_dedup._local

    def colliding(keep, out, budget):
        inner = real(keep, out, budget)

        def run(batches):
            import pyarrow as pa

            for batch in inner(batches):
                yield batch.set_column(2, "hash", pa.array([1] * batch.num_rows, pa.int64()))

        return run

    monkeypatch.setattr(exact_dedup, "_local", colliding)
    assert [(r[0], r[1], r[2], r[3]) for r in found(docs)] == [(1, 3, 2, False), (2, 4, 2, False), (3, 3, 2, True), (4, 4, 2, True), (5, 5, 1, True)]


def test_keep_must_be_known(spark):
    with pytest.raises(ValueError, match="keep"):
        exact_duplicates(table(spark, ROWS), keep="first")


def test_trie_is_a_dictionary_that_spills_by_subtree():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(3000)]
    trie, counts, parts = Trie(), defaultdict(int), defaultdict(int)
    for n, word in enumerate(words):
        held = trie.terminal(word)
        held[:] = [held[0] + 1 if held else 1]
        counts[word] += 1
        if n % 97 == 96:
            before = trie.size
            spilled = list(trie.spill())
            assert spilled and trie.size < before
            first = min(len(x) for x, _ in spilled)
            assert len({x[:first] for x, _ in spilled}) <= max(2, len(spilled) // 2) or len(spilled) < 4
            for data, (times,) in spilled:
                parts[data] += times
    for data, (times,) in trie.drain():
        parts[data] += times
    assert parts == counts
    assert list(trie.drain()) == []


def test_trie_takes_deep_chains():
    trie = Trie()
    for n in range(5000):
        trie.terminal(b"a" * n).append(n)
    assert sorted(x for _, (x,) in trie.spill()) + sorted(x for _, (x,) in trie.drain()) != []
