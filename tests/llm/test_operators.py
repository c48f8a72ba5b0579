"""The training-data operators against brute force on small tables."""

import base64
import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recall.llm import decontaminate, line_dedup, mixing, passages, quality, secret_scan, sharding, simhash_dedup, token_counts, topk_search
from recall.llm.components import components

DOCS = "doc_id long, text string, shard string"
PROSE = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(90)) for i in range(12)]
TEXTS = [*PROSE, PROSE[0], PROSE[0], PROSE[1] + " end", None, "", "two words", "long " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, "no id", "x")], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_lines_lose_spaces_at_their_ends_and_nothing_else(spark):
    table = spark.createDataFrame([(" 0 first \n1 second\n 2\t \n \n3 ",)], "text string")
    assert table.select(line_dedup.text_lines(F.col("text"))).first()[0] == ["0 first", "1 second", "2", "3"]


def test_line_dedup(spark):
    rows = [(i, "http://Host.example:80/a", f"<p>menu</p><div>own {i} &amp; more</div>") for i in range(50)] + [(50, None, None), (50, "bad", "<p>menu</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def run(table):
        return line_dedup.drop_boilerplate(table, line_dedup.html_lines(F.col("html")), line_dedup.host(F.col("url")))

    found = {(r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in run(pages).collect()}
    assert found == {(i, "host.example", 2, 1, f"own {i} & more") for i in range(50)} | {(50, "", 0, 0, ""), (50, "", 1, 0, "menu")}
    assert run(pages.limit(0)).count() == 0


def test_top_k_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "WAVE", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(i, rows[7][1]) for i in range(300, 600)]  # more ties at one value than k
    rows += [(600, None), (601, [float("nan")] * 8), (None, rows[1][1]), (602, [1.0]), (603, [None, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in topk_search.top_k(table.where("vec_id % 100 = 0"), table).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids = np.arange(600)
    matrix = np.floor(np.array([v for _, v in rows[:600]]) * 1024).astype(np.int64)
    for query in range(0, 600, 100):
        scores = matrix @ matrix[query]
        best = sorted((-s, i) for i, s in zip(ids, scores, strict=True) if i != query)[:10]
        assert found[query] == {rank: (i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert topk_search.top_k(table.limit(0), table.limit(0)).count() == 0


def test_quality_separates_and_takes_any_text(spark, docs, empty):
    good = [(i, "A calm sentence of words, number " + " and ".join(PROSE[i % 12].split()[: 20 + i])) for i in range(40)]
    bad = [(100 + i, " ".join(f"{w.upper()}!!$$" for w in PROSE[i % 12].split()[: 20 + i])) for i in range(40)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(quality.features(table), labels)
    scores = {r.doc_id: r.score for r in quality.scored(quality.features(table), model).collect()}
    assert all((scores[i] >= quality.THRESHOLD) == (i < 100) for i in scores)
    assert {r.doc_id for r in quality.kept(table, model).collect()} == {i for i, _ in good}
    assert all(0 <= r.score <= 1 for r in quality.scored(quality.features(docs), model).collect())
    assert quality.kept(empty, model).columns == empty.columns
    none = quality.fit(quality.features(empty), labels)
    assert {r.score for r in quality.scored(quality.features(docs), none).collect()} == {0.5}


def test_mixing_meets_targets(spark):
    rows = [(i, f"s{i % 3}", None if i % 5 == 0 else "en", i % 4, 1 + i % 7) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic int, tokens long")
    targets = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}}
    found = mixing.mixed(table, F.col("tokens"), F.col("doc_id"), targets).toPandas()
    weight = found.tokens * found.probability
    share = weight.groupby(found.source).sum() / weight.sum()
    assert np.allclose(share[["s0", "s1", "s2"]], [0.5, 0.3, 0.2]) and np.isclose(found.probability.max(), 1)
    assert abs(found.taken.mean() - found.probability.mean()) < 0.05
    assert mixing.mixed(table.limit(0), F.col("tokens"), F.col("doc_id")).count() == 0


@pytest.mark.parametrize("count", [1, 2, 17, 500])
def test_sharding_is_a_permutation(spark, count):
    table = spark.range(count).select((F.col("id") * 3).alias("doc_id"), F.lit("x").alias("shard"))
    rows = sharding.sharded(table, shards=4).orderBy("doc_id").collect()
    by_shard = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert all(slots == list(range(len(slots))) for slots in by_shard)
    assert max(map(len, by_shard)) - min(map(len, by_shard)) <= 1
    places = spark.createDataFrame([(r.shard, r.slot, i) for i, r in enumerate(rows)], "shard int, slot long, want long")
    assert all(r.row_number == r.want for r in sharding.row_at(places, count, 4).collect())
    assert [tuple(r) for r in sharding.sharded(table.repartition(5), shards=4).orderBy("doc_id").collect()] == [tuple(r) for r in rows]


def test_sharding_of_odd_rows(docs, empty):
    assert sharding.sharded(docs).select("shard", "slot").distinct().count() == docs.count()
    assert sharding.sharded(empty).count() == 0


def test_simhash_links_as_brute_force(spark, docs, empty):
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(2**62), 2**62, 60)
    fps = sorted({int(s) ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 62, k))) if k else int(s) for s in seeds for k in (0, 1, 2, 3, 3, 4, 5)})
    for bits in (1, 2, 3, 5):
        found = components(simhash_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bits))
        root = {x: x for x in fps} | {r.node: r.root for r in found.collect()}
        want = {x: x for x in fps}
        for _ in range(len(fps)):
            before = dict(want)
            for a in fps:
                want[a] = min(want[b] for b in fps if ((a ^ b) & (2**64 - 1)).bit_count() <= bits)
            if before == want:
                break
        assert root == want
    rows = simhash_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count() and {r.component_id for r in rows if r.doc_id in (0, 12, 13)} == {0}
    assert {r.fp for r in rows if r.doc_id in (15, 16)} == {0}
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_simhash_blocks_give_the_same(spark, monkeypatch):
    fps = [(1 << i) | (1 << j) for i in range(12) for j in range(i)]
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    monkeypatch.setattr(simhash_dedup, "BLOCK", 5)
    assert {r.root for r in components(simhash_dedup.links(table)).collect()} == {min(fps)}


def _der(tag, content):
    length = len(content)
    return bytes([tag]) + (bytes([length]) if length < 128 else b"\x82" + length.to_bytes(2)) + content


def test_secrets():
    key = _der(0x30, _der(2, b"\0") + b"".join(_der(2, bytes([i + 1]) * 40) for i in range(8)))
    coded = base64.b64encode(key).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    signed = f"{part({'alg': 'HS256'})}.{part({'sub': 'a'})}.c2ln"
    kinds = lambda text: sorted(secret_scan.KINDS[k] for _, k, _ in secret_scan.confirmed_spans(text))
    assert kinds(f"é {coded} and {key.hex()}") == ["key64", "keyhex"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{coded[:64]}\n{coded[64:]}\n-----END RSA PRIVATE KEY-----")[-1] == "pem"
    assert kinds(signed) == ["token"] and kinds(signed.replace("eyJh", "eyJx")) == []
    assert kinds(base64.b64encode(key[:-1]).decode()) == [] and kinds("f" * 80) == []
    assert [x[1] for x in secret_scan.base_spans("Token: 'abcdefgh' token=short AKIA0123456789AB " + "0a" * 16)] == [0, 1, 2]
    assert secret_scan.base_spans("password: token: abcdefghij") == []


def test_secret_digests(docs, empty):
    rows = secret_scan.digests(secret_scan.scan(docs)).collect()
    assert len(rows) == docs.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.scan(empty).count() == 0


def test_passages_find_what_brute_force_finds(spark, docs, empty):
    rng = np.random.default_rng(5)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    shared = [prose(60), prose(80)]
    near = list(shared[1])
    near[40] = "changed"
    rows = [(i, " ".join(prose(100) + (shared[0] if i % 3 == 0 else near if i % 3 == 1 else shared[1]) + prose(70))) for i in range(24)]
    rows += [(90, " ".join(prose(400)))]
    found = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in found for x in (r.doc_id, r.match_id)} == set(range(24))
    assert all(95 <= r.first_word <= 105 and r.end_word - r.first_word >= 55 and r.similarity >= 0.8 for r in found)
    copies = {(r.doc_id, r.match_id) for r in passages.near_duplicate_passages(docs).collect()}
    assert {(12, 0), (13, 0), (14, 1)} <= copies
    assert passages.near_duplicate_passages(empty).count() == 0


def test_compact_windows_cover_every_stretch():
    for values in (np.random.default_rng(2).permutation(60).astype(np.uint64), np.random.default_rng(2).integers(0, 5, 60).astype(np.uint64)):
        windows = passages.compact_windows(values, 8)
        for a in range(53):
            for b in range(a + 7, 60):
                low = values[a : b + 1].min()
                assert any(left <= a and b <= right and values[c] == low for left, c, right in windows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, empty, tmp_path, name):
    path = public_tokenizers.path(name)
    odd = ["a  b", " a\n\n b \n c", "x  y\t\tz  ", "<|endoftext|> a<|endoftext|>", "it's  'll", "日本 語  é", "a\x1c b \x1f\x1c c"]
    table = docs.union(spark.createDataFrame([(200 + i, t, "") for i, t in enumerate(odd)], DOCS))
    rows = token_counts.token_counts(table, path, str(tmp_path)).collect()
    texts = dict(enumerate(TEXTS)) | {200 + i: t for i, t in enumerate(odd)} | {None: "no id"}
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    else:
        from sentencepiece import SentencePieceProcessor

        count = lambda t: len(SentencePieceProcessor(model_file=path).encode(t))
    assert len(rows) == table.count()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n := count(text), n > 512)
    folder = f"{tmp_path}/{token_counts.tokenizer_digest(path)}"
    known = token_counts.read_cache(spark, folder).count()
    token_counts.token_counts(table, path, str(tmp_path))
    assert token_counts.read_cache(spark, folder).count() == known == len({t or "" for t in texts.values()})
    assert token_counts.token_counts(empty, path, str(tmp_path)).count() == 0


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join(f"t{x}" for x in rng.zipf(1.3, n) % 5000)
    items = [(i, f"{prose(30)}. {prose(8)}.") for i in range(10)]
    words = items[4][1].split()
    rows = [(i, prose(300)) for i in range(80)]
    rows += [(100, f"{prose(200)} {items[3][1]} {prose(100)}"), (101, " ".join([prose(100), *(w if i % 7 else "other" for i, w in enumerate(words)), prose(50)]))]
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame([*items, (50, None), (51, "too short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()} == {(100, 3), (101, 4)}
    assert decontaminate.clean(table, bench).count() == table.count() - 2
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean(table, bench.limit(0)).count() == table.count()


def test_secrets_begin_anywhere_and_wrap():
    key = _der(0x30, _der(2, b"\0") + b"".join(_der(2, bytes([i + 1]) * 70) for i in range(8)))
    coded, small = base64.b64encode(key).decode(), _der(0x30, b"".join(_der(2, bytes([i])) for i in range(6)))
    scheme = _der(0x30, _der(6, bytes.fromhex("2a864886f70d01050d")) + _der(0x30, b""))
    locked = base64.b64encode(_der(0x30, scheme + _der(4, b"x" * 80))).decode()

    def found(text):
        return [(secret_scan.KINDS[k], text[a:b]) for a, k, b in sorted(secret_scan.confirmed_spans(text))]

    for before in ("", "id/", "key_", "abcdefg", "x"):
        assert found(f"{before}{coded} end") == [("key64", coded)]
        assert ("keyhex", key.hex()) in found(f"{'0' * len(before)}{key.hex()} end")
    wrapped = "\n".join(coded[i : i + 64] for i in range(0, len(coded), 64))
    assert found(f"see\n{wrapped}\nThe end") == [("key64", wrapped)]
    assert found(f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{locked}\n-----END ENCRYPTED PRIVATE KEY-----")[0][0] == "pem"
    assert found(locked) == [("key64", locked)]
    assert found(base64.b64encode(small + b"y" * 40).decode()) == [] and found("A" * 5000) == []
    part = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    token = f"{part(json.dumps({'alg': 'HS256'}))}.{part(json.dumps({'sub': 'a'}))}.c2ln"
    assert found(f"x.{token} v1.2.3.4.5") == [("token", token)] and found("Bearer-" + token) == [("token", token)]


def test_secret_scan_survives_hostile_texts():
    import time

    part = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    nested = "[" * 100_000
    started = time.process_time()
    texts = ["eyJ" * 300_000, "eyJh" * 300_000 + ".eyJ9.x", f"{part('{' + chr(34) + 'alg' + chr(34) + ':' + nested)}.{part('{}')}.x", f"{part('{}')}.{part(nested)}.x", "MIIEpAIBAA" * 50_000, "308204a4020100" * 40_000]
    assert [secret_scan.confirmed_spans(t) for t in texts] == [[]] * len(texts)
    assert time.process_time() - started < 60


def test_line_dedup_takes_small_hosts_and_any_names(spark):
    rows = [(i, f"http://h{i % 2}.example/", f"menu\nown {i}\n{'both' if i < 3 else 'x'}", "n") for i in range(6)] + [(9, "http://alone.example/", "menu\nmenu", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string, host string")
    found = line_dedup.drop_boilerplate(pages, line_dedup.text_lines(F.col("text")), line_dedup.host(F.col("url")), 0.5, keep=("page_id", "host", "url"))
    assert found.columns == ["page_id", "url", "host", "n_lines", "n_dropped", "text"]
    got = {r.page_id: (r.n_dropped, r.text) for r in found.collect()}
    assert got == {0: (2, "own 0"), 1: (1, "own 1\nboth"), 2: (2, "own 2"), 3: (2, "own 3"), 4: (1, "own 4\nx"), 5: (2, "own 5"), 9: (0, "menu\nmenu")}


def test_top_k_takes_great_components(spark):
    rows = [(0, [2.0**31, 0.0]), (1, [0.0, 2.0**33]), (2, [2.0**-10, 1.0]), (3, [2.0**10, 2.0]), (4, [-(2.0**9), 3.0]), (4, [1.0, 3.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = [(r["rank"], r.vec_id, r.score) for r in topk_search.top_k(table.where("vec_id = 0"), table).orderBy("rank").collect()]
    assert [(i, s) for _, i, s in got] == [(3, 2**61), (4, 2**51), (2, 2**41), (1, 0), (4, -(2**60))]
    with pytest.raises(Exception, match="does not fit into 62 bits"):
        topk_search.top_k(table, table.union(spark.createDataFrame([(9, [2.0**60, 1.0], 1, "x")], table.schema))).collect()


def test_mixing_takes_any_names(spark):
    rows = [(i, "ab"[i % 2], None if i % 5 == 0 else "en", "t", i, 7) for i in range(40)] * 2
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, `_0` string, `_topic_id` int, probability int")
    topics = spark.createDataFrame([(i, i % 3) for i in range(20)], "vec_id long, label int")
    weighed = mixing.with_topic(table, topics, "doc_id", "vec_id", "label")
    assert weighed.columns == [*table.columns, "topic"]
    found = mixing.mixed(weighed, F.col("_topic_id"), F.col("doc_id"))
    assert found.columns == ["doc_id", "source", "lang", "_0", "_topic_id", "topic", "probability", "taken"]
    fate = {}
    for r in found.collect():
        fate.setdefault(r.doc_id, set()).add(r.taken)
    assert all(len(x) == 1 for x in fate.values()) and len(fate) == 40


def test_sharding_takes_any_names(spark):
    table = spark.createDataFrame([(i % 7, i, i, "p") for i in range(50)], "doc_id long, `_part` int, `_index` int, `_tie` string")
    rows = sharding.sharded(table, shards=4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, n) for s in range(4) for n in range(13 if s < 2 else 12)]
    assert {r._part for r in rows} == set(range(50))


def test_decontamination_of_short_items_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 3000, n))
    items = [(i, prose(24), "answer") for i in range(12)] + [(20, "one very short item indeed", None), (21, "", None), (22, "word", None)]
    rows = [(i, prose(200)) for i in range(40)]
    rows += [(50, f"{prose(90)} {items[2][1]} {prose(60)}"), (51, f"{prose(30)} One very, short ITEM indeed"), (52, f"one very short items indeed {prose(9)}"), (52, items[7][1]), (52, items[7][1]), (None, items[3][1]), (60, None), (61, "")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, numbers string")
    bench = spark.createDataFrame(items, "item_id long, text string, note string")
    found = sorted(((r.doc_id or -1, r.item_id, r.start_word) for r in decontaminate.contaminated(table, bench).collect()))
    assert [x[:2] for x in found] == [(-1, 3), (50, 2), (51, 20), (52, 7), (52, 7)] and found[2][2] == 30
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    assert sorted(((r.doc_id or -1, r.item_id, r.start_word) for r in decontaminate.contaminated(table, bench).collect())) == found
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns and kept.count() == table.count() - 5
    repeated = bench.union(bench)
    assert decontaminate.contaminated(table, repeated).count() in (5, 10)


def test_paraphrases_are_found(spark):
    rng = np.random.default_rng(12)
    prose = lambda n: [f"t{x}" for x in rng.zipf(1.2, n) % 4000]
    items = [prose(40) for _ in range(60)]
    rows = []
    for i, item in enumerate(items):
        changed = [("new" + w if rng.random() < 0.12 else w) for w in item if rng.random() > 0.08]
        rows.append((i, " ".join(prose(150) + changed + prose(80))))
    rows += [(1000 + i, " ".join(prose(250))) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    # Brute force: the item's words in order anywhere near its place, as the operator asks.
    wanted = set()
    for d, text in rows:
        numbers = {w: n for n, w in enumerate(dict.fromkeys(decontaminate.words(text) + [w.encode() for x in items for w in x]))}
        whole = [numbers[w] for w in decontaminate.words(text)]
        for i, item in enumerate(items):
            ids = [numbers[w.encode()] for w in item]
            checker = decontaminate.Item(i, ids, ids)
            if any(checker.check(whole[max(0, at - 40) : at + 88]) for at in range(0, len(whole), 16)):
                wanted.add((d, i))
    assert len(wanted) >= 50 and len(found & wanted) >= 0.95 * len(wanted) and found <= wanted


def test_passage_pairs_against_brute_force(spark):
    """Families of versions of a passage; whoever shares a passage with anyone must hang together."""
    rng = np.random.default_rng(31)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    texts, families = {}, {}
    for family in range(40):
        passage = prose(60)
        for version in range(5):
            changed = list(passage)
            for at in rng.choice(60, int(rng.integers(0, 3)), replace=False):
                changed[at] = f"edit{rng.integers(10**6)}"
            texts[len(texts)] = prose(int(rng.integers(20, 90))) + changed + prose(40)
            families.setdefault(family, []).append(len(texts) - 1)
    for _ in range(30):
        texts[len(texts)] = prose(150)
    hashes = {i: passages.shingle_hashes(" ".join(t)) for i, t in texts.items()}
    wanted = {(b, a) for members in families.values() for a in members for b in members if a < b and passages.common_passages(hashes[b], hashes[a])}
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    found = {(r.doc_id, r.match_id) for r in passages.near_duplicate_passages(rows).collect()}
    assert found <= wanted  # no pair that brute force does not have
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        root[max(top(a), top(b))] = min(top(a), top(b))
    joined = sum(top(a) == top(b) for a, b in wanted)
    # A version that is far from its family's first one may hang on nobody: 196 of 212 here.
    assert len(wanted) > 150 and joined >= 0.9 * len(wanted)


def test_passages_lose_no_link(spark):
    """Versions far from their family's first one, with words changed, left out and put in: all that brute force finds is connected."""
    rng = np.random.default_rng(17)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    texts, wanted = {}, set()
    for _ in range(60):
        passage, family = prose(int(rng.integers(55, 140))), []
        for _ in range(7):
            changed = list(passage)
            for at in sorted(rng.choice(len(passage), int(rng.integers(1, 5)), replace=False), reverse=True):
                changed[at : at + 1] = [[], ["edit", f"e{rng.integers(10**6)}"], [f"e{rng.integers(10**6)}"]][rng.integers(3)]
            texts[len(texts)] = " ".join(prose(int(rng.integers(0, 90))) + changed + prose(40))
            family.append(len(texts) - 1)
        hashes = {i: passages.shingle_hashes(texts[i]) for i in family}
        wanted |= {(b, a) for a in family for b in family if a < b and passages.common_passages(hashes[b], hashes[a])}
    found = passages.near_duplicate_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        a, b = top(r.doc_id), top(r.match_id)
        root[max(a, b)] = min(a, b)
    assert len(wanted) > 300 and all(top(a) == top(b) for a, b in wanted)
    assert all(r.match_id < r.doc_id for r in found) and len({(r.doc_id, r.match_id, r.first_word, r.match_first_word) for r in found}) == len(found)


def test_passages_of_copies_hang_on_one_document(spark):
    """A passage in many documents makes as many rows, not as many as its pairs."""
    rng = np.random.default_rng(3)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    passage = prose(55)
    rows = spark.createDataFrame([(i, " ".join(prose(30) + passage + prose(30))) for i in range(1200)], "doc_id long, text string")
    found = passages.near_duplicate_passages(rows).collect()
    assert {(r.doc_id, r.match_id) for r in found} == {(i, 0) for i in range(1, 1200)} and len(found) == 1199


def test_passages_aside_are_brought_together_once(spark, monkeypatch):
    """Rows that share a line but no passage with a large family: texts meet, and only those alike enough are compared."""
    rng = np.random.default_rng(8)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    passage = prose(60)
    line = passage[20:46]
    # Two versions that are too far from the family's first one, but not from each other; one that is near to a single member.
    far = passage[:17] + prose(3) + line + prose(4) + passage[50:]
    texts = [(0, passage)] + [(i, prose(30) + passage + prose(30)) for i in range(1, 60)] + [(i, prose(30) + line + prose(60)) for i in range(60, 120)]
    texts += [(120, prose(20) + far + prose(20)), (121, far)]
    hashes = {i: passages.shingle_hashes(" ".join(t)) for i, t in texts}
    rows = [(i >= 60, i, i if i >= 60 else 0, hashes[i]) for i in hashes] + [(False, i, i, hashes[i]) for i in hashes if i >= 60]
    compared, compare = [], passages.common_passages
    monkeypatch.setattr(passages, "common_passages", lambda a, b: compared.append(1) or compare(a, b))
    found = passages._links(rows)
    assert {x[:2] for x in found} == {(121, 120)} and len(compared) <= 2 * 60 + 2
    monkeypatch.undo()
    # Slices of a few rows give the same connections.
    monkeypatch.setattr(passages, "SLICE_BYTES", 5_000)
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = {(r.doc_id, r.match_id) for r in passages.near_duplicate_passages(frame).collect()}
    assert {(i, 0) for i in range(1, 60)} <= got and (121, 120) in got and {x for p in got for x in p} == {*range(60), 120, 121}


def test_passages_of_connected_documents_are_all_found(spark):
    """Documents that hang together by another passage, and whose common line is in an earlier text, too, which is not similar."""
    rng = np.random.default_rng(12)
    prose = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    licence, texts = prose(60), {}
    for _ in range(12):
        before, line = prose(18), prose(32)
        texts[len(texts)] = prose(40) + line + prose(40) + licence + prose(20)
        for _ in range(4):
            texts[len(texts)] = prose(30) + before + prose(1) + line + prose(40) + licence + prose(10)
    hashes = {i: passages.shingle_hashes(" ".join(t)) for i, t in texts.items()}
    wanted = [(b, *x) for b in texts for a in texts if a < b for x in passages.common_passages(hashes[b], hashes[a])]
    found = passages.near_duplicate_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    rows = {}
    for r in found:
        rows.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
    missed = [(b, x) for b, *x in wanted if sum(any(f <= w < e for f, e in rows.get(b, [])) for w in range(x[0], x[1])) < 0.8 * (x[1] - x[0])]
    assert len({b for b, first, *_ in wanted if first < 60}) >= 30 and not missed
    # A line or a licence is no reason to report all pairs.
    assert len(found) <= 4 * len(texts)


def test_lines_of_many_texts_pair_no_texts(monkeypatch):
    """Texts with a line in common are not compared, and nothing is counted for each pair of them."""
    rng = np.random.default_rng(13)
    line = rng.integers(0, 1 << 60, 24).astype(np.uint64)
    texts = [np.concatenate((rng.integers(0, 1 << 60, 60).astype(np.uint64), line, rng.integers(0, 1 << 60, 60).astype(np.uint64))) for _ in range(400)]
    texts.append(texts[7].copy())
    counted, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a: counted.append(len(x)) or bincount(x, *a))
    found = passages._links([(aside, i, i, t) for aside in (True, False) for i, t in enumerate(texts)])
    assert {x[:2] for x in found} == {(400, 7)}
    assert sum(counted) < 2 * sum(map(len, texts))
