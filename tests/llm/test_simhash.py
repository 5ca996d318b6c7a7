import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import common, queries, simhash
from quire.llm.components import components


def plain_fingerprint(text, words=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in lowered).split(" ") if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, distance=4):
    group = list(range(len(fps)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return [root(x) for x in range(len(fps))]


def test_fingerprints(odd_texts):
    for t in odd_texts:
        if len(t or "") < 60_000:
            assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t), t[:40]


def test_long_texts_in_parts(odd_texts, monkeypatch):
    monkeypatch.setattr(common, "LONG_TEXT", 5)
    for t in odd_texts:
        assert simhash.fingerprint((t or "").encode()[:900]) == plain_fingerprint((t or "").encode()[:900].decode(errors="ignore")), t[:40]


def test_hash_is_sparks(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("the quick brown fox"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"the quick brown fox", 42) == simhash.fingerprint(b"THE quick  brown\tfox")


@pytest.mark.parametrize("distance", [2, 3, 4, 6])
def test_ring_misses_no_link(distance):
    ring, rng = simhash.Ring(distance), np.random.default_rng(distance)
    for _ in range(400):
        a = int(rng.integers(0, 2**64, dtype=np.uint64))
        flips = rng.choice(64, rng.integers(0, distance + 1), replace=False)
        b = a ^ sum(1 << int(x) for x in flips)
        met = False
        for i, mask in ring.key_masks():
            if a & mask == b & mask:
                met |= all(((a ^ b) & int(m)).bit_count() <= most for m, most in ring.budgets(i))
        assert met
    assert sum(b - a for a, b in ring.spans) == 64


def near_fps(n, seed=0):
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 2**64, 12, dtype=np.uint64)
    out = []
    for _ in range(n):
        f = int(rng.choice(seeds))
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            f ^= 1 << int(bit)
        out.append(f)
    return out


@pytest.mark.parametrize("most", [2, 7, simhash.BUCKET])
def test_links_connect_as_all_pairs_do(spark, most):
    fps = sorted(set(near_fps(250)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(classes, 4, most)).collect()}
    named = [roots.get(x, x) for x in signed]
    want = plain_groups(fps)
    assert len(set(named)) == len(set(want)) == len(set(zip(named, want, strict=True)))


def test_squeeze():
    assert simhash.squeeze(np.array([0b110110], np.uint64), 0b101010).tolist() == [0b101]


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 102), (102, 101), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in (100, 101, 102, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_all_pairs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op2_simhash(spark, sf_dir).collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[d]) if len(texts[d]) < 3000 else simhash.fingerprint(texts[d].encode()) for d in ids]
    assert [got[d].fingerprint for d in ids] == [f"{f:016x}" for f in fps]
    assert [got[d].component_id for d in ids] == [ids[k] for k in plain_groups(fps)]


def test_odd_documents(odd_docs, odd_texts, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_texts) + 1
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[0] == by_id[1] == by_id[2] == 0  # no words: fingerprint zero
    assert by_id[7] == by_id[8] == by_id[9] == 7
    assert simhash.near_duplicates(no_docs).count() == 0


def test_null_ids_alone(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "f g")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(None, None), (3, 3)}


def test_a_component_of_30000_documents(spark):
    star = spark.range(1, 30_000).selectExpr("id AS a", "40000L AS b")  # the centre is the largest node
    tail = spark.range(40_000, 40_200).selectExpr("id AS a", "id + 1 AS b")
    apart = spark.range(50_000, 50_100).selectExpr("id AS a", "id + 1000 AS b")
    found = components(star.unionByName(tail).unionByName(apart))
    sizes = {r.root: r.n for r in found.groupBy("root").agg(F.countDistinct("node").alias("n")).collect()}
    assert sizes[1] == 30_200 and len(sizes) == 101 and found.count() == 30_400


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(100).selectExpr("id", "if(id % 3 = 0, 0, id) AS k")
    side = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.col("k") * 10)
    assert {(r.id, r.k, r.name) for r in common.spread_join(rows, side, "k", 100).collect()} == {(i, 0 if i % 3 == 0 else i, 0 if i % 3 == 0 else 10 * i) for i in range(100)}


@pytest.mark.parametrize("alone", [0, 10**6])
def test_components_in_one_task_or_in_many(spark, monkeypatch, alone):
    from quire.llm import components as module

    monkeypatch.setattr(module, "ALONE", alone)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (201, None), (300, 301), (301, 300)]
    found = module.components(spark.createDataFrame(links, "a long, b long"))
    want = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 140), 100) | {300: 300, 301: 300}
    assert {r.node: r.root for r in found.collect()} == want and found.count() == len(want)
    assert module.components(spark.createDataFrame([], "a long, b long")).count() == 0
