import numpy as np
import pytest

from quire.llm import ann, queries


def brute(ids, x, k=20, every=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def check(rows, want, k, recall):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, own in got.items():
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and len(own) == min(k, len(want[q]))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {v for v, _ in want[q]})
        total += len(want[q])
    assert hits >= recall * total
    return hits / max(1, total)


def test_query_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    check(queries.op7_nearest(spark, sf_dir).collect(), brute(ids, x), 20, 0.9)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 4
    return centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))


def test_few_parts_suffice_where_there_is_structure(clustered):
    router = ann.fit(clustered, 10)
    assert router.parts == 32 and router.probes <= 16 and router.measured >= ann.RECALL


def test_partition_is_balanced(clustered):
    x = ann.unit(clustered)
    graph = ann.nearest(x, x, 12, np.arange(len(x)))
    label = ann.split(graph, x, 16)
    sizes = np.bincount(label, minlength=16)
    assert sizes.max() <= 1.06 * len(x) / 16 + 1
    same = (label[graph] == label[:, None]).mean()
    assert same > 3 / 16  # far above chance


def test_ties_copies_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype(np.float32).astype(float)
    x[100:500] = x[100]  # one vector makes up much of the table
    ids = np.arange(900)
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 5)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, score string")
    want = brute(ids, x)
    rows = ann.search(df, recall=1.0).collect()
    assert check(rows, want, 20, 0.999) == 1.0
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [v for v, _ in w] for q, w in want.items()}


def test_odd_vectors(spark):
    good = [(k, [float(k), 1.0]) for k in range(0, 60, 3)]
    bad = [(100, None), (120, []), (140, [0.0, 0.0]), (160, [None, 1.0]), (180, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (220, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(good + bad + [(0, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = ann.search(df).collect()
    assert {r.query_id for r in rows} == {0}
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank)] == list(range(3, 60, 3))
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 3")).count() == 0


def test_dimension_of_most(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(df).collect()] == [(0, 1, 0.5)]


def test_two_levels(spark, monkeypatch, clustered):
    """Parts of too many rows are split once more, and queries go to several parts of both levels."""
    monkeypatch.setattr(ann, "PART_ROWS", 60)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 1000)
    ids = np.arange(len(clustered))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, clustered, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    routed = []
    inner = ann._inner
    monkeypatch.setattr(ann, "_inner", lambda *a: routed.append(inner(*a)) or routed[0])
    check(ann.search(df, k=10, parts=16).collect(), brute(ids, clustered, 10), 10, 0.9)
    assert len(routed[0]) > 8 and all(2 <= r.parts <= 6 for r in routed[0].values())


def test_routes_of_two_levels():
    rng = np.random.default_rng(2)
    top = ann.Router(rng.normal(size=(5, 3)), 2, 1.0)
    inner = {1: ann.Router(rng.normal(size=(5, 4)), 3, 1.0)}
    routers, x = ann.Routers(top, inner), rng.normal(size=(50, 4))
    home, (rows, parts) = routers.home(x), routers.routes(x)
    for k in range(50):
        own = parts[rows == k].tolist()
        first = np.argsort(-top.logits(x[k : k + 1]))[0][:2].tolist()
        want = {p * ann.FAN + q for p in first for q in (np.argsort(-inner[p].logits(x[k : k + 1]))[0][:3].tolist() if p in inner else [0])}
        assert set(own) == want and len(own) == len(want) and home[k] in want


def test_one_row_that_repeats_is_one_of_the_sample(spark):
    df = spark.range(3000).selectExpr("if(id < 2000, 7L, id) AS id", "array(cast(if(id < 2000, 1, id) AS double), 1.0D) AS v")
    assert ann.sampled(df, 1.0).count() == 1001 and ann.sampled(df, 0.1).count() < 200
