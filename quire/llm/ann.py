"""Nearest neighbours by learned partitions.

On a sample of about `SAMPLE_ROWS` vectors (by a hash of id and vector): the graph of
each vector's nearest neighbours is split into balanced parts (recursive median
cuts, then moves that keep neighbours together while no part outgrows its
share), and a softmax classifier learns in which parts a vector's neighbours
lie.  The classifier then deals every vector of the table to its likeliest part
and every query to several; how many is the least number that finds `RECALL` of
the sample's true neighbours.

The parts of a sample grow with the square root of the rows, up to one for 48 of its
vectors.  A part of more than twice `PART_ROWS` rows is split once more, by a
classifier of its own, which its rows' own sample teaches on an executor; queries go to
several of the parts that follow in each of theirs.  So the vectors that a query meets
stay about as many while a table grows (to some 400 million rows), if vectors have
structure.

Vectors lie in blocks of at most `BLOCK`, each in one place; queries are copied to the
blocks of their parts, and stream by the block that a task holds.  A part that a third of
all vectors fall into is many blocks.  Each block gives its best per query, and a last
step ranks them.

Nearness is the inner product in double precision of the original vectors; ties
go to the smaller id.  Null ids and vectors that are null, zero, or hold null or
non-finite components take no part; vectors of different lengths, which have no inner
product, are searched apart.  Of repeated
query ids one row (the least vector) asks; repeated candidates are candidates
each, but never a query's own id.  An empty table gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import release, remove, stored_at

SAMPLE_ROWS = 8192
PARTS = 32
NEIGHBOURS = 12
RECALL = 0.96
#: Vectors of a block, and queries that meet it at once, at most.
BLOCK = 16_384
QUERIES = 2048
#: Rows that a part should have; twice as many are split.
PART_ROWS = 16_384
#: More than the parts that one part is split into.
FAN = 1024


@dataclass
class Router:
    weights: np.ndarray  # (dimension + 1) x parts
    probes: int
    measured: float  # recall on the sample with that many probes

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(queries: np.ndarray, base: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places of each query's k largest inner products, but its own place."""
    found = []
    for at in range(0, len(queries), 128):
        s = queries[at : at + 128] @ base.T
        if own is not None:
            s[np.arange(len(s)), own[at : at + 128]] = -np.inf
        found.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k].copy())
    return np.concatenate(found)


def split(graph: np.ndarray, x: np.ndarray, parts: int) -> np.ndarray:
    """A balanced partition of a neighbour graph (rows: places of neighbours)."""
    n = len(x)
    label = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1 or len(rows) < 2:
            label[rows] = first
            continue
        left = count // 2
        own = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(own.T @ own)[1][:, -1]
        order = np.argsort(own @ axis, kind="stable")
        cut = len(rows) * left // count
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, count - left)]
    most = int(np.ceil(1.05 * n / parts))
    sizes = np.bincount(label, minlength=parts)
    rows = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(8):
        near = np.zeros((n, parts), np.int32)
        np.add.at(near, (rows, label[graph.ravel()]), 1)
        np.add.at(near, (graph.ravel(), label[rows]), 1)
        best = near.argmax(axis=1)
        gain = near[np.arange(n), best] - near[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if sizes[best[i]] < most:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return label


def train(x: np.ndarray, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of a softmax classifier for target distributions (Adam)."""
    rng = np.random.default_rng(0)
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros((design.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(x), min(len(x), 1024))
        z = design[rows] @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = design[rows].T @ (p - target[rows]) / len(rows) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(sample: np.ndarray, k: int = 20, parts: int = PARTS, recall: float = RECALL) -> Router:
    """Learns a router from sample vectors."""
    n, dim = sample.shape
    parts = max(1, min(parts, n // 48))
    if parts == 1:
        return Router(np.zeros((dim + 1, 1)), 1, 1.0)
    x = unit(sample)
    graph = nearest(x, x, min(NEIGHBOURS, n - 1), np.arange(n))
    label = split(graph, x, parts)
    target = np.full((n, parts), 1e-3 / parts)
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), label[graph.ravel()]), 1.0)
    target[np.arange(n), label] += 2.0
    target /= target.sum(axis=1, keepdims=True)
    scale = 1.0 / max(1e-300, float(np.median(np.linalg.norm(sample, axis=1))))
    weights = train(sample * scale, target)
    weights[:-1] *= scale
    router = Router(weights, parts, 1.0)
    asked = np.random.default_rng(1).permutation(n)[: min(n, 1024)]
    true = nearest(sample[asked], sample, min(k, n - 1), asked)
    home = router.logits(sample).argmax(axis=1)
    rank = np.empty((len(asked), parts), np.int64)
    order = np.argsort(-router.logits(sample[asked]), axis=1, kind="stable")
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.take_along_axis(rank, home[true], axis=1).ravel()
    for probes in range(1, parts + 1):
        if (got := float((needed < probes).mean())) >= recall:
            return Router(weights, probes, got)
    return router


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and one that isn't zero."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(value, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def block_best(ids: np.ndarray, base: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of each query's k best in a block.

    Products of whole blocks only choose candidates, with a margin for rounding;
    their scores are summed pair by pair, alike for equal vectors.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    norms = np.linalg.norm(base, axis=1).max(initial=0)
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128]
        s = q @ base.T
        s[query_ids[at : at + 128][:, None] == ids[None, :]] = -np.inf
        if s.shape[1] > k:
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            floor = floor - 1e-12 * np.linalg.norm(q, axis=1) * norms
        else:
            floor = np.full(len(q), -np.inf)
        row, col = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
        exact = np.concatenate([(q[row[a : a + 65536]] * base[col[a : a + 65536]]).sum(axis=1) for a in range(0, len(row), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        best = place < k
        out.append((row[best] + at, ids[col[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


@dataclass
class Routers:
    """A router, and routers of some of its parts; a part's number is FAN times that of the
    first router and that of the second."""

    top: Router
    inner: dict[int, Router]

    def home(self, x: np.ndarray) -> np.ndarray:
        first = self.top.logits(x).argmax(axis=1)
        out = first * FAN
        for p in set(first.tolist()) & self.inner.keys():
            own = np.flatnonzero(first == p)
            out[own] += self.inner[p].logits(x[own]).argmax(axis=1)
        return out

    def routes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of vectors, parts to ask): the likeliest parts of each."""
        first = likeliest(self.top, x)
        rows, parts = [], []
        for p in np.unique(first).tolist():
            own = np.flatnonzero((first == p).any(axis=1))
            to = likeliest(self.inner[p], x[own]) if p in self.inner else np.zeros((len(own), 1), np.int64)
            rows.append(np.repeat(own, to.shape[1]))
            parts.append(p * FAN + to.ravel())
        return np.concatenate(rows), np.concatenate(parts)


def likeliest(router: Router, x: np.ndarray) -> np.ndarray:
    return np.argsort(-router.logits(x), axis=1, kind="stable")[:, : router.probes]


def search(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """The k nearest of each query (ids divisible by `every`): query_id, rank, vec_id, score."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null").where(usable(F.col("v")))
    sizes = {r["dim"]: r["count"] for r in rows.groupBy(F.size("v").alias("dim")).count().collect()}
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, total in sorted(sizes.items()):
        empty = empty.unionByName(_search(rows.where(F.size("v") == dim), dim, total, k, every, parts, recall))
    return empty


def sampled(rows: DataFrame, share: Column | float) -> DataFrame:
    """About this share of the different rows (id, v), by their hash."""
    return rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["id", "v"])


def _inner(base: DataFrame, counts: dict[int, int], dim: int, k: int, recall: float) -> dict[int, Router]:
    """Routers of the parts that have too many rows; each is fitted in a task of its own."""
    large = {p: n for p, n in counts.items() if n > 2 * PART_ROWS}
    if not large:
        return {}
    shares = F.broadcast(base.sparkSession.createDataFrame([(p, min(1.0, SAMPLE_ROWS / n), min(FAN, -(-n // PART_ROWS))) for p, n in large.items()], "part int, share double, wanted int"))
    sample = sampled(base.join(shares, "part"), F.col("share")).select("part", "v", "wanted")

    def learn(key, own):
        router = fit(matrix(own.column("v"), dim), k, own.column("wanted")[0].as_py(), recall)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([router.weights.tobytes()], pa.binary()), "probes": pa.array([router.probes], pa.int32()), "measured": [router.measured]})

    found = sample.groupBy("part").applyInArrow(learn, "part int, weights binary, probes int, measured double").collect()  # a row a part
    return {r.part: Router(np.frombuffer(bytes(r.weights)).reshape(dim + 1, -1), r.probes, r.measured) for r in found}


def _search(rows: DataFrame, dim: int, total: int, k: int, every: int, parts: int, recall: float) -> DataFrame:
    """`search` among `total` vectors (id, v) of one length."""
    spark = rows.sparkSession
    parts = max(parts, int(total**0.5 / 8))
    twice = total > 2 * PART_ROWS * min(parts, SAMPLE_ROWS // 48)  # of two steps each finds its share
    recall = recall**0.5 if twice else recall
    sample = sampled(rows, min(1.0, SAMPLE_ROWS / total)).select("v").toArrow()
    routers = Routers(fit(matrix(sample.column("v"), dim) if sample.num_rows else np.zeros((0, dim)), k, parts, recall), {})

    def dealt(df: DataFrame, routers: Routers) -> DataFrame:
        shared = spark.sparkContext.broadcast(routers)

        def home(batches):
            for batch in batches:
                part = shared.value.home(matrix(batch.column("v"), dim))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(part.astype(np.int32))], names=["id", "v", "part"])

        return df.select("id", "v").mapInArrow(home, "id long, v array<double>, part int")

    def counted(df: DataFrame) -> dict[int, int]:
        return {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}  # a row a part

    base, path = stored_at(dealt(rows, routers), "parts")
    counts = counted(base)
    tops = base.withColumn("part", F.expr(f"part div {FAN}").cast("int"))
    routers.inner = _inner(tops, {p // FAN: n for p, n in counts.items()}, dim, k, recall)
    if routers.inner:
        before = path
        base, path = stored_at(dealt(base, routers), "parts")
        remove(spark, before)
        counts = counted(base)
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(routers)

    def routes(batches):
        for batch in batches:
            if batch.num_rows:
                row, part = shared.value.routes(matrix(batch.column("v"), dim))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(part.astype(np.int32))], names=["id", "v", "part"])

    blocks = F.broadcast(spark.createDataFrame([(p, -(-n // BLOCK)) for p, n in counts.items()], "part int, blocks long"))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = asked.mapInArrow(routes, "id long, v array<double>, part int").join(blocks, "part")
    queries = queries.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "id", "v")
    base = base.join(blocks, "part").select("part", F.pmod(F.xxhash64("id", "v", F.rand(1)), F.col("blocks")).alias("block"), F.lit(0).alias("asks"), "id", "v")

    def meet(batches):
        key, ids, held, waiting = None, [], [], []

        def answers():
            if ids and waiting:
                own, block = np.concatenate(ids), np.concatenate(held)
                ids[:], held[:] = [own], [block]
                asking = np.concatenate([w[0] for w in waiting])
                place, found, scores = block_best(own, block, asking, np.concatenate([w[1] for w in waiting]), k)
                yield pa.RecordBatch.from_arrays([pa.array(asking[place]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])
            waiting.clear()

        for batch in batches:
            part, block, asks = (batch.column(c).to_numpy() for c in ("part", "block", "asks"))
            own_ids, v = batch.column("id").to_numpy(), matrix(batch.column("v"), dim)
            new = (part[1:] != part[:-1]) | (block[1:] != block[:-1])
            edges = np.flatnonzero(np.r_[True, new | (asks[1:] != asks[:-1]), True]) if len(part) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if (part[a], block[a]) != key:
                    yield from answers()
                    key, ids, held = (part[a], block[a]), [], []
                if asks[a]:
                    for at in range(a, b, QUERIES):
                        waiting.append((own_ids[at : min(b, at + QUERIES)], v[at : min(b, at + QUERIES)]))
                        if sum(len(w[0]) for w in waiting) >= QUERIES:
                            yield from answers()
                else:
                    ids.append(own_ids[a:b])
                    held.append(v[a:b])
        yield from answers()
        del ids, held, waiting
        release()

    dealt_out = base.unionByName(queries).repartition("part", "block").sortWithinPartitions("part", "block", "asks")
    best = dealt_out.mapInArrow(meet, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
