"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64
hashes (seed 42) of a text's word shingles, repeats included.  A text has its
A-Z lowered; words are runs of bytes other than ASCII white space.  A text with
fewer words than a shingle is one shingle; without any word (or null) its
fingerprint is zero, which links like any other.

Two fingerprints link at `distance` or fewer differing bits.  The 64 bits stand
in a ring of distance + 1 segments.  For a link there is a segment from which
the differences summed over the next l segments stay within
floor(l * distance / (distance + 1)) for every l (the pigeonring principle).  So
it has no difference in that first segment and at most two in the two after it:
of four parts of these, two agree wholly.  First segment and two parts are the
key under which fingerprints meet (26 of 64 bits at distance 4, 30 keys each);
in a bucket the chain of sums is checked, then the whole distance.

Rows of equal fingerprints are one class before anything is compared, and a
bucket gives the edges of a spanning forest, never all its pairs.  A bucket of
more than `BUCKET` classes leaves its task as it came and is dealt out anew in
pairs of blocks, so none has to fit in a task.

Nulls: a null id never names a component (one of null ids alone is null).
Repeated rows are rows of one class, each with a row of its own.  Very long texts are
hashed in parts of two megabytes.  Other columns are ignored, whatever their names.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import cut, cuts, discard, map_texts, release, spread_join, stored
from quire.llm.components import components

SEED = 42
WORDS = 4
DISTANCE = 4
BUCKET = 1 << 15


def ones(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        own = hashes[at : at + (1 << 14)]
        total += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def majority(total: np.ndarray, count: int) -> int:
    """The fingerprint of `count` hashes, `total` of which have each bit."""
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes."""
    from xxhash import xxh64_intdigest

    total, count, before = np.zeros(64, np.int64), 0, []
    for part in cuts(text):
        parts = before + part.lower().split()
        n = len(parts)
        if n < words:  # of a whole text: its only shingle
            before = parts
            continue
        before = parts[n - words + 1 :]
        joined = b" ".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - words + 1].tolist()
        ends = ends[words - 1 :].tolist()
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
        count += len(hashes)
        total += ones(hashes)
    if not count:
        return xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return majority(total, count)


FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """Adds fp, the fingerprint as a signed long."""

    def make():
        return lambda raw, _: {"fp": np.array([fingerprint(x, words) for x in raw], np.uint64).view(np.int64)}

    return map_texts(df, make, FINGERPRINT, text, keep)


class Ring:
    """Segments, keys and chain budgets for a distance."""

    def __init__(self, distance: int):
        if not 2 <= distance <= 12:
            raise ValueError("distance must be 2 to 12")
        self.distance, self.m = distance, distance + 1
        edges = [64 * k // self.m for k in range(self.m + 1)]
        self.spans = [(edges[k], edges[k + 1]) for k in range(self.m)]

    @staticmethod
    def mask(*spans: tuple[int, int]) -> int:
        return sum(((1 << (b - a)) - 1) << a for a, b in spans)

    def key_masks(self) -> list[tuple[int, int]]:
        """(segment, bits that must agree) of every key."""
        found = []
        for i, span in enumerate(self.spans):
            parts = []
            for j in (i + 1, i + 2):
                a, b = self.spans[j % self.m]
                parts += [(a, (a + b) // 2), ((a + b) // 2, b)]
            found += [(i, self.mask(span, *two)) for two in combinations(parts, 2)]
        return found

    def budgets(self, i: int) -> list[tuple[np.uint64, int]]:
        """(bits of the first l segments from i, differences allowed) for l from 2 on."""
        return [
            (np.uint64(self.mask(*[self.spans[(i + j) % self.m] for j in range(n)])), n * self.distance // self.m) for n in range(2, self.m + 1)
        ]


def squeeze(values: np.ndarray, mask: int) -> np.ndarray:
    """The masked bits of each value, moved together."""
    out, at = np.zeros_like(values), 0
    bit = 0
    while bit < 64:
        if not mask >> bit & 1:
            bit += 1
            continue
        end = bit
        while end < 64 and mask >> end & 1:
            end += 1
        out |= ((values >> np.uint64(bit)) & np.uint64((1 << (end - bit)) - 1)) << np.uint64(at)
        at, bit = at + end - bit, end
    return out


def bucket_links(fps: np.ndarray, budgets: list[tuple[np.uint64, int]]) -> tuple[list[int], list[int]]:
    """Edges (places a, b) of a spanning forest of a bucket's links.

    Breadth-first: whatever a node reaches leaves the rest, so a dense bucket
    costs about its size, not its square.
    """
    a, b = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            at = queue.pop()
            diff = fps[rest] ^ fps[at]
            near = np.ones(len(rest), bool)
            for mask, most in budgets:
                near &= np.bitwise_count(diff & mask) <= most
            if near.any():
                got = rest[near].tolist()
                a += [root] * len(got)
                b += got
                queue += got
                rest = rest[~near]
    return a, b


LINKS = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "key")])
_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _keys(classes: DataFrame, ring: Ring) -> DataFrame:
    masks = ring.key_masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            values = signed.view(np.uint64)
            for k, (_, mask) in enumerate(masks):
                key = (squeeze(values, mask) * np.uint64(len(masks)) + np.uint64(k)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signed)], names=["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp long")


def _meet(rows: DataFrame, by: list[str], ring: Ring, most: int | None) -> DataFrame:
    """Links within groups of `by` (whose first column is the key); a group of more
    than `most` rows comes back as (fp, null, key) instead."""
    chains = [ring.budgets(i) for i, _ in ring.key_masks()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by = np.zeros((0, len(by)), np.int64)
        held_fp = np.zeros(0, np.int64)
        passing: tuple | None = None  # the oversize group that is passed on

        def out(a, b, key=None):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(n, pa.int64()) if key is None else pa.array(np.full(n, key), pa.int64())],
                schema=_ARROW,
            )

        def groups(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            if len(fp) < 2:
                return None
            same = (g[1:] == g[:-1]).all(axis=1)
            starts = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.append(starts, len(fp)))
            a, b = [], []
            for at, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                own = np.unique(fp[at : at + n]).view(np.uint64)
                x, y = bucket_links(own, chains[int(g[at, 0].view(np.uint64) % np.uint64(len(chains)))])
                signed = own.view(np.int64)
                a += signed[x].tolist()
                b += signed[y].tolist()
            return out(a, b) if a else None

        for batch in batches:
            g = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by])
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            if passing is not None:
                mine = (g == np.array(passing)).all(axis=1)
                if mine.any():
                    yield out(fp[mine], None, passing[0])
                    g, fp = g[~mine], fp[~mine]
                if not len(fp):
                    continue
                passing = None
            g, fp = np.concatenate([held_by, g]), np.concatenate([held_fp, fp])
            if not len(fp):
                continue
            last = int(np.flatnonzero(~(g == g[-1]).all(axis=1))[-1]) + 1 if not (g[0] == g[-1]).all() else 0
            if (found := groups(g[:last], fp[:last])) is not None:
                yield found
            held_by, held_fp = g[last:], fp[last:]
            if most is not None and len(held_fp) > most:
                passing = tuple(held_by[0].tolist())
                yield out(held_fp, None, passing[0])
                held_by, held_fp = held_by[:0], held_fp[:0]
        if (found := groups(held_by, held_fp)) is not None:
            yield found
        del held_by, held_fp
        release()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, LINKS)


def links(classes: DataFrame, distance: int = DISTANCE, most: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all
    that any link of `distance` or fewer bits connects."""
    ring = Ring(distance)
    met = cut(_meet(_keys(classes, ring), ["key"], ring, most))
    found = met.where("b is not null").select("a", "b")
    large = met.where("b is null").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return found
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("n"))
    dealt = large.join(blocks, "key").withColumn("x", F.pmod(F.xxhash64("fp"), F.col("n")))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).cast("long"))
    dealt = dealt.select("key", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "fp")
    return found.unionByName(_meet(dealt, ["key", "lo", "hi"], ring, None).select("a", "b"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per row of `df`: doc_id, fp (signed), component_id.

    component_id is the least id that links reach from the row.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = stored(fingerprints(rows, "text", words, keep=["doc_id"]), "fingerprints")
    total = fps.count()
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), total)
    roots = components(links(classes, distance))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted.withColumnRenamed("n", "copies"), total)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    names = cut(spread_join(rooted, named, "root", total).select("fp", "component_id", F.col("copies").alias("n")), total)
    discard(rooted)
    return spread_join(fps, names, "fp", total).select("doc_id", "fp", "component_id")
