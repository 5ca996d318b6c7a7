"""Toxicity by class-conditional Kneser-Ney models.

An expression is a lower-cased word without the ASCII marks around it, after the
word before it (or the start of the text).  Texts repeat lines and words, so the
models count in how many texts of a class (toxic, ordinary) a pair or a word
occurs, and a text has each of its different pairs once.  Per class c

    P_c(w | v) = (n_c(v, w) - d) / n_c(v) + l_c(v) P_c(w)
    P_c(w)     = (n_c(w) - D) / N_c + l_c K(w) / sum K

with n_c(v) the sum of n_c(v, w), N_c that of n_c(w), and l the mass that the
discounts free.  Discounts depend on the count, as in the modified form (`WORDS`,
`PAIRS`).  K(w), which both classes share, is the continuation count: how many
different words w follows anywhere in all documents (the start of a text counts as
one), corrected for collisions; it grows with the input.  Pairs are told apart by the
second word's 64-bit and the first's 32-bit hash, and each is sent once by a task, with
its counts: leading words that share those 32 bits share the mass of their backoff.

Toxic texts consist of ordinary language for the most part, so the toxic model of
a text takes every expression from the toxic class with a probability of a and
from the ordinary one else.  A text's evidence is the difference of the two
log-likelihoods divided by the text's length (its different pairs):

    mean of log((1 - a) P_ordinary(w | v) + a P_toxic(w | v)) - log P_ordinary(w | v)

A logistic curve over the logarithms of evidence and length gives the score.  It is
fitted, and a chosen from `SHARES`, on at most `CALIBRATION_ROWS` labelled texts
(by a hash, at most a quarter) that no count has used; all other labelled texts are
counted, those that two ids share once.  If one of the two sides lacks a class,
other hashes are tried; if none will do, all rows are counted and the curve is
fitted on counted rows.  Rows whose crc32 of the id mod 5 is 0 are never learned
from.

What words, leading words and pairs add is broadcast as arrays while each has at
most `BROADCAST_WORDS` rows, else joined.

Nulls: a null text is empty and has no evidence; null or missing labels and null
ids are not learned from.  Repeated label rows of an id count as toxic if any is;
rows that repeat id and text count as often as they occur.  Without labels of both
classes every score is the share of toxic rows (0.5 without any), and the model is
not `informed`.  Texts of any length are split in parts.  An empty table gives no
rows.  Input columns are kept, but for those named like an output column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import binary, cut, cuts, distinct, few, held_out, map_texts, release, slices, small_or_shuffled, text_batches

#: Discounts of words and of pairs that one, two, three or more texts hold.
WORDS = (1.0, 0.75, 0.5)
PAIRS = (1.0, 2.0, 3.0)
#: Texts from which a pair's count is above its discount.
FREQUENT = 4
#: Shares of expressions that a toxic text may owe to its class.
SHARES = (0.01, 0.03, 0.1)
FLOOR = 1e-3
CALIBRATION_ROWS = 20_000
#: Rows of words, leading words or pairs that may be broadcast; more are joined.
BROADCAST_WORDS = 2_000_000
#: Words that a scoring worker remembers.
CACHE_WORDS = 100_000
#: Distinct pairs of words that a task gathers before it hands them on.
GATHERED = 1_500_000
SEED = 42
MARKS = b".,;:!?\"'()[]{}<>*#$%&-_/\\|+=~`@^"


@dataclass
class Model:
    words: DataFrame  # h, r: ratio of P_toxic(w) and P_ordinary(w) where it isn't `base`
    leads: DataFrame  # h, r: ratio of the masses that backoff after h has, where it isn't 1
    pairs: DataFrame  # h (the word before), other, r: ratio of the pair's probabilities
    base: float
    share: float
    curve: tuple[float, float, float]  # bias, slopes of the logarithms of evidence and length
    informed: bool = True  # whether rows of both classes were learned from


def tokens(text: bytes) -> list[bytes]:
    found = [w.strip(MARKS) for part in cuts(text) for w in part.lower().split()]
    return [w for w in found if w]


def parts_of(size: int) -> int:
    """Parts that the words of so many bytes of texts are dealt in: one for a megabyte
    up to 4096, as every task has a row for each; then as many as memory asks for."""
    return max(64, min(4096, size >> 20), size >> 34)


def mixed(lead: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One 64-bit key of two hashes."""
    key = lead * np.uint64(0x9E3779B97F4A7C15) ^ (other + np.uint64(0x7F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ key >> np.uint64(31)


def summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return [keys[starts], *[np.add.reduceat(c[order], starts, dtype=c.dtype) if len(keys) else c for c in counts]]


#: Words of a part, their pairs (the words before), a word's counts (texts that hold it, its
#: pairs as the word before) and a pair's; by label, toxic first.
_BLOBS = ("words", "sizes", "others", "a", "b", "c", "d", "toxic", "ordinary")


def narrowed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def widened(raw: bytes, n: int) -> np.ndarray:
    """The `n` counts of `narrowed`."""
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.uint32) if n else np.zeros(0, np.uint32)


class Gathered:
    """What a task has counted.

    Words have numbers in order of arrival.  `held` are the distinct pairs (word, word
    before) of all texts, with the number of labelled texts of either class.
    """

    def __init__(self, parts: int):
        self.parts = parts
        self.known: dict[bytes, int] = {b"": 0}  # the start of a text
        self.held = [np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.more: tuple[list, list, list] = ([], [], [])  # by label, the last without
        self.texts: tuple[list, list] = ([], [])  # words of texts, by label
        self.more_size = 0

    def add(self, words: list[bytes], label: int | None) -> None:
        known = self.known
        for w in set(words).difference(known):
            known[w] = len(known)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        own = distinct(ids << np.uint64(32) | np.r_[np.uint64(0), ids[:-1]])
        self.more[2 if label is None else label].append(own)
        self.more_size += len(own)
        if label is not None:
            self.texts[label].append(distinct(ids.astype(np.uint32)))
        if self.more_size > GATHERED // 3:
            self.settle()

    def settle(self) -> None:
        keys, a, b = self.held
        toxic, ordinary, rest = (np.concatenate([np.zeros(0, np.uint64), *self.more[k]]) for k in (1, 0, 2))
        new = np.repeat(np.arange(3), [len(toxic), len(ordinary), len(rest)])
        counts = [np.concatenate([old, (new == k).astype(np.uint32)]) for k, old in enumerate((a, b))]
        self.held = summed(np.concatenate([keys, toxic, ordinary, rest]), *counts)
        self.more, self.more_size = ([], [], []), 0

    def full(self) -> bool:
        return len(self.held[0]) > GATHERED

    def rows(self) -> pa.RecordBatch | None:
        """A row for each part of the words."""
        from xxhash import xxh64_intdigest

        self.settle()
        n = len(self.known)
        if n == 1:
            return None
        hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in self.known), np.uint64, n)
        part = (hashes % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort([hashes, part])  # words by part
        rank = np.empty(n, np.uint64)
        rank[order] = np.arange(n, dtype=np.uint64)
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        low, half = np.uint64(2**32 - 1), np.uint64(32)
        lead = (self.held[0] & low).astype(np.int64)
        counts = [np.bincount(np.concatenate([np.zeros(0, np.uint32), *self.texts[k]]), minlength=n) for k in (1, 0)]
        counts += [np.bincount(lead, weights=c, minlength=n) for c in self.held[1:]]
        counts = [c[order].astype(np.uint32) for c in counts]
        pairs = rank[self.held[0] >> half] << half | hashes[lead] >> half
        by = np.argsort(pairs, kind="stable")
        pairs, per_pair = pairs[by], [c[by] for c in self.held[1:]]
        others, sorted_hashes = pairs.astype(np.uint32), hashes[order]
        sizes = np.bincount((pairs >> half).astype(np.int64), minlength=n)
        ends = np.append(0, np.cumsum(sizes))
        out: list[tuple] = []
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            x, y = edges[k], edges[k + 1]
            own = slice(ends[x], ends[y])
            out.append((k, sorted_hashes[x:y].tobytes(), narrowed(sizes[x:y]), others[own].tobytes(), *[narrowed(c[x:y]) for c in counts], *[narrowed(c[own]) for c in per_pair]))
        types = [pa.int32(), *[pa.binary()] * len(_BLOBS)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["part", *_BLOBS])


class Joined:
    """The joined rows of one part."""

    def __init__(self):
        self.held, self.size, self.most = [], 0, GATHERED

    def add(self, blobs: list[bytes]) -> None:
        words, sizes, others, *counts = blobs
        words, others = np.frombuffer(words, np.uint64), np.frombuffer(others, np.uint32)
        lengths = [len(words)] * 4 + [len(others)] * 2
        self.held.append([words, widened(sizes, len(words)), others, *[widened(c, n) for c, n in zip(counts, lengths, strict=True)]])
        self.size += len(others)
        if self.size > self.most:  # at most about twice what is distinct is held
            self.join()
            self.size = len(self.held[0][2])
            self.most = max(GATHERED, 2 * self.size)

    def join(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        names, place = np.unique(columns[0], return_inverse=True)
        pairs, *per_pair = summed(np.repeat(place.astype(np.uint64), columns[1]) << np.uint64(32) | columns[2], *columns[7:])
        sizes = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(names)).astype(np.uint32)
        sums = [np.bincount(place, weights=c, minlength=len(names)).astype(np.uint32) for c in columns[3:7]]
        self.held = [[names, sizes, pairs.astype(np.uint32), *sums, *per_pair]]

    def rows(self) -> list[np.ndarray]:
        """kind, h, other, follows, toxic, ordinary, lead_toxic, lead_ordinary."""
        self.join()
        names, sizes, others, a, b, c, d, toxic, ordinary = self.held[0]
        often = np.flatnonzero((toxic >= FREQUENT) | (ordinary >= FREQUENT))
        follows = -(2.0**32) * np.log1p(-sizes.astype(float) / 2.0**32)
        at = np.flatnonzero((a > 0) | (b > 0) | (c > 0) | (d > 0))
        none = np.zeros(len(often), np.uint32)
        pairs = [none + 1, np.repeat(names, sizes)[often], others[often].astype(np.uint64), none.astype(float), toxic[often], ordinary[often], none, none]
        words = [np.zeros(len(at), np.uint32), names[at], np.zeros(len(at), np.uint64), follows[at], a[at], b[at], c[at], d[at]]
        total = [[2], [0], [0], [follows.sum()], [0], [0], [0], [0]]  # of all words of the part
        return [np.concatenate([x, y, np.array(z, y.dtype)]) for x, y, z in zip(pairs, words, total, strict=True)]


COUNTED = "kind int, h long, other long, follows double, toxic long, ordinary long, lead_toxic long, lead_ordinary long"


def counts(df: DataFrame, parts: int = 64) -> DataFrame:
    """Counts over rows (text, label), where label is 1, 0 or null.

    kind 0: words of labelled texts, with the texts that hold them, the number of
    their pairs as the word before, and their continuation count over all texts;
    kind 1: pairs that `FREQUENT` or more texts of a class hold; kind 2: sums of all
    words' continuation counts.

    Of a pair, h is the second word, other the upper half of the first one's hash.

    A task sends the distinct pairs it has seen, and their counts, as one row for each
    part of the words; who gets a part joins its rows as they come, so it holds no more
    than about twice the distinct pairs of one of `parts` of the words.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Gathered(parts)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for raw, label in zip(binary(part.column("text")), part.column("label").to_pylist(), strict=True):
                    if words := tokens(raw):
                        now.add(words, label)
                if now.full():
                    yield now.rows()
                    now = Gathered(parts)
        if (rows := now.rows()) is not None:
            yield rows
        del now, rows
        release()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            signed = [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(signed, types, strict=True)], names=[x.split()[0] for x in COUNTED.split(", ")])

        for batch in batches:
            for part, *blobs in zip(*[batch.column(c).to_pylist() for c in ("part", *_BLOBS)], strict=True):
                if part != at:
                    if now is not None:
                        yield out(now.rows())
                    at, now = part, Joined()
                now.add(blobs)
        if now is not None:
            yield out(now.rows())
        del now
        release()

    each = text_batches(df.select("text", "label")).mapInArrow(gather, "part int, " + ", ".join(f"{c} binary" for c in _BLOBS))
    return each.repartition("part").sortWithinPartitions("part").mapInArrow(join, COUNTED)


def _above(count: Column, discounts: tuple[float, ...]) -> Column:
    """What of a count its discount leaves."""
    less = F.when(count >= 3, discounts[2]).when(count >= 2, discounts[1]).otherwise(discounts[0])
    return F.when(count > 0, count - less).otherwise(0.0)


def tables(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float] | None:
    """words, leads, pairs and the base ratio from the `counts`; None without both classes."""
    names = ("toxic", "ordinary")
    sums = [F.sum(F.when(F.col("kind") == 2, F.col("follows"))).alias("follows")]
    for c in names:
        sums += [F.sum(F.when(F.col("kind") == 0, F.col(c))).alias(c), F.sum(F.when(F.col("kind") == 0, _above(F.col(c), WORDS))).alias(f"{c}_above")]
    total = found.agg(*sums).first()
    if not total["toxic"] or not total["ordinary"]:
        return None
    free = {c: 1 - total[f"{c}_above"] / total[c] for c in names}
    words = found.where("kind = 0")
    for c in names:
        words = words.withColumn(f"p_{c}", _above(F.col(c), WORDS) / total[c] + free[c] * F.col("follows") / total["follows"])
    base = free["toxic"] / free["ordinary"]
    ratios = words.where("toxic > 1 or ordinary > 1").select("h", (F.col("p_toxic") / F.col("p_ordinary")).alias("r"))
    pairs = found.where("kind = 1").select("h", F.col("other").alias("lead"), *[F.greatest(F.col(c) - PAIRS[2], F.lit(0.0)).alias(c) for c in names])
    upper = F.shiftrightunsigned("h", 32).alias("lead")
    masses = words.groupBy(upper).agg(*[F.sum(f"lead_{c}").alias(f"lead_{c}") for c in names])
    leads = pairs.groupBy("lead").agg(*[F.sum(c).alias(c) for c in names]).join(masses, "lead")
    for c in names:
        leads = leads.withColumn(f"free_{c}", F.when(F.col(f"lead_{c}") > 0, 1 - F.col(c) / F.col(f"lead_{c}")).otherwise(1.0))
    leads = leads.join(words.select("h", upper), "lead")
    leads = cut(leads.select("h", "lead", *[f"free_{c}" for c in names], *[f"lead_{c}" for c in names]))
    known = words.where((F.col("toxic") >= FREQUENT) | (F.col("ordinary") >= FREQUENT)).select(F.col("h").alias("word"), *[f"p_{c}" for c in names])
    pairs = pairs.withColumnRenamed("h", "word").join(leads, "lead").join(known, "word")
    for c in names:
        own = F.when(F.col(f"lead_{c}") > 0, F.col(c) / F.col(f"lead_{c}")).otherwise(0.0)
        pairs = pairs.withColumn(f"q_{c}", own + F.col(f"free_{c}") * F.col(f"p_{c}"))
    return (
        cut(ratios),
        cut(leads.select("h", (F.col("free_toxic") / F.col("free_ordinary")).alias("r"))),
        cut(pairs.select("h", F.col("word").alias("other"), (F.col("q_toxic") / F.col("q_ordinary")).alias("r"))),
        base,
    )


class Scorer:
    """Evidence of texts; remembers the words it has looked up."""

    def __init__(self, words, leads, pairs, base: float, shares: tuple[float, ...]):
        self.words, self.leads, self.pairs, self.base, self.shares = words, leads, pairs, base, shares
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes, self.ratio, self.lead = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        self.learn([b""])

    @staticmethod
    def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default) -> np.ndarray:
        names, values = table
        if not len(names):
            return np.full(len(keys), default) if np.isscalar(default) else default
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return np.where(names[at] == keys, values[at], default)

    def learn(self, words: list[bytes]) -> None:
        from xxhash import xxh64_intdigest

        new = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
        at = len(self.known)
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.hashes = np.concatenate([self.hashes, new])
        self.ratio = np.concatenate([self.ratio, self.look_up(self.words, new, self.base)])
        self.lead = np.concatenate([self.lead, self.look_up(self.leads, new, np.nan)])

    def evidence(self, texts: list[bytes]) -> tuple[list[list[float]], list[int]]:
        """For each text the evidence at each share, and its length."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        split = [tokens(raw) for raw in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(list(new))
        found, sizes = [], []
        for words in split:
            if not words:
                found.append([0.0] * len(self.shares))
                sizes.append(0)
                continue
            ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            own = distinct(np.r_[0, ids[:-1]] << 32 | ids)
            lead, other = own >> 32, own & (2**32 - 1)
            r, free = self.ratio[other], self.lead[lead]
            some = np.flatnonzero(~np.isnan(free))
            if len(some):
                r[some] = self.look_up(self.pairs, mixed(self.hashes[lead[some]], self.hashes[other[some]]), r[some] * free[some])
            found.append([float(np.log1p(a * (r - 1)).sum() / len(own)) for a in self.shares])
            sizes.append(len(own))
        return found, sizes


def _array(df: DataFrame, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    got = df.select(*key, "r").toArrow()
    keys = [got.column(c).to_numpy().view(np.uint64) for c in key]
    one = keys[0] if len(keys) == 1 else mixed(*keys)
    order = np.argsort(one)
    return one[order], got.column("r").to_numpy()[order]


def evidences(df: DataFrame, model: Model, text: str, keep: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Adds each text's evidence at each share, __evidence_0, ..., and its length, __length."""
    names = [f"__evidence_{k}" for k in range(len(shares))]
    if all(few(t, BROADCAST_WORDS) for t in (model.words, model.leads, model.pairs)):
        base = model.base
        shared = df.sparkSession.sparkContext.broadcast((_array(model.words, ["h"]), _array(model.leads, ["h"]), _array(model.pairs, ["h", "other"])))

        def make():
            scorer = Scorer(*shared.value, base, shares)

            def work(raw, _):
                found, sizes = scorer.evidence(raw)
                return {name: [x[k] for x in found] for k, name in enumerate(names)} | {"__length": sizes}

            return work

        return map_texts(df, make, T.StructType([*[T.StructField(n, T.DoubleType()) for n in names], T.StructField("__length", T.LongType())]), text, keep, most=1 << 20)
    kept = [c for c in keep if c not in names]
    rows = cut(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"), F.expr("uuid()").alias("__row")))

    def split(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part in slices(batch, "__text", 1 << 18):
                for row, raw in zip(part.column("__row").to_pylist(), binary(part.column("__text")), strict=True):
                    words = tokens(raw)
                    pairs = sorted(set(zip([b"", *words], words, strict=False)))
                    hashes = [np.fromiter((xxh64_intdigest(p[k], SEED) for p in pairs), np.uint64, len(pairs)).view(np.int64) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(pairs), pa.string()), *map(pa.array, hashes)], names=["__row", "h", "other"])

    each = text_batches(rows.select("__row", "__text")).mapInArrow(split, "__row string, h long, other long")
    each = each.join(model.pairs.withColumnRenamed("r", "pair"), ["h", "other"], "left").join(model.leads.withColumnRenamed("r", "lead"), "h", "left")
    each = each.join(model.words.select(F.col("h").alias("other"), F.col("r").alias("word")), "other", "left")
    r = F.coalesce("pair", F.coalesce("lead", F.lit(1.0)) * F.coalesce("word", F.lit(model.base)))
    sums = each.groupBy("__row").agg(*[F.avg(F.log1p(a * (r - 1))).alias(n) for a, n in zip(shares, names, strict=True)], F.count("*").alias("__length"))
    return rows.join(sums, "__row", "left").select(*kept, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names], F.coalesce("__length", F.lit(0)).alias("__length"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Bias and slopes of a logistic curve, by Newton steps with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta)), design.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def _sides(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counted, calibrated) rows (doc_id, h, label) of distinct texts, both with both classes if that can be."""
    n = texts.count()
    below = int((1 << 20) * min(0.25, CALIBRATION_ROWS / max(1, n)))
    aside = [F.pmod(F.xxhash64(F.lit(k), F.col("h")), F.lit(1 << 20)) < below for k in range(4)]
    sums = [F.sum((c & (F.col("label") == y)).cast("long")) for c in aside for y in (0, 1)]
    *inside, ordinary, toxic = texts.agg(*sums, *[F.sum((F.col("label") == y).cast("long")) for y in (0, 1)]).first()
    for k, c in enumerate(aside):
        a, b = inside[2 * k], inside[2 * k + 1]
        if n and a and b and a < ordinary and b < toxic:
            return texts.where(~c), texts.where(c)
    return texts, texts.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, CALIBRATION_ROWS / max(1, n))))


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the labelled rows of `df`; continuation counts cover all its rows."""
    spark = df.sparkSession
    labels = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    seen = docs.select("doc_id", F.xxhash64("text").alias("h")).join(small_or_shuffled(labels), "doc_id")
    texts = cut(seen.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")))
    rate = texts.agg(F.avg("label")).first()[0]
    rate = 0.5 if rate is None else float(rate)
    counted, checked = _sides(texts)
    hashed = docs.withColumn("h", F.xxhash64("text"))
    found = None
    if 0 < rate < 1:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        found = tables(cut(counts(hashed.join(small_or_shuffled(counted), ["doc_id", "h"], "left"), parts_of(size))))
    if found is None:
        none = spark.createDataFrame([], "h long, other long, r double")
        return Model(none, none, none, 1.0, SHARES[0], (math.log((rate + 1e-6) / (1 - rate + 1e-6)), 0.0, 0.0), False)
    model = Model(*found, SHARES[0], (0.0, 0.0, 0.0))
    sample = hashed.join(small_or_shuffled(checked), ["doc_id", "h"]).select("text", "label")
    got = evidences(sample, model, "text", ["label"], SHARES).toPandas()
    y = got["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        raise RuntimeError("the labelled texts changed while they were read")
    tried = []
    for k, share in enumerate(SHARES):
        x = np.column_stack([np.log(np.maximum(got[f"__evidence_{k}"], 0) + FLOOR), np.log1p(got["__length"])])
        curve = logistic(x, y)
        z = curve[0] + x @ np.array(curve[1:])
        tried.append((np.logaddexp(0, np.where(y > 0, -z, z)).sum(), share, curve))
    model.share, model.curve = min(tried)[1:]
    return model


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5)."""
    names = {"score", "predicted", "__evidence_0", "__length"}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    found = evidences(df, model, text, keep, (model.share,))
    bias, evidence, length = model.curve
    z = bias + evidence * F.log(F.greatest("__evidence_0", F.lit(0.0)) + FLOOR) + length * F.log1p("__length")
    return found.withColumn("score", 1 / (1 + F.exp(-z))).select(*[F.col(f"`{c}`") for c in keep], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
