"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised alike: A-Z are lowered, words are runs of a-z, 0-9 and
code points above 127.  A window is `window` consecutive words of an item; an item of
fewer words, but not none, is one window.  Every document word inside an occurrence of
a window is hit.  The automaton's letters are words: a window is a sequence of word
numbers, so that words meet whole, and a text is scanned once, whatever the number of
windows.  Normalising keeps the place of every byte, so hits are given as spans of the
original text.

Windows are made by Spark, and their number is known before any leaves it: the driver
takes at most `BLOCK_BYTES` of them at once and hands them to the tasks.  A benchmark
with more is dealt into blocks by a hash of window and item; every block then passes
over all texts, which keep what former blocks found, so nothing is left out.

Defined results: a null text or item has no words.  Rows that repeat an item id are one
item with the windows of all of them; the windows of a null item id mark words, but name
no item.  Repeated documents have rows of their own.  Very long texts are scanned in
parts of two megabytes, between which the automaton keeps its state.  Kept columns named
like an output column are replaced; empty tables give no rows or no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import binary, cuts, map_texts, release, remove, slices, stored_at, text_batches

WINDOW = 10
#: Bytes of distinct windows (a window of each item counts) in one automaton.
BLOCK_BYTES = 8 << 20

#: What a byte becomes: letters in lower case, digits and bytes above 127 as they are, others a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """The windows of an item's words, their words joined by spaces."""
    if not words:
        return set()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


class Automaton:
    """Aho-Corasick over numbered words; `windows` and their items lie side by side."""

    def __init__(self, patterns: list[bytes], items: list[list[int]]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.sizes = np.zeros(len(patterns), np.int64)
        self.items = [np.array(x, np.int64) for x in items]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, pattern in enumerate(patterns):
            words = pattern.split(b" ")
            self.sizes[k] = len(words)
            self.machine.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), k)
        if patterns:
            self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """(words of the text, first and last word of every occurrence, windows found)."""
        count, ends, found, search = 0, [], [], None
        number = self.numbers.get
        for part in cuts(text.translate(NORMAL)):
            words = part.split()
            count += len(words)
            if not len(self.sizes):
                continue
            sequence = tuple([number(w, 0) for w in words])
            if search is None:
                search = self.machine.iter(sequence)
            else:
                search.set(sequence)
            for end, k in search:
                ends.append(end)
                found.append(k)
        which = np.array(found, np.int64)
        last = np.array(ends, np.int64)
        return count, np.column_stack([last - self.sizes[which] + 1, last]) if len(which) else np.zeros((0, 2), np.int64), np.unique(which)

    def named(self, found: np.ndarray) -> np.ndarray:
        """The items of windows."""
        return np.unique(np.concatenate([self.items[k] for k in found.tolist()])) if len(found) else np.zeros(0, np.int64)


def united(spans: np.ndarray) -> np.ndarray:
    """Spans (first, last) joined where they meet or touch."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    starts = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1] + 1])
    return np.column_stack([spans[starts, 0], np.r_[reach[starts[1:] - 1], reach[-1]]])


def places(text: bytes, spans: np.ndarray) -> list[dict[str, int]]:
    """Spans of words as spans of code points of the original text, end exclusive."""
    if not len(spans):
        return []
    raw = np.frombuffer(text.translate(NORMAL), np.uint8)
    inside = np.r_[False, raw != 32, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # bytes that begin a code point
    chars = np.r_[0, np.cumsum(begins)]
    starts, ends = chars[edges[0::2][spans[:, 0]]], chars[edges[1::2][spans[:, 1]]]
    return [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


_KNOWN: dict[str, Automaton] = {}


def _automaton(key: str, block: Broadcast) -> Automaton:
    """This worker's automaton of a block; it keeps one at a time."""
    if key not in _KNOWN:
        _KNOWN.clear()
        patterns, items = block.value
        _KNOWN[key] = Automaton(patterns, items)
    return _KNOWN[key]


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, item): the distinct windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for item, raw in zip(part.column("item").to_pylist(), binary(part.column("text")), strict=True):
                    found = sorted(windows(raw.translate(NORMAL).split(), size))
                    for at in range(0, len(found), 10_000):
                        own = found[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([item] * len(own), pa.int64())], names=["window", "item"])
        release()

    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text"))
    return text_batches(rows).mapInArrow(run, "window binary, item long").distinct()


def _scanned(df: DataFrame, key: str, block: Broadcast, text: str, keep: list[str], before: str | None) -> DataFrame:
    """Adds `FOUND`; with `before`, a column of a former block's `FOUND`, joined with that."""

    def make():
        automaton = _automaton(key, block)

        def work(raw, batch):
            old = batch.column(before).to_pylist() if before else [None] * len(raw)
            out: dict[str, list] = {f: [] for f in FOUND.names}
            for x, known in zip(raw, old, strict=True):
                n, spans, found = automaton.scan(x)
                items = automaton.named(found)
                if known:
                    spans = np.concatenate([spans, np.array([[s["start"], s["end"]] for s in known["spans"]], np.int64).reshape(-1, 2)])
                    items = np.union1d(items, np.array(known["items"], np.int64))
                spans = united(spans)
                out["n_words"].append(n)
                out["n_hit"].append(int((spans[:, 1] - spans[:, 0] + 1).sum()))
                out["items"].append(items.tolist())
                out["spans"].append([{"start": a, "end": b} for a, b in spans.tolist()])
            return out

        return work

    return map_texts(df, make, FOUND, text, keep)


def _located(df: DataFrame, text: str, keep: list[str], found: str) -> DataFrame:
    """`found`, whose spans of words become spans of code points."""

    def make():
        def work(raw, batch):
            out: dict[str, list] = {f: [] for f in FOUND.names}
            for x, known in zip(raw, batch.column(found).to_pylist(), strict=True):
                known["spans"] = places(x, np.array([[s["start"], s["end"]] for s in known["spans"]], np.int64).reshape(-1, 2))
                for f in FOUND.names:
                    out[f].append(known[f])
            return out

        return work

    return map_texts(df, make, FOUND, text, keep)


def scan(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    locate: bool = True,
) -> DataFrame:
    """Adds n_words, n_hit, items (ids of items with occurring windows, in order) and
    spans: maximal runs of hit words, as code points of the text (with `locate`; else as
    numbers of words, the last included)."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in FOUND.names]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(0).alias("row"), F.col(f"`{text}`").alias("body"))
    pairs, path = stored_at(item_windows(items, item_id, item_text, size), "windows")
    total = pairs.agg(F.sum(F.length("window") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = F.pmod(F.xxhash64("window", "item"), F.lit(blocks))
    former = None
    for k in range(blocks):
        own = pairs.where(dealt == k).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()
        block = spark.sparkContext.broadcast(([bytes(r.window) for r in own], [list(r["items"]) for r in own]))
        found = _scanned(rows, uuid.uuid4().hex, block, "body", ["row", "body"] + (["found"] if k else []), "found" if k else None)
        rows = found.select("row", "body", F.struct(*FOUND.names).alias("found"))
        if k < blocks - 1:
            rows, now = stored_at(rows, f"scan-{k}")
            if former:
                remove(spark, former)
            former = now
    remove(spark, path)
    if locate:
        rows = _located(rows, "body", ["row", "found"], "found").select("row", F.struct(*FOUND.names).alias("found"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in keep], *[F.col("found").getField(c).alias(c) for c in FOUND.names])
