"""Bulk-synchronous best-fit packing of token sequences.

Every document becomes pieces of at most `capacity` tokens; only longer
documents are cut.  Then, in rounds, all pieces without a place and all open
sequences' gaps are swept in order of size: going down, each piece takes the
smallest gap not yet taken that holds it (its successor).  As larger pieces, then those
of lower rank, come first, no two want the same gap.  Placed pieces shrink their gaps,
and the next round begins.  When no piece finds a gap, the largest ones open new sequences, as many
as the tokens left need at least.

The range-sorted pieces and gaps are held run-length encoded: sizes are 1 to
`capacity`, so each round has at most `capacity` different sizes of each, whatever
the number of documents, and a sweep over runs matches all their members at once.
Since that is a few thousand numbers, the sweeps run on the driver over counts of
lengths; no piece, id or token gets there.  What they decide is a table of intervals
(some 6000 for 4 million pieces): of the pieces of length L, ranks a to b go to
sequences s to s + b - a at offset o.  The pieces' ranks within a length come from
salted counts on the executors, so a length that a third of all pieces share is still
dealt over many tasks, and every piece looks up its own interval.

Nulls: a null text is a document of the end id alone; a null id is kept.
Repeated rows are packed each; ties go by id, piece, then digest.  A very long text
is many pieces, encoded part by part.  Other columns are ignored, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SLICE_BYTES, binary, cut, release, slices, stored, text_batches
from quire.llm.words import CACHE_WORDS, encoder

CAPACITY = 2048
#: Parts that pieces of one length are dealt in at least, and pieces of a part.
SALTS = 256
SALT_ROWS = 1 << 18

Run = tuple[int, int]  # first, count


def sweep(pieces: dict[int, list[Run]], gaps: dict[int, list[Run]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """One round: (length, first rank, count, first sequence, offset) of the matches.

    pieces: rank runs by length; gaps: runs of sequences by free room.  Both lose
    what is matched; the gaps that remain of used ones are returned to `gaps`
    only after the sweep, as all matches of a round are made at once.
    """
    matches, left_over = [], defaultdict(list)
    sizes = sorted(gaps, reverse=True)
    stack: list[int] = []  # gaps that are large enough, the smallest on top
    at = 0
    for length in sorted(pieces, reverse=True):
        while at < len(sizes) and sizes[at] >= length:
            stack.append(sizes[at])
            at += 1
        own = pieces[length]
        while own and stack:
            room = stack[-1]
            first, count = own[-1]
            sequence, free = gaps[room][-1]
            n = min(count, free)
            matches.append((length, first, n, sequence, capacity - room))
            left_over[room - length].append((sequence, n))
            if n == count:
                own.pop()
            else:
                own[-1] = (first + n, count - n)
            if n == free:
                gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
                    stack.pop()
            else:
                gaps[room][-1] = (sequence + n, free - n)
        if not own:
            del pieces[length]
    for room, runs in left_over.items():
        if room:
            gaps.setdefault(room, []).extend(runs)
    return matches


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for counts[length] pieces of each length, and the number of sequences."""
    pieces: dict[int, list[Run]] = {n: [(0, c)] for n, c in counts.items() if c}
    gaps: dict[int, list[Run]] = {}
    placed: list[tuple[int, int, int, int, int]] = []
    used = 0
    while pieces:
        found = sweep(pieces, gaps, capacity)
        placed += found
        if found:
            continue
        heap = [-n for n in pieces]
        heapify(heap)
        left = sum(n * c for n, runs in pieces.items() for _, c in runs)
        need, opened = -(-left // capacity), 0
        while heap and (opened < need or -heap[0] * 2 > capacity):
            length = -heappop(heap)
            while pieces[length] and (opened < need or length * 2 > capacity):
                first, count = pieces[length].pop()
                n = count if length * 2 > capacity else min(count, need - opened)
                placed.append((length, first, n, used, 0))
                if length < capacity:
                    gaps.setdefault(capacity - length, []).append((used, n))
                used, opened = used + n, opened + n
                if n < count:
                    pieces[length].append((first + n, count - n))
            if not pieces[length]:
                del pieces[length]
    return placed, used


def pieces_of(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int, doc_id: str, text: str, by_words: bool, cache_words: int, forget: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    end = struct.pack("<I", end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        work = encoder(tokenizer_path, by_words, cache_words)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20 if forget else SLICE_BYTES):
                out: list[tuple] = []
                for d, ids in zip(part.column("doc_id").to_pylist(), work.ids(binary(part.column("text"))), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        raw = ids[a : a + 4 * capacity]
                        out.append((d, k, a // 4, len(raw) // 4, zlib.crc32(raw)))
                columns = zip(*out, strict=True)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        if forget:
            work.forget()
            release()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return text_batches(rows).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    by_words: bool = True,
    cache_words: int = CACHE_WORDS,
    forget: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    With `forget` a worker keeps no words between tasks and splits fewer at once, for
    what else it has to do.
    """
    found = stored(pieces_of(df, tokenizer_path, end_id, capacity, doc_id, text, by_words, cache_words, forget), "pieces")
    counts = {n: c for n, c in found.groupBy("length").count().collect()}  # at most `capacity` rows
    salts = max(SALTS, -(-max(counts.values(), default=0) // SALT_ROWS))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    local = salted.selectExpr("*", "row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, piece, ids_crc32) - 1 AS local")
    runs = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), sum(counts.values()))
    placed, _ = plan(counts, capacity)
    placed.sort()
    keys = np.array([n << 44 | first for n, first, *_ in placed], np.int64)
    firsts, sequences, offsets = (np.array([p[k] for p in placed], np.int64) for k in (1, 3, 4))
    shared = df.sparkSession.sparkContext.broadcast((keys, firsts, sequences, offsets))
    before = runs.selectExpr("length", "salt", "sum(n) OVER (PARTITION BY length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    ranked = local.join(before, ["length", "salt"]).selectExpr(
        "doc_id", "piece", "start", "length", "ids_crc32", "local + coalesce(before, 0) AS rank"
    )

    def run(batches):
        keys, firsts, sequences, offsets = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
