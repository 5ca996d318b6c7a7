"""Token-id files: Simple-8b words in blocks.

A 64-bit word has a selector in its low 4 bits; it says how many ids of how many
bits fill the other 60.  An id that needs more than 60 bits (or equals the
escape) is an escape word followed by the id as a raw word.

A block holds whole documents and at least `BLOCK_IDS` ids, but for a
partition's last one.  All its numbers are little-endian:

    4 bytes  S8B1
    u32      documents          u64  ids          u32  words     u32  marks
    u8[]     1 where a document's id is null
    i64[]    document ids       u64[] ids of each document
    u64[]    ids before every MARK_WORDS-th word, so that a reader can start
             there and a range of words decodes as one array
    u64[]    words

Blocks are rows (file_no, block_no, start, n_ids, data) of a Parquet table, in
ascending order of document id over files and blocks; a file is a partition.
`start` counts the ids of the file's earlier blocks.

Nulls: a null text has no ids but the end id; a null document id sorts first and
comes back as null.  Repeated rows are documents of their own, ordered by the
hash of their text.  A very long text is encoded part by part and stays in one block.
An empty table gives no blocks.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import binary, shared_dir, slices, text_batches
from quire.llm.words import encoder

BLOCK_IDS = 1 << 16
MARK_WORDS = 256
#: Fixed values of the format: ids and bits of each selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 60) - 1
ESCAPE_WORD = np.uint64((ESCAPE << 4) | 15)

_SMALL_WIDTHS = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id takes; 61 for one that must be escaped."""
    if not len(ids) or ids.max() < len(_SMALL_WIDTHS):
        return _SMALL_WIDTHS[ids]
    found = np.zeros(len(ids), np.uint8)
    for k in range(60):
        found += ids >= np.uint64(1 << k)
    found[ids >= np.uint64(ESCAPE)] = 61
    return found


def selectors(width: np.ndarray) -> np.ndarray:
    """For each place the selector that takes most ids from there on."""
    n = len(width)
    best = np.full(n, 15, np.uint8)
    window, length = width, 1
    for sel in range(14, -1, -1):
        count, bits = int(COUNTS[sel]), BITS[sel]
        if count > n:
            break
        while length < count:
            step = min(length, count - length)
            window = np.maximum(window[: len(window) - step], window[step:])
            length += step
        fits = window <= bits
        if not fits.any():  # nor will a longer window with fewer bits
            break
        np.copyto(best[: len(fits)], np.uint8(sel), where=fits)
    return best


def encode(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64)
    width = widths(ids)
    best = selectors(width)
    steps, at, n, places = COUNTS[best].tolist(), 0, len(ids), []
    add = places.append
    while at < n:
        add(at)
        at += steps[at]
    places = np.array(places)
    chosen = best[places]
    escaped = width[places] == 61
    words = chosen.astype(np.uint64)
    for sel in np.unique(chosen):
        mine = np.flatnonzero(chosen == sel)
        bits, first = int(BITS[sel]), places[mine]
        if not bits:
            continue
        if sel == 15:
            words[mine] |= np.where(escaped[mine], np.uint64(ESCAPE), ids[first]) << np.uint64(4)
            continue
        packed = np.zeros(len(mine), np.uint64)
        for k in range(int(COUNTS[sel])):
            packed |= ids[first + k] << np.uint64(4 + k * bits)
        words[mine] |= packed
    if not escaped.any():
        return words
    at = np.flatnonzero(escaped)
    return np.insert(words, at + 1, ids[places[at]])


def raw_words(words: np.ndarray) -> np.ndarray:
    """Places of the raw words: those after an escape that is no raw word itself."""
    raw = []
    for at in np.flatnonzero(words == ESCAPE_WORD):
        if not raw or raw[-1] != at:
            raw.append(at + 1)
    return np.array(raw, np.int64)


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words."""
    words = np.asarray(words, np.uint64)
    raw = raw_words(words)
    sel = (words & np.uint64(15)).astype(np.uint8)
    counts = COUNTS[sel]
    counts[raw] = 0
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    lone = np.zeros(len(words), bool)
    lone[raw] = True
    for s in np.unique(sel):
        bits, count = int(BITS[s]), int(COUNTS[s])
        mine = np.flatnonzero((sel == s) & ~lone)
        if not bits:
            continue
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[starts[mine] + k] = (words[mine] >> np.uint64(4 + k * bits)) & mask
    out[starts[raw - 1]] = words[raw]
    return out


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words = encode(ids)
    counts = COUNTS[(words & np.uint64(15)).astype(np.uint8)]
    counts[raw_words(words)] = 0
    marks = (np.cumsum(counts) - counts)[::MARK_WORDS].astype("<u8")
    return b"".join(
        [
            b"S8B1",
            struct.pack("<IQII", len(doc_ids), len(ids), len(words), len(marks)),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array(lengths, "<u8").tobytes(),
            marks.tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def unpack_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids of a block."""
    if data[:4] != b"S8B1":
        raise ValueError("not a token block")
    docs, n, n_words, n_marks = struct.unpack_from("<IQII", data, 4)
    at = 24
    nulls = np.frombuffer(data, np.uint8, docs, at)
    doc_ids = np.frombuffer(data, "<i8", docs, at := at + docs)
    lengths = np.frombuffer(data, "<u8", docs, at := at + 8 * docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, at := at + 8 * docs + 8 * n_marks)
    ids = decode(words)
    if len(ids) != n or lengths.sum() != n or at + 8 * n_words != len(data):
        raise ValueError("token block with wrong lengths")
    return [None if x else int(i) for x, i in zip(nulls, doc_ids, strict=True)], lengths, ids


def read_ids(data: bytes, start: int, count: int) -> np.ndarray:
    """`count` ids of a block from `start` on, decoding only the words between marks."""
    docs, n, n_words, n_marks = struct.unpack_from("<IQII", data, 4)
    at = 24 + 17 * docs
    marks = np.frombuffer(data, "<u8", n_marks, at).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * n_marks)
    stop = min(start + count, n)
    if stop <= start:
        return np.zeros(0, np.uint64)
    first = max(0, int(np.searchsorted(marks, start, "right")) - 1)
    last = int(np.searchsorted(marks, stop, "left"))
    lo, hi = first * MARK_WORDS, min(n_words, last * MARK_WORDS)
    if lo and raw_words(words[: lo + 1])[-1:].tolist() == [lo]:  # a mark may fall on a raw word
        lo -= 1
        base = int(marks[first]) - 1
    else:
        base = int(marks[first])
    while hi < n_words and words[hi - 1] == ESCAPE_WORD:
        hi += 1
    return decode(words[lo:hi])[start - base : stop - base]


def write_token_files(
    df: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", by_words: bool = True, to: str | None = None
) -> str:
    """Encodes all texts, adds `end_id` to each, and writes blocks; gives the table's path.

    The texts are dealt by ranges of (document id, hash of the text), so a
    document id that repeats without end still spreads over tasks; sorting
    within a range spills.  A task holds one block at a time.
    """
    from pyspark import TaskContext

    to = to or f"{shared_dir(df.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, file_no = encoder(tokenizer_path, by_words), TaskContext.get().partitionId()
        docs: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        held = block_no = start = 0

        def block() -> pa.RecordBatch:
            nonlocal held, block_no, start
            data = pack_block(docs, lengths, np.frombuffer(b"".join(parts), "<u4").astype(np.uint64))
            row = pa.RecordBatch.from_pydict({"file_no": [file_no], "block_no": [block_no], "start": [start], "n_ids": [held], "data": [data]}, schema=arrow)
            start, block_no, held = start + held, block_no + 1, 0
            docs.clear(), lengths.clear(), parts.clear()
            return row

        arrow = pa.schema([("file_no", pa.int32()), ("block_no", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for part in slices(batch, "text"):
                for d, ids in zip(part.column("doc_id").to_pylist(), work.ids(binary(part.column("text"))), strict=True):
                    docs.append(d)
                    parts.append(ids + end)
                    lengths.append(len(ids) // 4 + 1)
                    held += lengths[-1]
                    if held >= BLOCK_IDS:
                        yield block()
        if docs:
            yield block()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    text_batches(rows).mapInArrow(run, "file_no int, block_no long, start long, n_ids long, data binary").write.option("compression", "none").parquet(to)
    return to


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token table: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before.  The driver gets one number
    per file (a task of the writer) to add up, no more.
    """
    blocks = spark.read.schema("file_no int, block_no long, start long, n_ids long, data binary").parquet(path)
    totals = sorted(blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n")).collect())
    before, total = {}, 0
    for file_no, n in totals:
        before[file_no] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, start, data in zip(batch.column("file_no").to_pylist(), batch.column("start").to_pylist(), batch.column("data").to_pylist(), strict=True):
                docs, lengths, ids = unpack_block(data)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(starts + start + before[file_no], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("file_no", "start", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
