"""Media columns: bytes as lossless 8-bit samples, recognised by their signatures.

`sniff` finds every signature of a byte string in one Aho-Corasick pass; a
signature counts only if its format's validator finds the structure and the
lengths that the header declares.  The longest valid item at offset 0 gives the
type, whatever type was declared; valid items at other offsets are embedded
media, which are cut out (an item inside an embedded one is not cut out again).

Payloads are stored as 8-bit mono WAV: RIFF header, one `fmt ` and one `data`
chunk.  A payload is the input padded with zero bytes to a multiple of 64 that
is at least 64.

Null input is empty; so is the result of nothing: a 64-byte payload of zeros.
Texts of any length are one item; ends of items are looked up among marks of the
same pass, and where a chain of pages, blocks or chunks ends is found once for each of
its places, so that many signatures without an end cost no more than their bytes.
Equal inputs, and so repeated rows, give equal results; of other columns only the
declared type is used, to say whether it is right.  Columns that are kept and named
like an output column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import map_texts

RATE = 8000
UNIT = 64

#: Signatures of formats, and how far before them an item begins.
SIGNATURES = {
    "wav": (b"WAVEfmt ", 8),
    "png": (b"\x89PNG\r\n\x1a\n", 0),
    "gif": (b"GIF87a", 0),
    "gif ": (b"GIF89a", 0),
    "jpeg": (b"\xff\xd8\xff", 0),
    "bmp": (b"\x28\x00\x00\x00", 14),
    "pdf": (b"%PDF-", 0),
    "zip": (b"PK\x03\x04", 0),
    "gzip": (b"\x1f\x8b\x08", 0),
    "flac": (b"fLaC", 0),
    "ogg": (b"OggS\x00", 0),
}

#: What ends an item, or has to stand in it.
ENDS = {"pdf end": b"%%EOF", "pdf table": b"startxref", "zip end": b"PK\x05\x06", "jpeg end": b"\xff\xd9"}


class Marks:
    """Places of the marks of `ENDS`, found in the same pass as the signatures."""

    def __init__(self, places: dict[str, list[int]]):
        self.places = places

        self.asked, self.found = 0, -2  # the last question for a zero byte, and its answer
        self.pages: dict[int, int] = {}  # ends of chains of Ogg pages, by each page's place
        self.chunks: dict[int, tuple[int, int, int, int, int]] = {}  # RIFF chunks, see `chunk_chain`
        self.tables: dict[str, array] = {}

    def table(self, name: str, data: bytes) -> array:
        """A number for every place, 0 at first; made when it is first asked for."""
        if name not in self.tables:
            self.tables[name] = array("q", [0]) * (len(data) + 2)
        return self.tables[name]

    def zero(self, data: bytes, at: int) -> int:
        """The first zero byte at or behind a place, or -1."""
        if self.found == -2 or at < self.asked or 0 <= self.found < at:
            self.asked, self.found = at, data.find(b"\0", at)
        return self.found

    def next(self, name: str, at: int) -> int:
        """The first mark at or behind a place, or -1."""
        found = self.places.get(name, ())
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1


def chunk_chain(data: bytes, at: int, chunks: dict[int, tuple[int, int, int, int, int]]) -> None:
    """Makes the chunks from a place on known: (next, jump, depth, data chunks, fmt chunks).

    Where a chunk ends the next begins, whatever item both belong to, so chunks are a
    forest; counts and depths are those up to its root, a place without a whole chunk
    (which is its own next), and a jump passes over many (Myers, 1983).
    """
    path, here = [], at
    while here not in chunks:
        n = struct.unpack_from("<I", data, here + 4)[0] if here + 8 <= len(data) else len(data)
        if here + 8 + n > len(data):
            chunks[here] = (here, here, 0, 0, 0)
            break
        path.append(here)
        here += 8 + n + n % 2
    for p in reversed(path):
        _, jump, depth, datas, fmts = chunks[here]
        far = chunks[jump]
        to = far[1] if depth - far[2] == far[2] - chunks[far[1]][2] else here
        name = data[p : p + 4]
        chunks[p] = (here, to, depth + 1, datas + (name == b"data"), fmts + (name == b"fmt "))
        here = p


def wav_length(data: bytes, at: int, marks: Marks) -> int:
    """A whole RIFF/WAVE item's length at `at`, or 0."""
    if data[at : at + 4] != b"RIFF" or len(data) < at + 44:
        return 0
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    end, first, chunks = at + size, at + 12, marks.chunks
    if end > len(data) or data[at + 8 : at + 12] != b"WAVE" or first >= end:
        return 0
    chunk_chain(data, first, chunks)
    last = first  # the last chunk that begins before the end
    while chunks[last][2] and chunks[last][0] < end:
        last = chunks[last][1] if chunks[last][1] < end else chunks[last][0]
    if not chunks[last][2] or last + 8 + struct.unpack_from("<I", data, last + 4)[0] > end:
        return 0
    behind = chunks[chunks[last][0]]
    return size if chunks[first][3] > behind[3] and chunks[first][4] > behind[4] else 0


def png_length(data: bytes, at: int, marks: Marks) -> int:
    here, first = at + 8, True
    while here + 12 <= len(data):
        n, name = struct.unpack_from(">I", data, here)[0], data[here + 4 : here + 8]
        if here + 12 + n > len(data) or first and (name != b"IHDR" or n != 13):
            return 0
        if zlib.crc32(data[here + 4 : here + 8 + n]) != struct.unpack_from(">I", data, here + 8 + n)[0]:
            return 0
        here, first = here + 12 + n, False
        if name == b"IEND":
            return here - at
    return 0


def gif_length(data: bytes, at: int, marks: Marks) -> int:
    """Blocks and sub-blocks follow from their places alone, so where a chain of them ends
    (-1: nowhere) is found once for each place."""
    if len(data) < at + 14:
        return 0
    ends, inner = marks.table("gif", data), marks.table("gif inner", data)

    def behind(here: int) -> int:
        """The place behind sub-blocks, or -1."""
        path = []
        while here < len(data) and data[here] and not inner[here]:
            path.append(here)
            here += 1 + data[here]
        end = -1 if here >= len(data) else inner[here] or here + 1
        for p in path:
            inner[p] = end
        return end

    flags, here = data[at + 10], at + 13
    here += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    path, end = [], -1
    while 0 <= here < len(data):
        if ends[here]:
            end = ends[here]
            break
        path.append(here)
        if data[here] == 0x3B:
            end = here + 1
            break
        if data[here] == 0x21:
            here = behind(here + 2)
        elif data[here] == 0x2C and here + 10 < len(data):
            local = data[here + 9]
            here = behind(here + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            break
    for p in path:
        ends[p] = end
    return max(0, end - at)


def jpeg_length(data: bytes, at: int, marks: Marks) -> int:
    here = at + 2
    while here + 4 <= len(data) and data[here] == 0xFF:
        kind = data[here + 1]
        if kind == 0xD9:
            return here + 2 - at
        n = struct.unpack_from(">H", data, here + 2)[0]
        if n < 2 or here + 2 + n > len(data):
            return 0
        here += 2 + n
        if kind == 0xDA:
            end = marks.next("jpeg end", here)
            return end + 2 - at if end >= 0 else 0
    return 0


def bmp_length(data: bytes, at: int, marks: Marks) -> int:
    if at < 0 or data[at : at + 2] != b"BM" or len(data) < at + 54:
        return 0
    size, _, first, _, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    return size if planes == 1 and bits in (1, 4, 8, 16, 24, 32) and at + size <= len(data) and first + row * abs(height) <= size else 0


def pdf_length(data: bytes, at: int, marks: Marks) -> int:
    end = marks.next("pdf end", at)
    return end + 5 - at if end >= 0 and 0 <= marks.next("pdf table", at) < end else 0


def zip_length(data: bytes, at: int, marks: Marks) -> int:
    here = marks.next("zip end", at)
    if here < 0 or len(data) < here + 22:
        return 0
    size, first, note = struct.unpack_from("<IIH", data, here + 12)
    end = here + 22 + note
    return end - at if at + first + size == here and end <= len(data) else 0


def gzip_length(data: bytes, at: int, marks: Marks) -> int:
    if len(data) < at + 18 or data[at + 3] & 0xE0:
        return 0
    flags, here = data[at + 3], at + 10
    if flags & 4:
        here += 2 + struct.unpack_from("<H", data, here)[0]
    for flag in (8, 16):  # name and comment end with a zero byte
        if flags & flag and not (here := marks.zero(data, here) + 1):
            return 0
    here += flags & 2
    if here >= len(data) or data[here] & 6 == 6:
        return 0
    work, view, crc, size = zlib.decompressobj(-15), memoryview(data), 0, 0
    try:
        while here < len(data) and not work.eof:  # in small steps, as most signatures fail early
            rest = view[here : here + 4096]
            here += len(rest)
            while rest and not work.eof:
                out = work.decompress(rest, 1 << 20)
                crc, size, rest = zlib.crc32(out, crc), size + len(out), work.unconsumed_tail
    except zlib.error:
        return 0
    end = here - len(work.unused_data) + 8
    return end - at if work.eof and end <= len(data) and struct.unpack_from("<II", data, end - 8) == (crc, size % 2**32) else 0


def flac_length(data: bytes, at: int, marks: Marks) -> int:
    here, first = at + 4, True
    while here + 4 <= len(data):
        head, n = data[here], int.from_bytes(data[here + 1 : here + 4], "big")
        if first and (head & 0x7F or n != 34) or here + 4 + n > len(data):
            return 0
        here, first = here + 4 + n, False
        if head & 0x80:
            return len(data) - at if data[here : here + 1] == b"\xff" else 0
    return 0


def ogg_length(data: bytes, at: int, marks: Marks) -> int:
    """Pages up to the last one of a stream; where a chain ends (0: nowhere) is found once
    for each of its pages."""
    path, here, end = [], at, 0
    while data[here : here + 5] == b"OggS\x00" and here + 27 <= len(data):
        if here in marks.pages:
            end = marks.pages[here]
            break
        path.append(here)
        n = data[here + 26]
        here, last = here + 27 + n + sum(data[here + 27 : here + 27 + n]), data[here + 5] & 4
        if here > len(data):
            break
        if last:
            end = here
            break
    for p in path:
        marks.pages[p] = end
    return max(0, end - at)


VALIDATORS = {
    "wav": wav_length,
    "png": png_length,
    "gif": gif_length,
    "jpeg": jpeg_length,
    "bmp": bmp_length,
    "pdf": pdf_length,
    "zip": zip_length,
    "gzip": gzip_length,
    "flac": flac_length,
    "ogg": ogg_length,
}

_AUTOMATON = None


def automaton():
    """All signatures, as text of code points below 256."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for name, (magic, back) in SIGNATURES.items():
            _AUTOMATON.add_word(magic.decode("latin-1"), (name.strip(), len(magic) - 1 + back))
        for name, mark in ENDS.items():
            _AUTOMATON.add_word(mark.decode("latin-1"), (name, len(mark) - 1))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def hits(data: bytes) -> tuple[list[tuple[int, str]], Marks]:
    """Offsets at which an item of a type would begin, by its signature, and the
    marks that validators ask for; one pass."""
    found, marks = set(), {name: [] for name in ENDS}
    for at, (name, back) in automaton().iter(data.decode("latin-1")):
        if name in marks:
            marks[name].append(at - back)
        elif at >= back:
            found.add((at - back, name))
    return sorted(found), Marks(marks)


def valid(data: bytes, found: list[tuple[int, str]], marks: Marks, end: int = 0) -> list[tuple[int, str, int]]:
    """(offset, type, length) of the valid items from `end` on that no other one holds."""
    items = []
    for at, name in found:
        if at >= end and (n := VALIDATORS[name](data, at, marks)):
            items.append((at, name, n))
            end = at + n
    return items


def sniff(data: bytes) -> tuple[str, list[tuple[int, str, bytes]]]:
    """The real type of some bytes (`unknown` if no item begins them) and the media
    embedded in them: items behind the first, and those among a WAV's samples."""
    found, marks = hits(data)
    items = valid(data, found, marks)
    if not items or items[0][0]:
        kind, inner = "unknown", items
    else:
        kind, inner = items[0][1], items[1:]
        if kind == "wav":
            size = items[0][2]
            inner = [x for x in valid(data, found, marks, 1) if x[0] + x[2] <= size] + [x for x in inner if x[0] >= size]
    return kind, [(at, name, data[at : at + n]) for at, name, n in inner]


def store(raw: bytes) -> bytes:
    """The stored form of some bytes."""
    payload = raw + bytes(-len(raw) % UNIT if raw else UNIT)
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def load(media: bytes) -> bytes:
    """The samples of a stored form, from the data chunk that its header locates."""
    if not wav_length(media, 0, Marks({})):
        raise ValueError("not a whole WAV item")
    here = 12
    while True:
        name, n = media[here : here + 4], struct.unpack_from("<I", media, here + 4)[0]
        if name == b"data":
            return media[here + 8 : here + 8 + n]
        here += 8 + n + n % 2


def feature(kind: str, payload: bytes, inside: list[tuple[int, str, bytes]]) -> str:
    """Type, samples, mean, peak, bins of a coarse histogram, and embedded items."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values = np.arange(256)
    bins = counts.reshape(8, 32).sum(axis=1)
    return f"{kind} n={len(payload)} sum={int(counts @ values)} peak={int(values[counts > 0].max())} bins={','.join(map(str, bins.tolist()))} inside={','.join(f'{k}@{a}+{len(b)}' for a, k, b in inside)}"


#: Media types.
TYPES = {"wav": "audio/wav", "flac": "audio/flac", "ogg": "application/ogg", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip"}
IMAGES = frozenset("png gif jpeg bmp".split())

STORED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("declared_type", T.StringType())])
READ = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("type_corrected", T.BooleanType()),
        T.StructField("embedded", T.IntegerType()),
        T.StructField("feature", T.StringType()),
    ]
)


def store_media(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, media (the stored form of the column's bytes) and declared_type."""

    def make():
        def work(raw, _):
            return {"n_bytes": [len(x) for x in raw], "media": [store(x) for x in raw], "declared_type": ["audio/wav"] * len(raw)}

        return work

    return map_texts(df, make, STORED, text, keep)


def mime(kind: str) -> str:
    return TYPES.get(kind, f"image/{kind}" if kind in IMAGES else "application/octet-stream")


def read_media(df: DataFrame, media: str = "media", keep: list[str] | None = None, declared: str | None = "declared_type") -> DataFrame:
    """Reads stored media back and adds their digests, real type and features.

    What isn't a whole WAV item is taken as its own payload; media_type is then
    what the signatures say, or `unknown`.  `type_corrected` says that the type in
    the column `declared` (if the input has it) is not that of the bytes.
    """
    declared = declared if declared in df.columns else None

    def one(x: bytes, said: str | None) -> tuple:
        kind, inside = sniff(x)
        payload = load(x) if kind == "wav" else x
        return (
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-UNIT:]),
            len(x),
            hashlib.sha256(x).hexdigest(),
            kind,
            declared is not None and said != mime(kind),
            len(inside),
            feature(kind, payload or b"\0", inside),
        )

    def make():
        def work(raw, batch):
            said = batch.column("__declared").to_pylist() if declared else [None] * len(raw)
            return dict(zip(READ.names, zip(*map(one, raw, said), strict=True), strict=True)) if raw else {k: [] for k in READ.names}

        return work

    if not declared:
        return map_texts(df, make, READ, media, keep)
    keep = df.columns if keep is None else keep
    found = map_texts(df.withColumn("__declared", F.col(f"`{declared}`")), make, READ, media, [*keep, "__declared"])
    return found.drop("__declared")
