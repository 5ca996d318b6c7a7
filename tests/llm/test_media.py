import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest

from quire.llm import media, queries


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04xyDATA\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
OGG = b"OggS\x00\x04" + bytes(20) + b"\x01\x03abc"
FLAC = b"fLaC\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8"
ITEMS = {"png": PNG, "gif": GIF, "jpeg": JPEG, "bmp": BMP, "pdf": PDF, "zip": zipped(), "gzip": gzip.compress(b"data " * 99), "ogg": OGG, "wav": media.store(b"hello")}


@pytest.mark.parametrize("kind", sorted(ITEMS))
def test_types_and_carving(kind):
    item = ITEMS[kind]
    assert media.sniff(item)[0] == kind
    assert media.sniff(item[:-2] if kind != "gzip" else item[:-9])[0] == "unknown"
    stored = media.store(b"text before " + item + b" and after")
    assert media.sniff(stored) == ("wav", [(44 + 12, kind, item)])
    assert media.sniff(b"xx" + item + PNG) == ("unknown", [(2, kind, item), (2 + len(item), "png", PNG)])


def test_flac():
    assert media.sniff(FLAC)[0] == "flac"


@pytest.mark.parametrize("text", [b"RIFF WAVEfmt BM %PDF- PK\x03\x04 GIF89a", b"", b"\x89PNG\r\n\x1a\n" * 3, b"%PDF-" * 2000])
def test_false_signatures(text):
    assert media.sniff(media.store(text)) == ("wav", [])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_store_and_load(n):
    raw = bytes(k % 251 for k in range(n))
    payload = media.load(media.store(raw))
    assert payload == raw + bytes(max(64, -(-n // 64) * 64) - n)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    features = {}
    for r in queries.op10_media_columns(spark, sf_dir).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(media.store(raw)).hexdigest()
        assert features.setdefault(raw, r.feature) == r.feature


def test_odd_documents(odd_docs, odd_texts, no_docs):
    got = media.read_media(media.store_media(odd_docs)).collect()
    assert len(got) == len(odd_texts) + 1 and {r.media_type for r in got} == {"wav"}
    assert got[0].feature == got[1].feature and got[0].n_bytes == 0 and got[0].payload_bytes == 64
    assert media.read_media(media.store_media(no_docs)).count() == 0


def test_wrong_declared_type(spark):
    df = spark.createDataFrame([(1, bytearray(PNG)), (2, bytearray(b"junk")), (3, None)], "id int, media binary")
    assert [r.media_type for r in media.read_media(df).collect()] == ["png", "unknown", "unknown"]


def test_declared_types_are_checked(spark):
    rows = [(1, bytearray(PNG), "image/png"), (2, bytearray(PNG), "audio/wav"), (3, bytearray(media.store(b"x")), "audio/wav"), (4, bytearray(b"junk"), None)]
    got = media.read_media(spark.createDataFrame(rows, "id int, media binary, declared_type string")).collect()
    assert [(r.media_type, r.type_corrected) for r in got] == [("png", False), ("png", True), ("wav", False), ("unknown", True)]


@pytest.mark.parametrize("mark", [b"%PDF-", b"%PDF-startxref", b"PK\x03\x04", b"\xff\xd8\xff\xda\x00\x02", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03"])
def test_many_signatures_without_an_end_take_no_longer(mark):
    data = mark * (4_000_000 // len(mark))
    began = time.perf_counter()
    assert media.sniff(data)[1] == []
    assert time.perf_counter() - began < 20


OGG_PAGE = b"OggS\x00\x00" + bytes(20) + b"\x00"
GIF_HEAD = b"GIF89a\x01\x00\x01\x00\x00\x00\x00"
CHUNK = b"JUNK\x00\x00\x00\x00"


@pytest.mark.parametrize(
    "mark",
    [
        OGG_PAGE,
        OGG_PAGE[:-1] + b"\x01\x01x",
        GIF_HEAD + b"!\x01\x01\x01",
        GIF_HEAD + b"!\x01" + b"\x01\x01" * 40,
        GIF_HEAD + b"!\x01\x01x\x00" * 3,
        b"RIFF\x00\x00\x10\x00WAVEfmt \x00\x00\x00\x00" + CHUNK * 4,
        b"RIFF\x00\x00\x20\x00WAVEfmt \x10\x00\x00\x00" + bytes(8),
    ],
)
def test_chains_without_an_end_take_no_longer(mark):
    data = mark * (4_000_000 // len(mark))
    data.decode()  # a text may hold it
    began = time.perf_counter()
    media.sniff(media.store(data))
    assert time.perf_counter() - began < 20


def plain_wav(data, at):
    size = struct.unpack_from("<I", data, at + 4)[0] + 8 if data[at : at + 4] == b"RIFF" and len(data) >= at + 44 else 0
    if not size or at + size > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return 0
    here, found = at + 12, set()
    while here + 8 <= at + size:
        name, n = data[here : here + 4], struct.unpack_from("<I", data, here + 4)[0]
        if here + 8 + n > at + size:
            return 0
        found.add(name)
        here += 8 + n + n % 2
    return size if {b"fmt ", b"data"} <= found and here >= at + size else 0


def plain_ogg(data, at):
    here = at
    while data[here : here + 5] == b"OggS\x00" and here + 27 <= len(data):
        n, last = data[here + 26], data[here + 5] & 4
        here += 27 + n + sum(data[here + 27 : here + 27 + n])
        if here > len(data):
            return 0
        if last:
            return here - at
    return 0


def plain_gif(data, at):
    here = at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 0x80 else 0) if len(data) >= at + 14 else len(data)
    while here < len(data):
        if data[here] == 0x3B:
            return here + 1 - at
        if data[here] == 0x21:
            here += 2
        elif data[here] == 0x2C and here + 10 < len(data):
            here += 11 + (3 << ((data[here + 9] & 7) + 1) if data[here + 9] & 0x80 else 0)
        else:
            return 0
        while here < len(data) and data[here]:
            here += 1 + data[here]
        here += 1
        if here > len(data):
            return 0
    return 0


def test_lengths_equal_plain_walks():
    import random

    pick = random.Random(11)
    pieces = {
        "ogg": [OGG_PAGE, b"OggS\x00\x04" + bytes(20) + b"\x01\x03abc", b"OggS\x00\x00" + bytes(20) + b"\x02\x1b\x05", b"x" * 5, b"OggS"],
        "gif": [GIF_HEAD, GIF, b"!\x01\x02ab\x00", b"!\x01\x01", b";", b",\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00", b"\x03", b"GIF89a\x01\x00\x01\x00\x80\x00\x00"],
        "wav": [media.store(b"hello")[:44], b"fmt \x02\x00\x00\x00ab", b"data\x03\x00\x00\x00abc\x00", CHUNK, b"data\x01\x00\x00\x00", b"y", bytes(4)]
        + [b"RIFF" + struct.pack("<I", n) + b"WAVE" for n in (36, 40, 47, 52, 55, 60, 75, 90, 120)],
    }
    plain, some = {"ogg": plain_ogg, "gif": plain_gif, "wav": plain_wav}, dict.fromkeys(pieces, 0)
    for _ in range(4000):
        kind = pick.choice(list(pieces))
        data = b"".join(pick.choice(pieces[kind]) for _ in range(pick.randrange(1, 14)))
        marks, starts = media.Marks({}), [k for k in range(len(data)) if data[k : k + 4] in (b"OggS", b"GIF8", b"RIFF")]
        pick.shuffle(starts)
        for at in starts:
            want = plain[kind](data, at)
            assert media.VALIDATORS[kind](data, at, marks) == want, (data, at)
            some[kind] += want > 0
    assert min(some.values()) > 50, some


def plain_feature(raw):
    """The feature of a stored text that holds no media, without numpy."""
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    bins = [sum(1 for b in payload if b // 32 == k) for k in range(8)]
    return f"wav n={len(payload)} sum={sum(payload)} peak={max(payload)} bins={','.join(map(str, bins))} inside="


def test_features_are_those_of_a_plain_version(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op10_media_columns(spark, sf_dir).collect():
        assert r.feature == plain_feature(texts[r.doc_id]) and not r.type_corrected
