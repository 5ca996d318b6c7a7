"""Page images in, Markdown and annotated images out."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.store import beside_pages

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
#: BGR colours of paragraph kinds, and of all others.
COLOURS = {"paragraph_title": (60, 20, 220), "text": (200, 30, 30), "formula": (0, 150, 0)}
OTHER = (180, 130, 70)
#: Rows of three bits of the letters that names of kinds have.
GLYPHS = {
    "a": "25755", "b": "65656", "c": "34443", "d": "65556", "e": "74647", "f": "74644", "g": "34553", "h": "55755", "i": "72227",
    "j": "11152", "k": "55655", "l": "44447", "m": "57755", "n": "65555", "o": "25552", "p": "65644", "q": "25563", "r": "65655",
    "s": "34216", "t": "72222", "u": "55557", "v": "55552", "w": "55775", "x": "55255", "y": "55222", "z": "71247", "_": "00007",
}


def read_pages(spark: SparkSession, path: str, page_id: str | None = None) -> DataFrame:
    """(page_id, image) of a folder of image files.

    page_id defaults to a hash of the file's path, alike in every run.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(F.expr(page_id or "xxhash64(image.origin)").alias("page_id"), "image")


def pages_from_arrays(spark: SparkSession, arrays: dict[int, np.ndarray]) -> DataFrame:
    """(page_id, image) of BGR arrays in memory."""
    rows = [(k, ("", a.shape[0], a.shape[1], a.shape[2], 16 if a.shape[2] == 3 else 0, a.tobytes())) for k, a in arrays.items()]
    return spark.createDataFrame(rows, f"page_id long, image {IMAGE}")


def image_array(image: dict) -> np.ndarray:
    """The BGR array of an image struct; one channel is repeated, a fourth dropped."""
    a = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]


def page_sizes(pages: DataFrame) -> DataFrame:
    """(page_id, page_w, page_h), without the pixels."""
    return pages.select("page_id", F.col("image.width").alias("page_w"), F.col("image.height").alias("page_h"))


def write_markdown(documents: DataFrame, path: str, per_page: bool = False) -> None:
    """The Markdown of every page with its page_id: a line of JSON each, or with
    `per_page` a text file each, in a folder page_id=... of its own."""
    rows = documents.select("page_id", "markdown")
    if per_page:
        rows.write.mode("overwrite").partitionBy("page_id").text(path)
    else:
        rows.write.mode("overwrite").json(path)


def read_markdown(spark: SparkSession, path: str, per_page: bool = False) -> DataFrame:
    """(page_id, markdown) of what `write_markdown` wrote."""
    if not per_page:
        return spark.read.schema("page_id long, markdown string").json(path)
    found = spark.read.schema("value string, page_id long").text(path, wholetext=True)
    return found.select("page_id", F.regexp_replace("value", "\n$", "").alias("markdown"))


def png(image: np.ndarray) -> bytes:
    """An RGB PNG of a BGR array."""
    h, w = image.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image[:, :, ::-1]).reshape(h, w * 3)], axis=1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def colour_of(kind: str) -> tuple[int, int, int]:
    return COLOURS.get(kind, OTHER)


def tag(kind: str) -> np.ndarray:
    """The name of a kind as a mask of pixels; a character without a glyph is blank."""
    rows = np.zeros((5, max(1, 4 * len(kind) - 1)), bool)
    for k, c in enumerate(kind):
        for y, bits in enumerate(GLYPHS.get(c, "00000")):
            rows[y, 4 * k : 4 * k + 3] = [int(bits) >> j & 1 for j in (2, 1, 0)]
    return rows.repeat(2, axis=0).repeat(2, axis=1)


def annotate(image: np.ndarray, paragraphs: list[tuple[str, list[float]]], thickness: int = 2) -> np.ndarray:
    """The page with a hollow box around each paragraph, and above it a filled tag
    with the name of its kind in black."""
    out = image.copy()
    h, w = out.shape[:2]
    for kind, (x1, y1, x2, y2) in paragraphs:
        a, b, c, d = (int(np.clip(v, 0, m)) for v, m in ((x1, w - 1), (y1, h - 1), (x2, w - 1), (y2, h - 1)))
        colour, name = colour_of(kind), tag(kind)
        for t in range(thickness):
            out[min(b + t, d), a : c + 1] = out[max(d - t, b), a : c + 1] = colour
            out[b : d + 1, min(a + t, c)] = out[b : d + 1, max(c - t, a)] = colour
        x, y = min(a, max(0, w - name.shape[1] - 8)), max(0, b - name.shape[0] - 6)
        out[y : y + name.shape[0] + 4, x : x + name.shape[1] + 8] = colour
        room = out[y + 2 : y + 2 + name.shape[0], x + 4 : x + 4 + name.shape[1]]
        room[name[: room.shape[0], : room.shape[1]]] = 0
    return out


def annotated_pages(pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(page_id, png): every page with its paragraphs drawn."""
    boxes = paragraphs.groupBy("page_id").agg(F.collect_list(F.struct("para_idx", "paragraph_type", "bbox")).alias("ps"))
    joined = beside_pages(pages, boxes, "left").select("page_id", "image", "ps")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a page at a time
                row = batch.slice(k, 1).to_pylist()[0]
                found = [(p["paragraph_type"], p["bbox"]) for p in sorted(row["ps"] or [], key=lambda p: p["para_idx"])]
                yield pa.RecordBatch.from_pydict({"page_id": [row["page_id"]], "png": [png(annotate(image_array(row["image"]), found))]})

    return joined.mapInArrow(run, "page_id long, png binary")


def report(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs per page and type."""
    return paragraphs.groupBy("page_id", "paragraph_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
