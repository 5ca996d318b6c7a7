"""Image files: sizes by headers, and a writer that leaves whole results or none."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.sources.files import image_size, read_page_sizes, write_images
from quire.sources.pages import page_sizes, png, read_pages


def image(w, h):
    return png(np.full((h, w, 3), 7, np.uint8))


def jpeg(w, h, before=b""):
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, h, w, 0)
    return b"\xff\xd8" + before + frame + b"\xff\xd9"


@pytest.mark.parametrize(
    ("data", "size"),
    [
        (image(31, 17), (31, 17)),
        (jpeg(640, 480), (640, 480)),
        (jpeg(5, 9, b"\xff\xe0\x00\x04ab\xff\xc4\x00\x05abc\xff\xff\xd0\xff\x01"), (5, 9)),
        (jpeg(70, 80, (b"\xff\xe1" + struct.pack(">H", 60002) + bytes(60000)) * 3), (70, 80)),
        (b"GIF89a" + struct.pack("<HH", 12, 13) + b"\0\0\0", (12, 13)),
        (b"BM" + bytes(16) + struct.pack("<ii", 40, -50) + bytes(4), (40, 50)),
        (b"", None),
        (b"\x89PNG\r\n\x1a\n", None),
        (b"\xff\xd8\xff\xe0", None),
        (b"no image at all, but long enough", None),
    ],
)
def test_headers(data, size):
    assert image_size(data) == size


def test_sizes_without_pixels(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.png").write_bytes(image(10 + k, 20 + k))
    (tmp_path / "late.jpg").write_bytes(jpeg(70, 80, (b"\xff\xe1" + struct.pack(">H", 60002) + bytes(60000)) * 3))
    (tmp_path / "notes.txt").write_text("no image")
    (tmp_path / "cut.png").write_bytes(image(600, 700)[:40])  # a header is enough
    got = {tuple(r) for r in read_page_sizes(spark, str(tmp_path)).collect()}
    assert {r[1:] for r in got} == {(10 + k, 20 + k) for k in range(5)} | {(70, 80), (600, 700)}
    (tmp_path / "cut.png").unlink()
    (tmp_path / "late.jpg").unlink()
    whole = {tuple(r) for r in page_sizes(read_pages(spark, str(tmp_path))).collect()}
    assert {tuple(r) for r in read_page_sizes(spark, f"file://{tmp_path}").collect()} == whole and len(whole) == 5
    assert read_page_sizes(spark, str(tmp_path), "length(origin)").count() == 5


def files(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if not p.name.startswith("_")}


def test_files_equal_pages(spark, tmp_path):
    want = {f"{k}.png": image(4 + k, 5) for k in range(9)}
    rows = spark.createDataFrame([(k, bytearray(want[f"{k}.png"])) for k in range(9)], "page_id long, png binary").repartition(3)
    out = tmp_path / "out"
    write_images(rows.where("page_id < 4"), str(out))
    write_images(rows.where("page_id >= 4"), str(out))
    assert files(out) == want and (out / "_SUCCESS").exists() and not list((out / "_temporary").iterdir())
    write_images(rows.where("page_id = 2"), str(out), overwrite=True)
    assert files(out) == {"2.png": want["2.png"]}
    again = read_pages(spark, str(out))
    assert again.count() == 1 and again.first().image["width"] == 6


def test_failed_attempts_leave_nothing(spark, tmp_path):
    import pyarrow as pa

    data, out = image(3, 3), tmp_path / "out"

    def failing(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_pydict({"page_id": ids[:1], "png": [data]})
            if 3 in ids:
                raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        write_images(spark.range(0, 4, 1, 4).mapInArrow(failing, "page_id long, png binary"), str(out))
    assert not out.exists() or (files(out) == {} and not (out / "_SUCCESS").exists())
    rows = spark.createDataFrame([(1, bytearray(data)), (1, bytearray(data))], "page_id long, png binary")
    with pytest.raises(Exception, match="more than one image"):
        write_images(rows, str(out))
    with pytest.raises(Exception, match="without an id"):
        write_images(rows.withColumn("page_id", F.lit(None).cast("long")), str(out))
    assert not out.exists() or files(out) == {}


def test_an_attempt_that_fails_once(tmp_path):
    """What a lost attempt wrote isn't committed; its repeat is."""
    from pyspark.sql import Row

    from quire.sources.files import _FileWriter

    writer = _FileWriter(str(tmp_path / "out"), False)

    def rows(fails):
        for k in range(3):
            if fails and k == 2:
                raise RuntimeError("lost")
            yield Row(page_id=k, png=image(2 + k, 2))

    with pytest.raises(RuntimeError):
        writer.write(rows(True))
    messages = [writer.write(rows(False)), writer.write(iter([Row(page_id=9, png=b"x")])), None]
    writer.commit(messages)
    assert files(tmp_path / "out") == {**{f"{k}.png": image(2 + k, 2) for k in range(3)}, "9.png": b"x"}
