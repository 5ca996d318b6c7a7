"""Image files by Spark's Python data sources: sizes from headers alone, and a writer
that commits.

`page_headers` reads the first bytes of each file of a folder, so the sizes of pages
cost neither their pixels nor their decoding.  `page_files` writes an image file for
each page: tasks write under a temporary folder, and only the files of attempts that
succeeded move to their names, once all did; a failed or repeated attempt leaves nothing.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a file that are read first; headers are longer only where much stands before the size.
HEAD = 1 << 16
#: Files of one task.
FILES = 1000
_TEMPORARY = "_temporary"


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG, JPEG, GIF or BMP file; None where it has none."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:  # padding
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame's header
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        else:
            at += 2 if mark == 1 or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _store(path: str):
    """(file system, path there, what stands before paths in a file's full name)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file://"
    store, own = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store, own, "file://" if isinstance(store, fs.LocalFileSystem) else path.split("://")[0] + "://"


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _HeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        store, path, _ = _store(self.path)
        found = [f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        found = sorted(f for f in found if not any(part.startswith(("_", ".")) for part in posixpath.relpath(f, path).split("/")))
        return [_Files(found[k : k + FILES]) for k in range(0, len(found), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _, before = _store(self.path)
        for path in partition.paths:
            with store.open_input_stream(path, buffer_size=0) as file:
                head = file.read(HEAD)
                size = image_size(head)
                if size is None and head[:2] == b"\xff\xd8":
                    size = image_size(head + file.read())
            if size is not None:
                yield (before + path, *size)


class PageHeaders(DataSource):
    """(origin, page_w, page_h) of the image files of a folder; others are left out."""

    @classmethod
    def name(cls) -> str:
        return "page_headers"

    def schema(self) -> str:
        return "origin string, page_w int, page_h int"

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _folder(self, root: str) -> str:
        return f"{root.rstrip('/')}/{_TEMPORARY}/{self.job}"

    def write(self, iterator) -> _Written:
        store, root, _ = _store(self.path)
        attempt, files = uuid.uuid4().hex, []
        folder = f"{self._folder(root)}/{attempt}"
        store.create_dir(folder, recursive=True)
        for row in iterator:
            if row.page_id is None:
                raise ValueError("a page without an id has no file")
            name = f"{row.page_id}.png"
            with store.open_output_stream(f"{folder}/{name}") as file:
                file.write(bytes(row.png))
            files.append((f"{folder}/{name}", name))
        return _Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root, _ = _store(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a page_id has more than one image")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for written, name in files:
            store.move(written, f"{root.rstrip('/')}/{name}")
        store.delete_dir(self._folder(root))
        with store.open_output_stream(f"{root.rstrip('/')}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root, _ = _store(self.path)
        if store.get_file_info(self._folder(root)).type == fs.FileType.Directory:
            store.delete_dir(self._folder(root))


class PageFiles(DataSource):
    """Writes (page_id, png) as files page_id.png of a folder."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "page_id long, png binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], overwrite)


def read_page_sizes(spark: SparkSession, path: str, page_id: str | None = None) -> DataFrame:
    """(page_id, page_w, page_h) of a folder's image files by their headers; ids are those
    of `read_pages` (`page_id` may be an expression over `origin`)."""
    spark.dataSource.register(PageHeaders)
    found = spark.read.format("page_headers").load(path)
    return found.select(F.expr(page_id or "xxhash64(origin)").alias("page_id"), "page_w", "page_h")


def write_images(images: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes (page_id, png), as `annotated_pages` gives them, a file each; all or none."""
    images.sparkSession.dataSource.register(PageFiles)
    images.select("page_id", "png").write.format("page_files").mode("overwrite" if overwrite else "append").save(path)
