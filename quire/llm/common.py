"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of an Arrow operator works on at once.
SLICE_BYTES = 4 << 20

#: Bytes of an Arrow batch of texts at most (one row at least).
BATCH_BYTES = 8 << 20

#: Rows up to which a side with a few fixed-width columns may be broadcast.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only where that is unset on a single machine, as in tests, a folder is made.
    """
    to = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if to is None:
        if sc.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(to)
    return to


#: Rows of narrow columns that one part of a checkpoint may well have.
PART_ROWS = 250_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Checkpoints `df`: later reads survive lost executors and repeat nothing.

    Where the number of `rows` is known, at least roughly, no more files are written
    than they deserve, two for each core at least.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))
    return df.checkpoint()


def discard(df: DataFrame) -> None:
    """Removes the files of a checkpoint that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of a store that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`stored`, and the folder, for `remove`."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def text_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session now cuts Arrow batches at `BATCH_BYTES`: what a task holds
    doesn't depend on how long texts are.  A lower setting stays as it is."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = re.fullmatch(r"(\d+)b?", conf.get(key))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `limit` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows, else as it is."""
    return F.broadcast(df) if few(df, limit) else df


#: Rows of hot keys that `spread_join` broadcasts at most.
HOT_KEYS = 250_000
#: Rows of a key that are no reason to treat it apart.
HOT_ROWS = 1000


def spread_join(rows: DataFrame, side: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `side`, which has one row per key and in `n` how many of the
    `total` rows have it.  Keys of very many rows are broadcast, so that their rows
    stay where they are; there can be no more than `HOT_KEYS` of these."""
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(side.where(F.col("n") > most).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(side.where(F.col("n") <= most).drop("n"), key, how)
    return rows.join(hot, key).unionByName(cold)


def binary(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of one column, a row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


#: Bytes of one text whose words are objects at once.
LONG_TEXT = 2 << 20
_SPACE = re.compile(rb"[\x09-\x0d\x20]")


def cuts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about `LONG_TEXT` bytes, cut at ASCII white space; most
    texts are one part.  Words of the parts are the words of the text."""
    at = 0
    while len(text) - at > LONG_TEXT:
        space = _SPACE.search(text, at + LONG_TEXT)
        if not space:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes], pa.RecordBatch], dict[str, object]]],
    added: T.StructType,
    text: str,
    keep: list[str] | None = None,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Adds columns that follow from a text column, in Arrow batches.

    `make()` runs once per task and gives a function from the texts' bytes (and
    their batch) to the added columns.  `keep` lists the input columns to return
    (default: all); an input column named like an added one is replaced.  `most`
    bytes of text, or one row, are worked on at once.
    """
    names = {f.name for f in added.fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + list(added.fields))
    arrow = {f.name: to_arrow(f.dataType) for f in added.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        yield from each(work, batches)
        del work
        release()

    def each(work, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", most):
                new = work(binary(part.column("__text")), part)
                columns = [part.column(c) for c in keep] + [pa.array(new[n], t) for n, t in arrow.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *arrow])

    return text_batches(source).mapInArrow(run, schema)


def release() -> None:
    """Gives a finished task's memory back to the system; the worker lives on."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def held_out(doc_id) -> object:
    """Rows no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
