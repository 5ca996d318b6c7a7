"""Tables that stages leave for each other: pages dealt by page_id, rows of models.

They lie in the folder that driver and executors share, `spark.checkpoint.dir`; only
where that is unset on a single machine, as in tests, a folder is made.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if to is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        to = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(to)
    return to.rstrip("/")


def recorded(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back: it is computed once,
    and what reads it survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_pages(pages: DataFrame, buckets: int | None = None) -> DataFrame:
    """The pages (page_id, image) as a table in buckets by page_id, with their pixels
    decoded: later stages read them as they lie, and no join moves them.

    Every task writes its part of each bucket, so nothing is shuffled here either.  The
    number of buckets (default: the shuffle partitions) is that of later tasks.
    """
    spark = pages.sparkSession
    name = f"quire_pages_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select("page_id", "image").write.bucketBy(buckets, "page_id")
    rows.format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def dealt_by_page(pages: DataFrame) -> int:
    """In how many parts the pages lie dealt by page_id, as `store_pages` leaves them; else 0."""
    now = pages._jdf.queryExecution().sparkPlan().outputPartitioning()
    return now.numPartitions() if "hashpartitioning(page_id" in now.toString() else 0


def beside_pages(pages: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Pages (page_id, image) with `rows`, which have at most one row a page and page_id.

    The rows come to the pages and are the built side of a hashed join: they are dealt
    as the pages lie, so that these stay where they are and aren't sorted.
    """
    parts = dealt_by_page(pages)
    rows = rows.repartition(parts, "page_id") if parts else rows
    return pages.select("page_id", "image").join(rows.hint("shuffle_hash"), "page_id", how)
