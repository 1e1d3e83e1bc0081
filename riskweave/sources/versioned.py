"""Versioned parquet tables: each change writes a new version directory.

Versions are numbered after all folders, so one left behind by a failed write is
passed over, and a retry writes to a folder of its own. A version is visible once its ``_SUCCESS`` marker exists, so readers never
see a half-written table and a table being read is never overwritten.
Works on any Hadoop-compatible file system (the listing goes through the
session's Hadoop configuration).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "v="


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def list_versions(spark: SparkSession, root: str) -> list[int]:
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(PREFIX) and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[len(PREFIX):]))
    return sorted(out)


def latest_version(spark: SparkSession, root: str) -> str | None:
    return newest_folder(spark, root, PREFIX)


def next_folder(spark: SparkSession, root: str, prefix: str) -> str:
    """Path of a numbered folder under ``root`` that no folder, finished or not, has yet."""
    fs, p, _ = _fs(spark, root)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    taken = [int(n[len(prefix):]) for n in names if n.startswith(prefix)]
    return f"{root}/{prefix}{max(taken, default=0) + 1:06d}"


def newest_folder(spark: SparkSession, root: str, prefix: str, holds: str = "_SUCCESS") -> str | None:
    """The numbered folder of the highest number that holds finished output: a file or
    folder of the name (pattern) ``holds``."""
    fs, p, jvm = _fs(spark, root)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{prefix}*/{holds}"))
    names = {st.getPath().getParent().getName() for st in found or []}
    return f"{root}/{max(names, key=lambda n: int(n[len(prefix):]))}" if names else None


def next_version(spark: SparkSession, root: str) -> str:
    """Path of a version that no folder, finished or not, has yet."""
    return next_folder(spark, root, PREFIX)


def write_version(df: DataFrame, root: str) -> str:
    """Write ``df`` as the next version and return its path."""
    path = next_version(df.sparkSession, root)
    df.write.mode("error").parquet(path)
    return path


# --- tables in buckets of a key, changed batch by batch ------------------------------------
# Folders <root>/batch=<id>-<attempt>/bucket=<k>/: a batch writes the buckets it touches; the
# newest finished batch that has a bucket holds its rows. The number of buckets belongs to the
# table: it is set from the rows it is made with, and kept in the folder <root>/buckets=<n>.
BUCKET_ROWS = 200_000


def n_buckets(spark: SparkSession, root: str) -> int | None:
    """The number of buckets of the table; None if there is no table yet."""
    path = newest_folder(spark, root, "buckets=", "_SUCCESS")
    return int(path.rpartition("=")[2]) if path else None


def create_buckets(spark: SparkSession, root: str, rows: int, rows_per_bucket: int = BUCKET_ROWS) -> int:
    """Set the number of buckets of a new table from the rows that it starts with."""
    n = max(1, -(-rows // rows_per_bucket))
    fs, p, jvm = _fs(spark, f"{root}/buckets={n}/_SUCCESS")
    fs.create(p, True).close()
    return n


def _batches(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(batch id, path) of the finished batches, oldest first."""
    fs, p, jvm = _fs(spark, root)
    out = []
    for st in fs.listStatus(p) if fs.exists(p) else []:
        name = st.getPath().getName()
        if name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append((int(name[len("batch="):].rpartition("-")[0]), f"{root}/{name}"))
    return sorted(out)


def is_applied(spark: SparkSession, root: str, batch: int) -> bool:
    return any(b == batch for b, _ in _batches(spark, root))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame | None:
    """The current rows (of the ``only`` buckets); None if no finished batch holds any."""
    newest: dict[int, str] = {}
    for _, path in _batches(spark, root):
        fs, p, _jvm = _fs(spark, path)
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("bucket="):
                newest[int(name[len("bucket="):])] = f"{path}/{name}"
    paths = [f for k, f in sorted(newest.items()) if only is None or k in only]
    return spark.read.parquet(*paths) if paths else None


def write_buckets(df: DataFrame, root: str, key: str, batch: int) -> None:
    """Write the rows of the touched buckets, whole, as batch ``batch``."""
    buckets = n_buckets(df.sparkSession, root)
    path = f"{root}/batch={batch}-{uuid.uuid4().hex[:12]}"
    (df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket")
       .write.mode("error").partitionBy("bucket").parquet(path))
