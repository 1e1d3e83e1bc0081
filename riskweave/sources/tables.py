"""Parquet scans of the input tables with explicit column pruning."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SCHEMAS: dict[tuple[str, int, int], StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one parquet table; selecting columns here makes the ReadSchema narrow.

    The schema of a table is read from its footers once for each state of it (time
    of change and length), so that queries over the same tables don't start a job
    each for it.
    """
    path = table_path(sf_dir, name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    state = (path, status.getModificationTime(), status.getLen())
    if state not in _SCHEMAS:
        _SCHEMAS[state] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[state]).parquet(path)
    return df.select(*columns) if columns else df
