"""Session helpers: configuration defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_SCRATCH: list[str] = []  # folders of intermediate tables given out in this process

# Defaults a job wants on any cluster. Settings already present on the session
# (from spark-submit or the cluster config) always win.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the library's SQL defaults where the session leaves them unset."""
    for key, value in CLUSTER_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    # Time zone decides week boundaries and formatted timestamps: pin it.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "riskweave") -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets the folder (on a file system that all executors share) and it
    is only read here; without it a cluster job fails. A local master, as in
    tests, gets a fresh scratch folder for the session.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="riskweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    read it back: computed once, lineage cut, its size known to the planner, and
    it survives executor loss. (``Dataset.checkpoint`` would compute the plan
    twice unless also cached.) ``drop_scratch`` deletes the tables."""
    path = scratch_table_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)  # (without it a job reads the footers)
    out.scratch_path = path
    return out


def side_by_side(*steps: Callable[[], T]) -> list[T]:
    """Run steps that don't need each other's tables at the same time: each starts
    its own Spark jobs, which share the executors."""
    run = inheritable_thread_target(SparkSession.getActiveSession())(lambda step: step())
    with ThreadPool(len(steps)) as pool:
        return pool.map(run, steps)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` has returned, once all that was built on
    them is written itself."""
    for df in tables:
        discard(df.sparkSession, df.scratch_path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_table_path`` has given out, once it is read."""
    if path in _SCRATCH:
        _SCRATCH.remove(path)
        delete_folder(spark, path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process so far (those of ``cut_lineage``
    and all other folders of ``scratch_table_path``); returns their number. Call it when the results built on them are written."""
    n = len(_SCRATCH)
    while _SCRATCH:
        delete_folder(spark, _SCRATCH.pop())
    return n


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables, which
    ``drop_scratch`` deletes."""
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", name)
    _SCRATCH.append(path)
    return path


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has committed its output to the folder."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def join_dimension(fact: DataFrame, dim: DataFrame, on: str | list[str], how: str = "left",
                   max_rows: int = 200_000) -> DataFrame:
    """Join a dimension table. Its rows are counted first (at most ``max_rows`` + 1):
    up to the bound it is broadcast, so a few frequent keys of the fact table
    shuffle nothing; beyond it the join is planned by size, and adaptive
    execution splits skewed keys."""
    if dim.limit(max_rows + 1).count() <= max_rows:
        dim = F.broadcast(dim)
    return fact.join(dim, on, how)
