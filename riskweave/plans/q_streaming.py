"""Streaming queries (T6, T7): the stream runs to completion (availableNow)
over files derived from the given tables, and the sink table is returned."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import scratch_table_path
from ..sources import cohort
from ..sources.versioned import read_buckets
from ..streaming import jobs as SJ
from . import base as B
from . import q_state as QS
from . import sqlbits as S
from .registry import register


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("stream_ingest", B.sql(*B.STUDENT_CTES, QS.UPLOAD_SQL, select="SELECT * EXCLUDE (_action) FROM merged"))
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6+S1+P3+J6: upload CSV files ingested by a file-source stream
    (availableNow) and merged into the bucketed students table per batch."""
    root = _scratch(spark, "stream-ingest")
    up = cohort.event_upload(spark, sf_dir)
    strings = up.select(*[F.col(c).cast("string").alias(c) if c != "uploaded_at" else
                          F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in up.columns])
    strings.write.option("header", "true").csv(os.path.join(root, "incoming"))
    SJ.incremental_ingest(spark, os.path.join(root, "incoming"), os.path.join(root, "table"),
                          os.path.join(root, "checkpoint"), initial=QS._current(spark, sf_dir))
    return read_buckets(spark, os.path.join(root, "table"))


@register("stream_flag_alerts", B.sql(S.HISTORY, select=f"""
SELECT entity_id, strftime(ts, '%Y-%m-%d') AS ts, risk_score FROM (
  SELECT *, {S.BAND('risk_score')} = 'HIGH' AS high,
         lag({S.BAND('risk_score')} = 'HIGH') OVER (PARTITION BY entity_id ORDER BY ts) AS was
  FROM history_b)
WHERE high AND NOT coalesce(was, false)"""))
def q_stream_flag_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score files streamed through per-entity state (time and flag of the last
    reading) -> newly-flagged alerts, in two runs of the job: the files of the weeks
    up to the middle, then a restart that finds the later weeks. Equals the batch
    twin (lag over history)."""
    root = _scratch(spark, "stream-flags")
    hist = cohort.risk_history(spark, sf_dir)
    middle = F.lit(cohort.week_bounds(spark, sf_dir)[2]).cast("timestamp")
    for part in (hist.where(F.col("ts") <= middle), hist.where(F.col("ts") > middle)):
        part.write.mode("append").parquet(os.path.join(root, "in"))
        SJ.flag_alert_stream(spark, os.path.join(root, "in"), os.path.join(root, "out"),
                             os.path.join(root, "checkpoint"))
    out = spark.read.schema(SJ.ALERT_SCHEMA).parquet(os.path.join(root, "out"))
    return out.select("entity_id", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "risk_score")



@register("csv_ingest", B.sql(*S.FEATURE_CTES, select=f"""
SELECT sha256('{B.SALT}:' || student_key) AS anon_id, {', '.join(K.BASE_FEATURES)},
       NULL::VARCHAR AS phone_number, dropout_label
FROM features"""))
def q_csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1+S6+P1+P2+P3+P6+P7+A6+F1+F5: the feature table exported as an upload CSV
    (text), read back without inference, validated, cleaned, imputed, anonymised."""
    from ..sources import uploads as U
    root = _scratch(spark, "csv-upload")
    f = B.feature_table(spark, sf_dir).withColumnRenamed("student_key", "student_id").drop("student_id_orig")
    U.write_processed(f, root)
    return U.ingest(U.read_upload(spark, root), B.SALT)
