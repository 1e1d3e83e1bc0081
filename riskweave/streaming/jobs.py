"""Structured Streaming jobs (T6 incremental ingest, T7 flag transitions).

Both run with ``trigger(availableNow=True)``: every file present is processed
(the checkpoint records progress), then the query stops. A restarted job resumes
from its checkpoint; a batch that was being written when the driver died is
replayed, to a folder of its own, and one that was finished is skipped by its id. Checkpoints and output tables live under
the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..functions.columns import clip, to_double
from ..operators import state as ST
from ..sources.versioned import (BUCKET_ROWS, bucket_of, create_buckets, is_applied, n_buckets, read_buckets,
                                 write_buckets)

UPLOAD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                              ["student_id", "attendance_rate", "mobile_engagement_freq", "dropout_label",
                               "phone_number", "uploaded_at", "event_id"]])


def clean_upload(batch: DataFrame) -> DataFrame:
    """P3 + F5 on an all-string upload: try_cast, clip percentages, non-negative."""
    return batch.select(
        "student_id",
        clip(to_double("attendance_rate"), 0, 100).alias("attendance_rate"),
        clip(to_double("mobile_engagement_freq"), 0, None).alias("mobile_engagement_freq"),
        F.col("dropout_label").try_cast("int").alias("dropout_label"),
        "phone_number",
        F.col("uploaded_at").try_cast("timestamp").alias("uploaded_at"),
        F.col("event_id").try_cast("long").alias("event_id"))


def incremental_ingest(spark: SparkSession, source_dir: str, table_root: str, checkpoint: str,
                       initial: DataFrame | None = None, max_files: int | None = None,
                       rows_per_bucket: int = BUCKET_ROWS) -> None:
    """CSV files arriving in ``source_dir`` are cleaned and upserted (J6) into
    the table at ``table_root``, which is kept in buckets of the key: a batch reads
    and rewrites only the buckets its keys fall in. Their number follows the rows
    the table is made with. A batch is recorded by its id, so one that is replayed
    after a restart is applied once."""
    if n_buckets(spark, table_root) is None:
        create_buckets(spark, table_root, initial.count() if initial is not None else 0, rows_per_bucket)
    if initial is not None and read_buckets(spark, table_root) is None:
        write_buckets(initial, table_root, "student_id", -1)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if is_applied(session, table_root, batch_id):
            return
        rows = clean_upload(batch).where(F.col("student_id").isNotNull())
        # A number per bucket reaches the driver.
        buckets = n_buckets(session, table_root)
        touched = [r[0] for r in rows.select(bucket_of("student_id", buckets).alias("b")).distinct().collect()]
        if not touched:
            return
        current = read_buckets(session, table_root, touched)
        if current is None:
            current = session.createDataFrame([], _schema_of(session, table_root, rows))
        merged = ST.upsert(current, rows, "student_id", K.BASE_FEATURES,
                           ["dropout_label", "phone_number"], [F.col("uploaded_at"), F.col("event_id")])
        write_buckets(merged.drop("_action"), table_root, "student_id", batch_id)

    read = spark.readStream.schema(UPLOAD_SCHEMA).option("header", "true")
    if max_files:
        read = read.option("maxFilesPerTrigger", max_files)
    q = (read.csv(source_dir).writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    q.awaitTermination()


def _schema_of(spark: SparkSession, table_root: str, rows: DataFrame) -> T.StructType:
    """Schema of the table; of the upload where the table has no rows yet."""
    table = read_buckets(spark, table_root)
    if table is not None:
        return table.schema
    names = ["student_id", *K.BASE_FEATURES, "dropout_label", "phone_number"]
    have = {f.name: f.dataType for f in rows.schema}
    return T.StructType([T.StructField(n, have.get(n, T.DoubleType())) for n in names])


ALERT_SCHEMA = "entity_id long, ts timestamp, risk_score double"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FlagTransitions(StatefulProcessor):
    """Per entity: the readings that are HIGH when the reading before was not.

    State is one value, the time (microseconds) and flag of the last reading.
    Readings up to the last time seen are late: they raise nothing and leave the
    state as it is. A reading without a score is not flagged; one without a time
    is left out. A timer ``forget_ms`` after the last reading, in event time, drops
    the state of an entity that sends no more: its next HIGH reading is new.
    """

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us long, flagged boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        at, flagged = (before[0], before[1]) if before is not None else (None, False)
        timed = [(r["at_us"], r["risk_score"] is not None and r["risk_score"] >= K.TAU, r["risk_score"])
                 for r in rows if r["at_us"] is not None]
        for t, high, score in sorted(timed, key=lambda r: (r[0], r[2] is None, r[2])):
            if at is not None and before is not None and t <= before[0]:
                continue
            if high and not flagged:
                yield Row(entity_id=key[0], at_us=t, risk_score=score)
            at, flagged = t, high
        if at is not None and (before is None or at > before[0]):
            if before is not None:
                self.handle.deleteTimer(before[0] // 1000 + self.forget_ms)
            self.last.update((at, flagged))
            self.handle.registerTimer(at // 1000 + self.forget_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def flag_alert_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, max_files: int | None = None,
                      lateness: str = "3650 days", forget_days: int = 3650,
                      processor: type[StatefulProcessor] = FlagTransitions) -> None:
    """Score readings arriving as parquet files -> newly-flagged alerts.

    ``transformWithState`` on the RocksDB state store keeps, per entity, the time and
    flag of its last reading: state is bounded by the number of entities that sent
    something in the last ``forget_days``, not by history, and lies on the
    executors' disks with its changes in the checkpoint. Readings older than the
    newest by more than ``lateness`` are dropped by the watermark. Readings of a batch
    are put in order of time; ``max_files`` bounds the files of a batch.
    """
    read = spark.readStream.schema(ALERT_SCHEMA)
    if max_files:
        read = read.option("maxFilesPerTrigger", max_files)
    rows = read.parquet(source_dir).withWatermark("ts", lateness).withColumn("at_us", F.unix_micros("ts"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, STATE_PROVIDER)
    try:
        alerts = rows.groupBy("entity_id").transformWithState(
            processor(forget_days * 86_400_000), "entity_id long, at_us long, risk_score double", "append", "EventTime")
        alerts = alerts.select("entity_id", F.timestamp_micros("at_us").alias("ts"), "risk_score")
        q = (alerts.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
                   .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before)
