"""Streams and versioned tables that fail, restart and replay."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.sources import versioned as V
from riskweave.streaming import jobs as SJ

HEAD = "student_id,attendance_rate,mobile_engagement_freq,dropout_label,phone_number,uploaded_at,event_id\n"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text(HEAD + "".join(",".join(map(str, r)) + "\n" for r in rows))


def table(spark, root):
    df = V.read_buckets(spark, root)
    return {r.student_id: r.attendance_rate for r in df.collect()} if df is not None else {}


def initial(spark):
    rows = [(f"s{i}", *[float(i)] * 5, 0, None) for i in range(20)]
    cols = ", ".join(f"{f} double" for f in K.BASE_FEATURES)
    return spark.createDataFrame(rows, f"student_id string, {cols}, dropout_label int, phone_number string")


def run(spark, tmp, **kw):
    SJ.incremental_ingest(spark, str(tmp / "in"), str(tmp / "table"), str(tmp / "cp"), initial=initial(spark), rows_per_bucket=1, **kw)


def test_ingest_in_batches_and_restart(spark, tmp_path):
    put(tmp_path / "in", "a.csv", [("s1", 50, 1, 1, "", "2024-01-01 00:00:00", 1), ("new", "NaN", 1, "", "", "2024-01-01 00:00:00", 2)])
    run(spark, tmp_path, max_files=1)
    got = table(spark, str(tmp_path / "table"))
    assert got["s1"] == 50 and got["new"] == 0 and got["s2"] == 2 and len(got) == 21
    before = {p for p in os.listdir(tmp_path / "table")}
    run(spark, tmp_path)  # nothing new: nothing written
    assert {p for p in os.listdir(tmp_path / "table")} == before
    put(tmp_path / "in", "b.csv", [("s1", 60, 1, 1, "", "2024-01-02 00:00:00", 3)])
    run(spark, tmp_path)
    assert table(spark, str(tmp_path / "table"))["s1"] == 60
    # The last batch wrote the bucket of its one key only.
    last = max((p for p in os.listdir(tmp_path / "table") if p.startswith("batch=")), key=lambda p: int(p[6:].rpartition("-")[0]))
    assert len([b for b in os.listdir(tmp_path / "table" / last) if b.startswith("bucket=")]) == 1


def test_failed_batch_is_replayed_once(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "a.csv", [("s1", 50, 1, 1, "", "2024-01-01 00:00:00", 1)])
    real = SJ.write_buckets

    def dies_after_writing(df, root, key, batch, *a):
        real(df, root, key, batch, *a)
        if batch >= 0:
            raise RuntimeError("driver lost")

    monkeypatch.setattr(SJ, "write_buckets", dies_after_writing)
    with pytest.raises(Exception, match="driver lost"):
        run(spark, tmp_path)
    monkeypatch.setattr(SJ, "write_buckets", real)
    run(spark, tmp_path)  # the batch is in the table already: skipped by its id
    batches = [b for b, _ in V._batches(spark, str(tmp_path / "table"))]
    assert batches == [-1, 0] and table(spark, str(tmp_path / "table"))["s1"] == 50


def test_partial_write_is_passed_over(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "a.csv", [("s1", 50, 1, 1, "", "2024-01-01 00:00:00", 1)])
    real = SJ.write_buckets

    def dies_half_way(df, root, key, batch, *a):
        if batch >= 0:
            half = f"{root}/batch={batch}-dead/bucket=0"
            os.makedirs(half)
            open(f"{half}/part-0.parquet", "w").close()
            raise RuntimeError("executor lost")
        real(df, root, key, batch, *a)

    monkeypatch.setattr(SJ, "write_buckets", dies_half_way)
    with pytest.raises(Exception, match="executor lost"):
        run(spark, tmp_path)
    assert table(spark, str(tmp_path / "table"))["s1"] == 1
    monkeypatch.setattr(SJ, "write_buckets", real)
    run(spark, tmp_path)
    assert table(spark, str(tmp_path / "table"))["s1"] == 50


def test_versions_pass_over_a_failed_write(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(3)
    first = V.write_version(df, root)
    os.makedirs(f"{root}/v=000002")  # left by a write that died
    assert V.latest_version(spark, root) == first
    third = V.write_version(df.limit(1), root)
    assert third.endswith("v=000003") and V.latest_version(spark, root) == third and V.list_versions(spark, root) == [1, 3]


def scores(spark, folder, rows):
    spark.createDataFrame([(e, dt.datetime(2024, 1, d), s) for e, d, s in rows],
                          "entity_id long, ts timestamp, risk_score double").coalesce(1).write.mode("append").parquet(str(folder))


def flags(spark, tmp, **kw):
    SJ.flag_alert_stream(spark, str(tmp / "in"), str(tmp / "out"), str(tmp / "cp"), **kw)
    out = spark.read.schema(SJ.ALERT_SCHEMA).parquet(str(tmp / "out"))
    return sorted((r.entity_id, r.ts.day) for r in out.collect())


def test_flags_across_batches_with_late_rows(spark, tmp_path):
    scores(spark, tmp_path / "in", [(1, 1, 0.9), (1, 3, 0.1), (1, 2, 0.9), (2, 1, 0.1), (3, 2, None)])
    assert flags(spark, tmp_path) == [(1, 1)]
    # A late reading neither raises an alert nor flips the flag; a null score is not flagged.
    scores(spark, tmp_path / "in", [(1, 2, 0.95), (1, 4, 0.8), (1, 5, 0.9), (2, 2, 0.9), (3, 3, 0.9)])
    assert flags(spark, tmp_path) == [(1, 1), (1, 4), (2, 2), (3, 3)]
    scores(spark, tmp_path / "in", [(1, 6, 0.9), (2, 1, 0.1), (2, 3, 0.9)])
    assert flags(spark, tmp_path) == [(1, 1), (1, 4), (2, 2), (3, 3)]
    assert flags(spark, tmp_path) == [(1, 1), (1, 4), (2, 2), (3, 3)]


def test_state_of_a_silent_entity_expires(spark, tmp_path):
    kw = {"lateness": "1 day", "forget_days": 5}
    scores(spark, tmp_path / "in", [(1, 1, 0.9), (2, 1, 0.9)])
    assert flags(spark, tmp_path, **kw) == [(1, 1), (2, 1)]
    # Entity 2 goes on, entity 1 is silent: its timer fires once the watermark passes day 6.
    scores(spark, tmp_path / "in", [(2, 5, 0.9), (2, 10, 0.9)])
    assert flags(spark, tmp_path, **kw) == [(1, 1), (2, 1)]
    scores(spark, tmp_path / "in", [(1, 12, 0.9), (2, 12, 0.9)])
    assert flags(spark, tmp_path, **kw) == [(1, 1), (1, 12), (2, 1)]


def test_flags_survive_a_failed_run(spark, tmp_path):
    class Dies(SJ.FlagTransitions):
        def handleInputRows(self, key, rows, timers):
            if key[0] == 3:
                raise RuntimeError("worker lost")
            return super().handleInputRows(key, rows, timers)

    scores(spark, tmp_path / "in", [(1, 1, 0.9), (2, 1, 0.1)])
    assert flags(spark, tmp_path) == [(1, 1)]
    scores(spark, tmp_path / "in", [(1, 2, 0.9), (2, 2, 0.9), (3, 2, 0.9)])
    with pytest.raises(Exception, match="worker lost"):
        flags(spark, tmp_path, processor=Dies)
    assert flags(spark, tmp_path) == [(1, 1), (2, 2), (3, 2)]


def test_the_table_keeps_its_number_of_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    assert V.n_buckets(spark, root) is None
    assert V.create_buckets(spark, root, 1001, 100) == 11 == V.n_buckets(spark, root)
    V.write_buckets(spark.range(50).select(F.col("id").cast("string").alias("student_id")), root, "student_id", 0)
    assert V.read_buckets(spark, root).count() == 50
    assert {int(p[7:]) for p in os.listdir(next((tmp_path / "t").glob("batch=*"))) if p.startswith("bucket=")} <= set(range(11))
    assert V.create_buckets(spark, str(tmp_path / "e"), 0) == 1


def test_bucket_of_is_stable(spark):
    a = spark.range(100).select(F.col("id").cast("string").alias("k")).withColumn("b", V.bucket_of("k", 16))
    assert all(0 <= r.b < 16 for r in a.collect())
