"""Validation, identifiers, logs, reports, model store and corrected operators on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.functions.columns import to_double
from riskweave.operators import dashboard as D
from riskweave.operators import evaluation as EV
from riskweave.operators import explain as EX
from riskweave.operators import logs as LG
from riskweave.operators import monitoring as MO
from riskweave.operators import scoring as SC
from riskweave.operators import state as ST
from riskweave.operators import timeseries as TS
from riskweave.operators import validation as VA
from riskweave.sources import uploads as U


def test_no_number_is_null(spark):
    texts = ["1.5", "NaN", "nan", "Infinity", "-Infinity", "?", "", None, " 2 ", "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(to_double("t")).collect()] == [1.5, None, None, None, None, None, None, None, 2.0, 1000.0]


def test_nan_cell_of_an_upload_is_imputed(spark, tmp_path):
    (tmp_path / "u.csv").write_text("student_id,attendance_rate,phone\na,NaN,1\nb,50,\nc,7,3\n")
    up = U.ingest(U.read_upload(spark, str(tmp_path / "u.csv")), "s").collect()
    assert sorted(r.attendance_rate for r in up) == [7.0, 28.5, 50.0]
    assert {r.phone_number for r in up} == {"1", "3", None}


def test_processed_csv_drops_null_labels(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 0.0)], "id int, dropout_label double")
    U.append_processed(df, str(tmp_path / "p"))
    U.append_processed(df, str(tmp_path / "p"))
    out = U.read_processed(spark, str(tmp_path / "p"), "id int, dropout_label double")
    assert sorted((r.id, r.dropout_label) for r in out.collect()) == [(1, 1), (1, 1), (3, 0), (3, 0)]


def test_pilot_targets(spark):
    actual = spark.createDataFrame([("auc_x100", 80.0), ("conversion_rate", 46.0)], "metric string, value double")
    got = {r.metric: (r.value, r.target, r.status) for r in D.pilot_targets(actual).collect()}
    assert got == {"auc_x100": (80.0, 80.0, "green"), "conversion_rate": (46.0, 60.0, "amber"), "usability_score": (None, 70.0, None)}


def test_calibration_leaves_out_missing_scores_and_labels(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1), (None, 1), (0.5, None)], "s double, y int")
    got = EV.calibration(df, "s", "y", 2).collect()
    assert sum(r.n for r in got) == 2 and all(r.mean_predicted is not None for r in got)


def test_newly_flagged_uses_the_stored_band(spark):
    now = spark.createDataFrame([(1, 0.4432, "MEDIUM"), (2, 0.4432, "HIGH"), (3, 0.9, "HIGH")], "id int, risk_score double, risk_band string")
    was = spark.createDataFrame([(3, True)], "id int, is_flagged boolean")
    assert [r.id for r in TS.newly_flagged(now, was, "id", band="risk_band").collect()] == [2]


def test_validation_reaches_every_rule(spark):
    rows = [(1, 50.0, 50.0, 50.0, 1.0, 5.0, "SMS"), (2, 101.0, 50.0, 50.0, 1.0, 5.0, "SMS"), (3, 0.0, -1.0, 100.0, 0.0, 0.0, None),
            (4, 5.0, 5.0, None, -1.0, 5.0, "SMSX")]
    names = "id int, attendance_rate double, quiz_average double, assignment_submission_rate double, " \
            "mobile_engagement_freq double, financial_aid_status double, kind string"
    valid, rejected = VA.split_valid(VA.validate(spark.createDataFrame(rows, names), {"kind": ["SMS", "EMAIL"]}))
    assert [r.id for r in valid.collect()] == [1]
    assert {r.id: r.errors for r in rejected.collect()} == {
        2: ["attendance_rate outside 0..100"], 3: ["quiz_average outside 0..100"],
        4: ["assignment_submission_rate missing", "mobile_engagement_freq negative", "kind unknown: SMSX"]}


def test_lookup_and_times(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (None, "cc")], "id int, anon string")
    assert [r.id for r in VA.lookup(df, F.lit("bb"), "id", "anon").collect()] == [2]
    assert [r.anon for r in VA.lookup(df, F.lit("1"), "id", "anon").collect()] == ["aa"]
    t = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+01:00",), ("2024-01-02",), ("x",), (None,)], "t string")
    got = [r[0] for r in t.select(VA.version_stamp(VA.parse_iso("t"))).collect()]
    assert got == ["v20240102_030405", "v20240102_020405", None, None, None]


def test_score_rules(spark):
    df = spark.createDataFrame([(None, None), (0.0, None), (0.85, "LOW"), (0.65, None), (0.45, None)], "risk_score double, risk_band string")
    got = [tuple(r) for r in df.select(VA.default_score(), *SC.band_rules()[1:]).collect()]
    assert got == [(0.5, None, "ok"), (0.0, "low", "ok"), (0.85, "LOW", "critical"), (0.65, "high", "at_risk"), (0.45, "medium", "at_risk")]


def test_explain_latest_keeps_other_rows(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    log = spark.createDataFrame([(1, t[0], 0.1, "o"), (1, t[1], 0.2, "o"), (2, t[0], 0.3, "o")], "id int, ts timestamp, s double, e string")
    new = spark.createDataFrame([(1, "n"), (9, "n")], "id int, e string")
    got = sorted((r.id, r.s, r.e, r._inserted, r._updated) for r in ST.explain_latest(log, new, "id", "ts", "e", {"s": F.lit(0.0)}).collect())
    assert got == [(1, 0.1, "o", False, False), (1, 0.2, "n", False, True), (2, 0.3, "o", False, False), (9, 0.0, "n", True, False)]


def test_guards_and_truncate(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(2, 20), (3, 30)], "id int, v int")
    assert {r.id: r.decision for r in ST.duplicate_guard(a, b, "id").collect()} == {2: "rejected", 3: "accepted"}
    assert {r.id: (r.status, r.v) for r in ST.referential_check(a, b, "id", "id", ["v"]).collect()} == {1: ("orphan", None), 2: ("ok", 20)}
    assert [r.id for r in ST.delete_orphans(a, b, "id", "id").collect()] == [2]
    assert ST.truncate(b).count() == 0 and ST.truncate(b).schema == b.schema


def test_counsellor_text_falls_back(spark):
    df = spark.createDataFrame([("mine", ["f"], 10.0, 20.0), (None, ["f1", "f2", "f3"], 10.0, 20.0), (None, None, 10.0, 20.0), (None, [], 1.0, 2.0)],
                               "c string, f array<string>, attendance_rate double, quiz_average double")
    got = [r[0] for r in df.select(EX.counsellor_text(F.col("c"), F.lit("id"), F.lit("HIGH"), F.col("f"))).collect()]
    assert got[0] == "mine" and "f1; f2." in got[1] and got[2] == "Attendance 10.0%, quiz average 20.0%." and "See dashboard" in got[3]


def test_drift_without_a_baseline_and_ks_in_ranges(spark):
    df = spark.createDataFrame([(i / 100, "current") for i in range(50)], "s double, sample string")
    r = MO.drift_check(df, "s", "sample").first()
    assert (r.drift_level, r.drift_detected, r.psi, r.ks_statistic) == ("NO_BASELINE", False, None, None)
    both = df.unionByName(spark.createDataFrame([(i / 60, "baseline") for i in range(50)], df.schema))
    exact = MO.ks_statistic(both, "s", "sample", "baseline", "current").first()
    rounded = MO.ks_statistic(both, "s", "sample", "baseline", "current", digits=9).first()
    assert abs(exact.ks - rounded.ks) < 1e-12 and exact.n1 == exact.n2 == 50
    assert MO.drift_check(both, "s", "sample").first().drift_level == "SIGNIFICANT"


def test_logs_history_and_trend(spark, tmp_path):
    root = str(tmp_path / "log")
    for i, v in enumerate(["v1", "v2", "v3"]):
        rows = spark.createDataFrame([(k, 0.1 * i, "LOW", dt.datetime(2024, 1, 1 + i)) for k in (1, 2)], "id int, risk_score double, risk_band string, t timestamp")
        LG.append(LG.prediction_rows(rows, "id", F.col("t"), F.lit(v)), root, f"run-{i}", "model_version")
    got = sorted((r.id, r.position, r.model_version) for r in LG.history(spark.read.parquet(root), "id", n=2).collect())
    assert got == [(1, 1, "v3"), (1, 2, "v2"), (2, 1, "v3"), (2, 2, "v2")]
    runs = spark.createDataFrame([(dt.datetime(2024, 1, d), d / 10) for d in range(1, 15)], "at timestamp, f1 double")
    t = sorted((r.run, r.f1, r.f1_change) for r in LG.run_trend(runs, "at", ["f1"]).collect())
    assert len(t) == 10 and t[0][1:] == (0.5, None) and t[-1][1] == 1.4 and abs(t[-1][2] - 0.1) < 1e-12


def test_a_repeated_run_is_logged_once(spark, tmp_path):
    root = str(tmp_path / "log")
    rows = spark.range(200).select(F.col("id"), F.lit("v1").alias("model_version"))
    LG.append(rows, root, "monday", "model_version")
    dying = rows.repartition(4).withColumn("id", F.when(F.col("id") == 150, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        LG.append(dying, root, "tuesday", "model_version")     # dies half way: nothing of it is seen
    assert {r.run_id for r in spark.read.parquet(root).select("run_id").distinct().collect()} == {"monday"}
    for _ in range(2):
        LG.append(rows, root, "tuesday", "model_version")
    got = spark.read.parquet(root).groupBy("run_id", "id").count()
    assert got.count() == 400 and got.where("count > 1").count() == 0


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "metric string, value double")
    LG.write_report(rows, str(tmp_path), "one")
    assert sorted((r.report, r.metric, r.value) for r in LG.read_report(spark, str(tmp_path), "one").collect()) == [("one", "a", 1.5), ("one", "b", None)]
    none = LG.read_report(spark, str(tmp_path), "two")
    assert none.count() == 0 and none.schema == LG.REPORT_SCHEMA


def test_curves_merged_by_position_and_too_few_rows(spark):
    rows = [(m, i / 40, i % 2) for m in ("a", "b") for i in range(40)] + [("c", 0.5, 1), ("c", 0.2, 0)]
    df = spark.createDataFrame(rows, "model string, s double, y int")
    curves = EV.roc_report(df, "s", "y", "model")
    assert {r.model for r in curves.collect()} == {"a", "b"}
    wide = EV.merge_curves(curves, {"a": "x", "b": "y"}).collect()
    assert all(r.fpr_x == r.fpr_y and r.tpr_x == r.tpr_y for r in wide) and max(r.tpr_x for r in wide) == 1.0


def test_constants_hold_the_pilot_targets():
    assert dict(K.PILOT_TARGETS) == {"auc_x100": 80.0, "conversion_rate": 60.0, "usability_score": 70.0}


def test_checkpoint_folder_is_required_off_local(spark, monkeypatch):
    from types import SimpleNamespace

    from riskweave import session
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None))
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=sc)
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)
