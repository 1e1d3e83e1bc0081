"""Scalar functions and band rules."""

import math

from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.functions.columns import clip, fround, hash_id, heat_band, mask_id, risk_band
from riskweave.functions.stats import kolmogorov_p, normal_two_sided_p
from riskweave.operators import explain as EX
from riskweave.operators import scoring as SC


def test_risk_band_boundaries(spark):
    tau = K.TAU
    rows = [(0.0,), (0.7 * tau,), (0.6 * tau,), (tau - 0.001,), (tau,), (0.9,), (1.0,), (None,)]
    df = spark.createDataFrame(rows, "s double").select("s", risk_band("s").alias("b"), heat_band("s").alias("h"))
    got = {r.s: (r.b, r.h) for r in df.collect()}
    assert got[tau][0] == "HIGH"
    assert got[tau - 0.001][0] == "MEDIUM"
    assert got[0.6 * tau][0] == "MEDIUM"
    assert got[0.7 * tau][0] == "MEDIUM"
    assert got[0.0] == ("LOW", "low")
    assert got[1.0] == ("HIGH", "critical")
    assert got[0.9][1] == "critical"
    assert got[None] == (None, None)


def test_clip_keeps_null_and_fround_half_up(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (150.0,), (0.125,), (2.675,)], "x double")
    out = df.select(clip("x", 0, 100).alias("c"), fround("x", 2).alias("r")).collect()
    assert out[0].c is None and out[1].c == 0.0 and out[2].c == 100.0
    assert out[3].r == 0.13


def test_hash_and_mask(spark):
    df = spark.createDataFrame([("a" * 16,), ("b" * 17,)], "id string")
    out = df.select(mask_id("id").alias("m"), hash_id("id", "salt").alias("h")).collect()
    assert out[0].m == "a" * 16
    assert out[1].m == "b" * 8 + "..." + "b" * 5
    import hashlib
    assert out[0].h == hashlib.sha256(("salt:" + "a" * 16).encode()).hexdigest()


def test_normal_p_and_ks_p(spark):
    df = spark.createDataFrame([(0.0,), (1.959964,), (-3.0,)], "z double")
    ps = [r.p for r in df.select(normal_two_sided_p(F.col("z")).alias("p")).collect()]
    assert abs(ps[0] - 1.0) < 1e-6
    assert abs(ps[1] - 0.05) < 1e-5
    assert abs(ps[2] - math.erfc(3 / math.sqrt(2))) < 1e-6
    k = spark.createDataFrame([(0.0, 100.0, 100.0), (0.5, 100.0, 100.0)], "d double, a double, b double")
    kp = [r.p for r in k.select(kolmogorov_p(F.col("d"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert kp[0] == 1.0 and kp[1] < 1e-6


def test_rule_baseline_and_actions(spark):
    df = spark.createDataFrame([(50.0, 30.0, 2.0), (80.0, 90.0, 8.0), (0.0, 0.0, 0.0)],
                               "attendance_rate double, quiz_average double, financial_aid_status double")
    out = SC.recommended_actions(SC.rule_baseline(df)).collect()
    assert out[0].rule_pred == 1 and out[0].rule_prob >= 0.5
    assert out[1].rule_pred == 0 and out[1].rule_prob <= 0.49
    assert out[1].actions == [K.ACTION_TEXTS[3]]
    assert len(out[2].actions) == 3  # 0 is a value, not "missing"


def test_message_truncation(spark):
    df = spark.createDataFrame([("x" * 160,), ("y" * 161,)], "m string")
    out = [r.t for r in df.select(EX.truncate_message(F.col("m")).alias("t")).collect()]
    assert out[0] == "x" * 160
    assert len(out[1]) == 160 and out[1].endswith("...")
