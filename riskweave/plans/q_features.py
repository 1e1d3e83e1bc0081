"""Feature pipeline queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fround
from ..operators import features as FE
from ..operators import logs as LG
from ..session import scratch_table_path
from ..sources import cohort
from . import base as B
from . import sqlbits as S
from .registry import register

R = S.R


@register("feature_table", S.with_ctes(*S.FEATURE_CTES) + " SELECT * FROM features")
def q_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2+J1-J5+A1-A6+W1+W2+P18+P19: source tables -> 5-feature table with label."""
    return B.feature_table(spark, sf_dir)


_API = "0.4::DOUBLE * attendance_rate + 0.4::DOUBLE * quiz_average + 0.2::DOUBLE * assignment_submission_rate"
_FARI = "(1 - financial_aid_status / 10.0::DOUBLE) * (1 - assignment_submission_rate / 100.0::DOUBLE)"


@register("engineered_features", B.sql(*S.FEATURE_CTES, select=f"""
SELECT student_key, {R(_API, 6)} AS academic_performance_index, {R(S.CLIP(_FARI, 0, 1), 6)} AS financial_academic_risk FROM features"""))
def q_engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4+P5: the two engineered features of every entity (round 6)."""
    e = FE.engineer(B.feature_table(spark, sf_dir))
    return e.select("student_key", *[fround(c, 6).alias(c) for c in ("academic_performance_index", "financial_academic_risk")])


@register("approx_distinct", B.sql(S.BINDING, select="""
SELECT code_module, count(DISTINCT id_student) AS n_students, count(DISTINCT id_site) AS n_sites,
       true AS students_within_bound, true AS sites_within_bound
FROM student_vle GROUP BY code_module"""))
def q_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 (opt-in): distinct students and sites per module from sketches stored upload by upload
    and merged, held against the exact counts with three standard errors."""
    vle, cols = cohort.student_vle(spark, sf_dir), ["id_student", "id_site"]
    root = scratch_table_path(spark, f"sketches-{uuid.uuid4().hex[:12]}")
    upload = F.pmod(F.xxhash64(*cols), F.lit(2))
    for i in (0, 1):
        LG.append(FE.distinct_sketches(vle.where(upload == i), ["code_module"], cols), root, f"upload-{i}")
    merged = FE.merge_sketches(spark.read.parquet(root), ["code_module"], cols)
    estimate = FE.sketch_counts(merged, ["code_module"], cols).select("code_module", *[F.col(c).alias(f"_{c}") for c in cols])
    exact = vle.groupBy("code_module").agg(F.count_distinct("id_student").alias("n_students"), F.count_distinct("id_site").alias("n_sites"))
    bound = 3 * FE.sketch_error()
    near = lambda est, n: F.abs(F.col(est) - F.col(n)) <= F.greatest(bound * F.col(n), F.lit(0.5))
    return exact.join(estimate, "code_module").select(
        "code_module", "n_students", "n_sites", near("_id_student", "n_students").alias("students_within_bound"),
        near("_id_site", "n_sites").alias("sites_within_bound"))
