"""Shared builders for registered queries: Spark frames and matching SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fround
from ..operators import features as FE
from ..operators import scoring as SC
from ..sources import cohort
from ..sources.tables import read_table
from . import sqlbits as S

# Demo salt of the registered queries (a real deployment passes its own secret).
SALT = "cohort-demo-salt"
# "Now" of the registered queries is the second of the newest event, never the wall clock.
AS_OF_SQL = "(SELECT date_trunc('second', max(ts)) FROM events)"


def as_of(spark: SparkSession, sf_dir: str) -> str:
    """Time of the newest event, as text (one value reaches the driver)."""
    newest = F.date_trunc("second", F.max(F.col("ts").cast("timestamp")))
    row = read_table(spark, sf_dir, "events", ["ts"]).agg(F.date_format(newest, "yyyy-MM-dd HH:mm:ss")).first()
    return row[0] or "1970-01-01 00:00:00"


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    assessments, words = FE.numbered(cohort.assessments(spark, sf_dir))
    profile = cohort.student_profile(spark, sf_dir, assessments, words)
    return FE.build_feature_table(profile, cohort.student_vle(spark, sf_dir), assessments)


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.students_table(feature_table(spark, sf_dir), SALT)


def two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(student_id, label, score_a, score_b): the two-scorer test set."""
    f = feature_table(spark, sf_dir)
    return f.select(
        F.col("student_key").alias("student_id"), F.col("dropout_label").alias("label"),
        fround(SC.SCORER_A.probability(), 4).alias("score_a"),
        fround(SC.SCORER_B.probability(), 4).alias("score_b"))


# --- SQL side -----------------------------------------------------------------------------
def sql_margin(scorer: SC.LinearScorer) -> str:
    z = f"{scorer.intercept}::DOUBLE"
    for f_, c in scorer.coefs.items():
        z = f"({z} + {c}::DOUBLE * {f_})"
    return z


def sql_prob(scorer: SC.LinearScorer) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_margin(scorer)}))))"


STUDENTS = f"""
students AS (
  SELECT student_key AS student_id, sha256('{SALT}:' || student_key) AS anon_id,
         {', '.join(K.BASE_FEATURES)}, dropout_label,
         {S.R('p', 4)} AS risk_score, {S.BAND('p')} AS risk_band, {S.BAND('p')} = 'HIGH' AS is_flagged
  FROM (SELECT *, {sql_prob(SC.SCORER_A)} AS p FROM features))"""

TWO_SCORES = f"""
two_scores AS (
  SELECT student_key AS student_id, dropout_label AS label,
         {S.R(sql_prob(SC.SCORER_A), 4)} AS score_a, {S.R(sql_prob(SC.SCORER_B), 4)} AS score_b
  FROM features)"""

STUDENT_CTES = [S.BINDING, S.FEATURES, STUDENTS]
SCORE_CTES = [S.BINDING, S.FEATURES, TWO_SCORES]


def sql(*ctes: str, select: str) -> str:
    return S.with_ctes(*ctes) + "\n" + select
