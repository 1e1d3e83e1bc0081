"""Scoring: fixed-coefficient scorers, risk bands, rule baseline, actions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import clip, col_, fround, hash_id, heat_band, risk_band


@dataclass(frozen=True)
class LinearScorer:
    """A logistic scorer with fixed coefficients on raw feature values.

    Used as the deterministic scorer of the oracle-checked jobs (the trained
    Spark ML models are in ``training``). ``means`` are reference feature
    values for the closed-form attribution ``coef * (x - mean)``.
    """

    name: str
    intercept: float
    coefs: dict[str, float] = field(default_factory=dict)

    def margin(self) -> Column:
        z = F.lit(self.intercept)
        for f_, c in self.coefs.items():
            z = z + F.lit(c) * F.col(f_)
        return z

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))


# Two scorers of different coefficients (ours; used to exercise comparison
# statistics such as DeLong on a realistic pair of correlated models).
SCORER_A = LinearScorer("fixed_a", 4.5, {
    "quiz_average": -0.09, "attendance_rate": -0.01, "assignment_submission_rate": -0.01,
    "mobile_engagement_freq": -0.005, "financial_aid_status": -0.03})
SCORER_B = LinearScorer("fixed_b", 3.0, {
    "quiz_average": -0.06, "attendance_rate": -0.015, "assignment_submission_rate": -0.005})


def score(df: DataFrame, scorer: LinearScorer = SCORER_A, tau: float = K.TAU,
          out: str = "risk_score") -> DataFrame:
    """M9 (fixed): probability -> band from the unrounded value -> round 4."""
    p = scorer.probability()
    return (df.withColumn("_p", p)
              .withColumn("risk_band", risk_band("_p", tau))
              .withColumn(out, fround(F.col("_p"), 4))
              .drop("_p"))


def students_table(features: DataFrame, salt: str, scorer: LinearScorer = SCORER_A,
                   tau: float = K.TAU) -> DataFrame:
    """The ``students`` state table: anonymised id, features, label, score, band, flag.

    ``student_id`` is the raw key of the state tables; ``anon_id``, its salted hash
    (F1), is what leaves them.
    """
    s = score(features.fillna(0.0, subset=[c for c in K.BASE_FEATURES if c in features.columns]),
              scorer, tau)
    return s.select(
        F.col("student_key").alias("student_id"),
        hash_id("student_key", salt).alias("anon_id"),
        *K.BASE_FEATURES, "dropout_label", "risk_score", "risk_band",
        (F.col("risk_band") == "HIGH").alias("is_flagged"))


def rule_baseline(df: DataFrame, att_threshold: float = K.RULE_ATTENDANCE,
                  quiz_threshold: float = K.RULE_QUIZ) -> DataFrame:
    """Rule flag (attendance < 60 and quiz < 40) + pseudo-probability.

    Shortfalls ``clip((t - x) / t, 0, 1)`` of attendance and quiz are averaged;
    flagged rows get at least 0.5, the others at most 0.49.
    """
    att_short = clip((F.lit(att_threshold) - F.col("attendance_rate")) / F.lit(att_threshold), 0, 1)
    quiz_short = clip((F.lit(quiz_threshold) - F.col("quiz_average")) / F.lit(quiz_threshold), 0, 1)
    raw = clip((att_short + quiz_short) / 2, 0, 1)
    flagged = (F.col("attendance_rate") < att_threshold) & (F.col("quiz_average") < quiz_threshold)
    prob = F.when(flagged, F.greatest(raw, F.lit(0.5))).otherwise(F.least(raw, F.lit(0.49)))
    return df.withColumn("rule_pred", flagged.cast("int")).withColumn("rule_prob", prob)


def band_rules(score_col: str | Column = "risk_score", band_col: str = "risk_band") -> list[Column]:
    """P15/P16 + cohort rule: the three band rules side by side."""
    s = col_(score_col)
    return [
        risk_band(s).alias("risk_band_rule"),
        F.coalesce(F.col(band_col), heat_band(s)).alias("heat_band") if band_col else heat_band(s).alias("heat_band"),
        F.when(s >= K.CRITICAL_COHORT, "critical").when(s >= K.TAU, "at_risk").otherwise("ok").alias("cohort_rule"),
    ]


def recommended_actions(df: DataFrame) -> DataFrame:
    """P20: array of fired actions; the 'monitor' text when none fires.

    Rules: attendance < 60, quiz < 40, financial aid < 4. A missing (null)
    value fires nothing; 0 is a real value (the original treated 0 as missing).
    """
    rules = [
        (F.col("attendance_rate") < 60, K.ACTION_TEXTS[0]),
        (F.col("quiz_average") < 40, K.ACTION_TEXTS[1]),
        (F.col("financial_aid_status") < 4, K.ACTION_TEXTS[2]),
    ]
    fired = F.filter(F.array(*[F.when(c, F.lit(a)) for c, a in rules]), lambda x: x.isNotNull())
    acts = F.when(F.size(fired) == 0, F.array(F.lit(K.ACTION_TEXTS[3]))).otherwise(fired)
    return df.withColumn("actions", acts)


def beeswarm_value(raw: str | Column) -> Column:
    """clip(raw / 100, 0, 1); 0.5 when missing."""
    return F.coalesce(clip(col_(raw) / 100, 0, 1), F.lit(0.5))
