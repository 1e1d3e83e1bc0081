"""Explanation, message and partial-dependence queries (M11, M13, M14, M20, M21,
L5, F10-F16, E21, P20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fround, risk_band
from ..operators import explain as EX
from ..operators import scoring as SC
from ..sources.tables import read_table
from . import base as B
from . import sqlbits as S
from .registry import register

R = S.R
SCORER = SC.SCORER_A
FEATS = list(SCORER.coefs)


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = B.students(spark, sf_dir)
    bg = EX.fit_background(st, SCORER)
    return EX.linear_attribution(st, SCORER, bg)


_LABEL_SQL = "(CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.FEATURE_LABELS.items()) + " END)"
ATTR_SQL = f"""
bg AS (SELECT {', '.join(f'avg({f}) AS m_{f}' for f in FEATS)} FROM students),
attr AS (
  SELECT s.student_id, s.anon_id, s.risk_score, s.risk_band, s.is_flagged, u.feature, u.value, u.contribution
  FROM students s, bg, LATERAL (VALUES {', '.join(f"('{f}', s.{f}::DOUBLE, {c}::DOUBLE * (s.{f} - bg.m_{f}))" for f, c in SCORER.coefs.items())}) u(feature, value, contribution)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY abs(contribution) DESC, feature) AS rank,
         {_LABEL_SQL} || ' (' || printf('%.1f', {R('value', 1)}) || ') ' ||
         CASE WHEN contribution > 0 THEN 'increasing risk' ELSE 'mitigating risk' END AS sentence
  FROM attr)"""


@register("linear_attribution", B.sql(*B.STUDENT_CTES, ATTR_SQL, select=f"""
SELECT student_id, feature, value, {R('contribution', 6)} AS contribution FROM attr"""))
def q_linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 (linear): exact per-row, per-feature contributions coef * (x - cohort mean)."""
    e = explained(spark, sf_dir)
    x = e.select("student_id", F.explode("explanation").alias("e"))
    return x.select("student_id", F.col("e.feature").alias("feature"), F.col("e.value").alias("value"),
                    fround(F.col("e.contribution"), 6).alias("contribution"))


@register("cohort_importance", B.sql(*B.STUDENT_CTES, ATTR_SQL, select=f"""
SELECT feature, {_LABEL_SQL} AS label, {R('avg(abs(contribution))', 6)} AS mean_abs_contribution, count(*) AS n
FROM attr GROUP BY feature"""))
def q_cohort_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14+F14+F15+F16: explanations stored as JSON text, decoded, exploded and ranked
    by mean absolute contribution."""
    e = EX.explanation_to_json(explained(spark, sf_dir))
    d = EX.explanation_from_json(e.select("student_id", "explanation_json"), "explanation_json")
    return EX.cohort_importance(EX.explode_explanation(d, ["student_id"]))


@register("top_factors", B.sql(*B.STUDENT_CTES, ATTR_SQL, select="""
SELECT student_id, rank, feature, sentence FROM ranked WHERE rank <= 3"""))
def q_top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5+F11+F20: top-3 factors per entity by |contribution| with their sentences."""
    e = explained(spark, sf_dir)
    t = e.select("student_id", F.posexplode(EX.top_factors(F.col("explanation"), 3)).alias("i", "item"))
    return t.select("student_id", (F.col("i") + 1).alias("rank"), F.col("item.feature").alias("feature"),
                    EX.factor_sentence(F.col("item")).alias("sentence"))


def _msg_sql() -> str:
    fs = "CASE WHEN f IS NULL THEN 'See dashboard' ELSE f END"
    msg = f"'EWS ALERT: Student ' || anon_id || ' flagged ' || risk_band || '. Key factors: ' || ({fs}) || '. Please contact within 5 days.'"
    return f"CASE WHEN length({msg}) > 160 THEN substr({msg}, 1, 157) || '...' ELSE {msg} END"


@register("counsellor_alerts", B.sql(*B.STUDENT_CTES, ATTR_SQL, select=f"""
SELECT student_id, {_msg_sql()} AS message, 'SMS_COUNSELLOR' AS alert_type
FROM (SELECT student_id, anon_id, risk_band, string_agg(sentence, '; ' ORDER BY rank) AS f
      FROM ranked WHERE rank <= 2 AND risk_band = 'HIGH' GROUP BY student_id, anon_id, risk_band)"""))
def q_counsellor_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M20+F12: counsellor alert text for HIGH entities (top-2 factors, 160 chars)."""
    e = explained(spark, sf_dir).where(F.col("risk_band") == "HIGH")
    sent = F.transform(EX.top_factors(F.col("explanation"), 2), EX.factor_sentence)
    return e.select("student_id", EX.counsellor_message(F.col("anon_id"), F.col("risk_band"), sent).alias("message"),
                    F.lit("SMS_COUNSELLOR").alias("alert_type"))


@register("nightly_alerts", B.sql(*B.STUDENT_CTES, ATTR_SQL, select=f"""
SELECT student_id, 'RISK_HIGH' AS alert_type,
       'Student ' || substr(anon_id, 1, 8) || '… has been flagged as HIGH risk (score: ' ||
       printf('%.2f%%', {R('risk_score * 100', 2)}) || '). Top factors: ' || f AS message
FROM (SELECT r.student_id, r.anon_id, r.risk_score, string_agg(r.sentence, ', ' ORDER BY r.rank) AS f
      FROM ranked r JOIN features x ON r.student_id = x.student_key
      WHERE r.rank <= 2 AND r.risk_band = 'HIGH' AND NOT coalesce({S.BAND(B.sql_prob(SC.SCORER_B).replace('quiz_average', 'x.quiz_average').replace('attendance_rate', 'x.attendance_rate').replace('assignment_submission_rate', 'x.assignment_submission_rate'))} = 'HIGH', false)
      GROUP BY r.student_id, r.anon_id, r.risk_score)"""))
def q_nightly_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11+W7+F13: nightly re-score; alerts for entities HIGH now and not flagged
    under the previous model, with the top-2 factors."""
    e = explained(spark, sf_dir)
    prev = B.feature_table(spark, sf_dir).select(
        F.col("student_key").alias("student_id"),
        (risk_band(SC.SCORER_B.probability()) == "HIGH").alias("is_flagged"))
    cur = e.drop("is_flagged")
    from ..operators.timeseries import newly_flagged
    nf = newly_flagged(cur, prev, "student_id", band="risk_band")
    sent = F.transform(EX.top_factors(F.col("explanation"), 2), EX.factor_sentence)
    return nf.select("student_id", F.lit("RISK_HIGH").alias("alert_type"),
                     EX.flagged_message(F.col("anon_id"), F.col("risk_score"), sent).alias("message"))


_ACT = [("attendance_rate < 60", K.ACTION_TEXTS[0]), ("quiz_average < 40", K.ACTION_TEXTS[1]),
        ("financial_aid_status < 4", K.ACTION_TEXTS[2])]
_ACT_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _ACT) + "], lambda a: a IS NOT NULL)"


@register("risk_brief", B.sql(*B.STUDENT_CTES, ATTR_SQL, select=f"""
SELECT s.student_id, {R('s.risk_score * 100', 1)} AS score_pct, s.risk_band, s.attendance_rate, s.quiz_average,
       s.assignment_submission_rate, t.top_factors,
       CASE WHEN len({_ACT_LIST}) = 0 THEN '{K.ACTION_TEXTS[3]}' ELSE array_to_string({_ACT_LIST}, ' | ') END AS actions
FROM students s JOIN (SELECT student_id, string_agg(sentence, ' | ' ORDER BY rank) AS top_factors
                      FROM ranked WHERE rank <= 3 GROUP BY student_id) t USING (student_id)"""))
def q_risk_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M21+P20+L5: one brief row per entity (score %, band, features, top-3 factors, actions)."""
    e = SC.recommended_actions(explained(spark, sf_dir))
    return EX.brief_rows(e, EX.top_factors(F.col("explanation"), 3), F.col("actions"))


def _pdp_sql() -> str:
    aggs = ", ".join(f"quantile_cont({f}, 0.02) AS {f}__lo, quantile_cont({f}, 0.98) AS {f}__hi, median({f}) AS {f}__med"
                     for f in FEATS)
    def gv(f: str) -> str:
        return f"(CASE WHEN i = 19 THEN {f}__hi ELSE {f}__lo + i * (({f}__hi - {f}__lo) / 19) END)"
    z = f"{SCORER.intercept}::DOUBLE"
    for f, c in SCORER.coefs.items():
        z = f"({z} + {c}::DOUBLE * (CASE WHEN feature = '{f}' THEN {gv(f)} ELSE {f}__med END))"
    val = "CASE " + " ".join(f"WHEN feature = '{f}' THEN {gv(f)}" for f in FEATS) + " END"
    cells = ", ".join(f"('{f}', {i})" for f in FEATS for i in range(20))
    return f"""
SELECT feature, i AS grid_index, {R(val, 4)} AS grid_value, {R(f'1.0 / (1.0 + exp(-({z})))', 4)} AS score
FROM (SELECT {aggs} FROM features), (VALUES {cells}) g(feature, i)"""


@register("partial_dependence", B.sql(*S.FEATURE_CTES, select=_pdp_sql()))
def q_partial_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E21+F22: 20-point grid between p2 and p98 per feature, others at medians, scored."""
    return EX.partial_dependence(B.feature_table(spark, sf_dir), SCORER)


@register("event_props", """
SELECT event_type, count(*) AS n, count(k) AS n_parsed, count(*) - count(k) AS n_malformed, (floor(avg(k) * 10000.0 + 0.5) / 10000.0) AS avg_k
FROM (SELECT event_type, TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS INTEGER) AS k
      FROM events) GROUP BY event_type""")
def q_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text column decoded with a schema; malformed rows keep a null."""
    ev = read_table(spark, sf_dir, "events", ["event_type", "props"])
    d = ev.withColumn("p", F.from_json("props", "k INT", {"mode": "PERMISSIVE"}))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("p.k").alias("n_parsed"),
                                       (F.count(F.lit(1)) - F.count("p.k")).alias("n_malformed"),
                                       fround(F.avg("p.k"), 4).alias("avg_k"))
