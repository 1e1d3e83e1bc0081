"""DuckDB SQL fragments for the independent oracle of each registered query.

These are written from the operator definitions, in SQL, and never call the
Spark code: the pair (Spark plan, SQL text) is compared by the driver.
"""

from __future__ import annotations

from .. import constants as K
from ..sources.cohort import IMD_DECILES, OUTCOME_BY_PRIORITY, STATUS_BY_ORDERSTATUS

TAU = K.TAU


def R(expr: str, d: int) -> str:
    """Round half up exactly like ``functions.columns.fround``."""
    s = f"{10 ** d}.0::DOUBLE"
    return f"(floor(({expr}) * {s} + 0.5::DOUBLE) / {s})"


def CLIP(expr: str, lo: float | None, hi: float | None) -> str:
    e = f"({expr})"
    out = e
    if hi is not None:
        out = f"least({out}, {float(hi)}::DOUBLE)"
    if lo is not None:
        out = f"greatest({out}, {float(lo)}::DOUBLE)"
    return f"(CASE WHEN {e} IS NULL THEN NULL ELSE {out} END)"


def BAND(score: str, tau: float = TAU) -> str:
    return (f"(CASE WHEN {score} IS NULL THEN NULL WHEN {score} >= {tau}::DOUBLE THEN 'HIGH' "
            f"WHEN {score} >= {tau * K.MEDIUM_FACTOR}::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END)")


def CASEMAP(expr: str, mapping: dict, default: str = "NULL", quote_values: bool = True) -> str:
    parts = []
    for k, v in mapping.items():
        val = f"'{v}'" if (quote_values and isinstance(v, str)) else str(v)
        parts.append(f"WHEN '{k}' THEN {val}")
    return f"(CASE {expr} {' '.join(parts)} ELSE {default} END)"


# --- cohort binding (FIXTURES.md section 3) -------------------------------------------
BINDING = f"""
assessments_b AS (
  SELECT id_assessment, 'M' || CAST(id_assessment % 5 AS VARCHAR) AS code_module,
         'P1' AS code_presentation, CAST(1 + id_assessment % 4 AS VARCHAR) AS weight
  FROM (SELECT DISTINCT p_partkey % 50 AS id_assessment FROM part)),
lo_b AS (
  SELECT l.l_partkey, l.l_linenumber, l.l_quantity, l.l_returnflag, o.o_custkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
student_assessment AS (
  SELECT l_partkey % 50 AS id_assessment, o_custkey AS id_student,
         CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN '?'
              ELSE CAST(l_quantity * 2 AS VARCHAR) END AS score
  FROM lo_b),
student_vle AS (
  SELECT user_id AS id_student, 'M' || CAST(event_id % 5 AS VARCHAR) AS code_module,
         'P1' AS code_presentation,
         event_type || '-' || json_extract_string(props, '$.k') AS id_site, value AS sum_click
  FROM events),
student_info AS (
  SELECT g.id_student, g.code_module, 'P1' AS code_presentation,
         (CASE least(floor((c.c_acctbal + 1000) / 1100), 9)::INTEGER
            {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(IMD_DECILES))} END) AS imd_band,
         CASE WHEN avg_q < 22 THEN 'Withdrawn' WHEN avg_q < 24 THEN 'Fail'
              WHEN avg_q < 30 THEN 'Pass' ELSE 'Distinction' END AS final_result
  FROM (SELECT o_custkey AS id_student, 'M' || CAST((l_partkey % 50) % 5 AS VARCHAR) AS code_module,
               avg(l_quantity) AS avg_q
        FROM lo_b GROUP BY 1, 2) g
  LEFT JOIN customer c ON g.id_student = c.c_custkey)"""

HISTORY = f"""
history_b AS (
  SELECT user_id AS entity_id, date_trunc('week', ts) AS ts,
         {R("least(avg(value) / 250.0::DOUBLE, 1.0::DOUBLE)", 4)} AS risk_score
  FROM events GROUP BY 1, 2)"""

INTERVENTIONS = f"""
interventions_b AS (
  SELECT o_orderkey AS id, o_custkey AS student_id,
         list_extract(['SMS', 'EMAIL', 'COUNSELLING', 'TUTORING', 'OTHER'], (o_orderkey % 5 + 1)::INTEGER) AS intervention_type,
         {CASEMAP('o_orderstatus', STATUS_BY_ORDERSTATUS)} AS status,
         {CASEMAP('o_orderpriority', OUTCOME_BY_PRIORITY)} AS outcome,
         o_orderdate AS created_at
  FROM orders)"""

ALERTS = """
alerts_b AS (
  SELECT event_id AS id, user_id AS student_id,
         CASE WHEN value >= 250 THEN 'HIGH_RISK' ELSE 'RISK_CHANGE' END AS alert_type,
         event_id % 3 = 0 AS is_read, event_id % 7 = 0 AS is_dismissed, ts AS created_at
  FROM events WHERE event_type = 'error')"""


def _pct_rank(value: str) -> str:
    return (f"((rank() OVER (ORDER BY {value}) - 1) + (count(*) OVER (PARTITION BY {value}) + 1) / 2.0::DOUBLE)"
            f" / count(*) OVER ()")


KEYS = "id_student, code_module, code_presentation"

FEATURES = f"""
att_b AS (
  SELECT {KEYS}, {R(CLIP(_pct_rank('total_clicks') + ' * 100.0::DOUBLE', 0, 100), 2)} AS attendance_rate
  FROM (SELECT {KEYS}, {R('sum(sum_click)', 6)} AS total_clicks FROM student_vle GROUP BY ALL)),
eng_b AS (
  SELECT {KEYS}, {R(CLIP(_pct_rank('n_sites') + ' * 100.0::DOUBLE', 0, 100), 2)} AS mobile_engagement_freq
  FROM (SELECT {KEYS}, count(DISTINCT id_site) AS n_sites FROM student_vle GROUP BY ALL)),
assessed_b AS (
  SELECT sa.id_assessment, sa.id_student, a.code_module, a.code_presentation,
         TRY_CAST(sa.score AS DOUBLE) AS score, coalesce(TRY_CAST(a.weight AS DOUBLE), 1.0::DOUBLE) AS weight
  FROM student_assessment sa LEFT JOIN assessments_b a USING (id_assessment)),
quiz_b AS (
  SELECT {KEYS},
         {R(CLIP('coalesce(sum(score * weight), 0.0::DOUBLE) / nullif(sum(weight), 0.0::DOUBLE)', 0, 100), 2)} AS quiz_average
  FROM assessed_b GROUP BY ALL),
module_counts_b AS (
  SELECT code_module, code_presentation, count(DISTINCT id_assessment) AS total_assessments
  FROM assessments_b GROUP BY ALL),
submitted_b AS (
  SELECT {KEYS}, count(DISTINCT id_assessment) AS submitted_assessments
  FROM assessed_b WHERE score IS NOT NULL GROUP BY ALL),
subm_b AS (
  SELECT i.id_student, i.code_module, i.code_presentation,
         {R(CLIP('coalesce(s.submitted_assessments, 0)::DOUBLE / coalesce(nullif(m.total_assessments, 0), 1)::DOUBLE * 100.0::DOUBLE', 0, 100), 2)} AS assignment_submission_rate
  FROM student_info i
  LEFT JOIN module_counts_b m ON i.code_module = m.code_module AND i.code_presentation = m.code_presentation
  LEFT JOIN submitted_b s ON i.id_student = s.id_student AND i.code_module = s.code_module
                         AND i.code_presentation = s.code_presentation),
merged_b AS (
  SELECT i.id_student, i.code_module, i.code_presentation,
         coalesce({CASEMAP('i.imd_band', K.IMD_MAP)}, 5)::DOUBLE AS financial_aid_status,
         coalesce({CASEMAP('i.final_result', K.RESULT_LABEL)}, 0)::INTEGER AS dropout_label,
         att.attendance_rate, q.quiz_average, s.assignment_submission_rate, e.mobile_engagement_freq
  FROM student_info i
  LEFT JOIN att_b att USING ({KEYS})
  LEFT JOIN quiz_b q USING ({KEYS})
  LEFT JOIN subm_b s USING ({KEYS})
  LEFT JOIN eng_b e USING ({KEYS})),
med_b AS (
  SELECT median(attendance_rate) AS m_att, median(quiz_average) AS m_quiz,
         median(assignment_submission_rate) AS m_sub, median(mobile_engagement_freq) AS m_mob,
         median(financial_aid_status) AS m_aid
  FROM merged_b),
features AS (
  SELECT id_student || '_' || code_module || '_' || code_presentation AS student_key,
         id_student AS student_id_orig,
         coalesce(attendance_rate, m_att, 0.0)::DOUBLE AS attendance_rate,
         coalesce(quiz_average, m_quiz, 0.0)::DOUBLE AS quiz_average,
         coalesce(assignment_submission_rate, m_sub, 0.0)::DOUBLE AS assignment_submission_rate,
         coalesce(mobile_engagement_freq, m_mob, 0.0)::DOUBLE AS mobile_engagement_freq,
         coalesce(financial_aid_status, m_aid, 0.0)::DOUBLE AS financial_aid_status,
         dropout_label
  FROM merged_b, med_b
  QUALIFY row_number() OVER (PARTITION BY student_key ORDER BY dropout_label, financial_aid_status) = 1)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


FEATURE_CTES = [BINDING, FEATURES]


def split_final(text: str) -> tuple[str, str]:
    """Split ``cte, cte ... SELECT ...`` text at its last top-level SELECT line."""
    i = text.rfind("\nSELECT ")
    return text[:i], text[i + 1:]
