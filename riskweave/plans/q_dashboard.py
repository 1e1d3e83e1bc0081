"""Dashboard queries: summaries, distributions, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import percent
from ..operators import dashboard as D
from ..operators import evaluation as EV
from ..session import cut_lineage
from ..sources import cohort
from . import base as B
from . import sqlbits as S
from .registry import register

R, TAU = S.R, K.TAU


def sql_metrics(source: str, metrics: dict[str, str]) -> str:
    """One aggregate over ``source`` -> UNION ALL of (metric, value double)."""
    agg = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in metrics.items())
    parts = [f"SELECT '{n}' AS metric, {n} AS value FROM (SELECT {agg} FROM {source})" for n in metrics]
    return " UNION ALL ".join(parts)


def pct_sql(num: str, den: str, d: int) -> str:
    return R(f"({num})::DOUBLE / nullif(({den})::DOUBLE, 0.0::DOUBLE) * 100.0::DOUBLE", d)


ASOF = B.AS_OF_SQL
STUDENT_METRICS = {
    "total_students": "count(*)",
    "flagged_students": "count_if(is_flagged)",
    "labelled_students": "count_if(dropout_label IS NOT NULL)",
    "high_risk": "count_if(risk_band = 'HIGH')",
    "medium_risk": "count_if(risk_band = 'MEDIUM')",
    "low_risk": "count_if(risk_band = 'LOW')",
    "avg_risk_score": R("avg(risk_score)", 4),
    "dropout_rate_pct": pct_sql("sum(CASE WHEN dropout_label IS NOT NULL THEN dropout_label END)",
                                "count_if(dropout_label IS NOT NULL)", 2),
}
ALERT_METRICS = {
    "total_alerts": "count(*)",
    "unread_alerts": "count_if(NOT is_read)",
    "dismissed_alerts": "count_if(is_dismissed)",
    "alerts_last_24h": f"count_if(created_at >= {ASOF} - INTERVAL 24 HOURS AND created_at <= {ASOF})",
}
INTERVENTION_METRICS = {
    "total_interventions": "count(*)",
    "pending_interventions": "count_if(status = 'PENDING')",
    "conversion_rate_pct": pct_sql("count_if(status = 'COMPLETED')", "count(*)", 1),
    "positive_outcome_pct": pct_sql("count_if(outcome IS NOT NULL AND upper(outcome) IN ('SUCCESSFUL', 'POSITIVE'))",
                                    "count_if(outcome IS NOT NULL)", 1),
    "interventions_this_month": f"count_if(date_trunc('month', created_at) = date_trunc('month', {ASOF}))",
}


@register("dashboard_summary", B.sql(*B.STUDENT_CTES, S.ALERTS, S.INTERVENTIONS, select=" UNION ALL ".join([
    sql_metrics("students", STUDENT_METRICS), sql_metrics("alerts_b", ALERT_METRICS),
    sql_metrics("interventions_b", INTERVENTION_METRICS)])))
def q_dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7+A8+A9+A16+A17+A18+A19: operational summary as (metric, value)."""
    return D.operational_summary(B.students(spark, sf_dir), cohort.alerts(spark, sf_dir),
                                 cohort.interventions(spark, sf_dir), B.as_of(spark, sf_dir))


_FEAT_UNION = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM features" for f in K.BASE_FEATURES)


@register("feature_statistics", B.sql(*S.FEATURE_CTES, select=f"""
SELECT feature, {R('avg(v)', 2)} AS mean, {R('median(v)', 2)} AS median, {R('stddev_pop(v)', 2)} AS std,
       {R('min(v)', 2)} AS min, {R('max(v)', 2)} AS max
FROM ({_FEAT_UNION}) GROUP BY feature"""))
def q_feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: descriptive statistics per feature (unpivot + one group-by)."""
    return D.feature_statistics(B.feature_table(spark, sf_dir))


@register("band_distribution", B.sql(*B.STUDENT_CTES, select=f"""
SELECT risk_band, lower(risk_band) AS band_key,
       upper(substr(risk_band, 1, 1)) || lower(substr(risk_band, 2)) AS band_label,
       n, avg_score, {R('n::DOUBLE / sum(n) OVER () * 100.0::DOUBLE', 2)} AS share_pct
FROM (SELECT risk_band, count(*) AS n, {R('avg(risk_score)', 4)} AS avg_score
      FROM students WHERE risk_band IS NOT NULL GROUP BY risk_band)"""))
def q_band_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11+A12+F21: count, mean score and share per risk band."""
    return D.band_distribution(B.students(spark, sf_dir))


_COHORT_SQL = f"""
SELECT financial_aid_status, total, at_risk, critical, avg_score,
       coalesce({R('at_risk::DOUBLE / total::DOUBLE * 100.0::DOUBLE', 2)}, 0.0) AS at_risk_pct
FROM (SELECT financial_aid_status, count(*) AS total, count_if(risk_score >= {TAU}) AS at_risk,
             count_if(risk_score >= {K.CRITICAL_COHORT}) AS critical, {R('avg(risk_score)', 4)} AS avg_score
      FROM students GROUP BY financial_aid_status)"""


@register("cohort_comparison", B.sql(*B.STUDENT_CTES, select=_COHORT_SQL))
def q_cohort_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13+A21: conditional aggregates per cohort (financial aid level)."""
    return D.cohort_comparison(B.students(spark, sf_dir), "financial_aid_status")


SWEEP = [0.1, 0.2, 0.3, TAU, 0.5, 0.6, 0.7, 0.8, 0.9]
_SWEEP_SQL = f"""
SELECT tau, sum(CASE WHEN s >= tau THEN n ELSE 0 END)::BIGINT AS at_or_above, sum(n)::BIGINT AS total,
       {R('sum(CASE WHEN s >= tau THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE * 100.0::DOUBLE', 1)} AS pct
FROM (SELECT risk_score AS s, count(*) AS n FROM students GROUP BY risk_score),
     (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in SWEEP)}]) AS tau)
GROUP BY tau"""


@register("threshold_sweep", B.sql(*B.STUDENT_CTES, select=_SWEEP_SQL))
def q_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count at or above tau (validated 0..1) over a grid including 0.4432."""
    return D.threshold_sweep(B.students(spark, sf_dir), "risk_score", SWEEP)


_PAGE_SQL = f"""
SELECT student_id, anon_id, risk_score, risk_band
FROM students
WHERE risk_band = 'HIGH' AND is_flagged = true AND lower(student_id) LIKE '%' || lower('_M1') || '%'
ORDER BY coalesce(risk_score, 0) DESC, student_id
LIMIT 50 OFFSET 50"""


@register("student_page", B.sql(*B.STUDENT_CTES, select=_PAGE_SQL))
def q_student_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10+P11+L2+L3: filter by band and flag, search, sort by score desc, page 2 of 50."""
    st = B.students(spark, sf_dir)
    st = D.conjunctive_filter(st, risk_band="HIGH", is_flagged=True, intervention_type=None)
    st = D.search(st, "_M1", ["student_id"])
    pg = D.page(st, [D.user_sort(st, "risk_score", True), F.col("student_id").asc()], page_no=2, size=50)
    return pg.select("student_id", "anon_id", "risk_score", "risk_band")


@register("student_page_keyset", B.sql(*B.STUDENT_CTES, select=_PAGE_SQL))
def q_student_page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 (keyset): page 2 of the list by the cursor of page 1; equals the offset page."""
    st = D.search(D.conjunctive_filter(B.students(spark, sf_dir), risk_band="HIGH", is_flagged=True), "_M1", ["student_id"])
    st = cut_lineage(st.select("student_id", "anon_id", "risk_score", "risk_band"), "student-list")
    order = [("risk_score", True), ("student_id", False)]
    first = D.cursor(D.keyset_page(st, order), order)
    return D.keyset_page(st, order, after=first) if first else st.limit(0)


_PERSONS_SORTED_SQL = """
SELECT 'programme' AS sorted_by, position, student_id FROM (
  SELECT c_custkey AS student_id, row_number() OVER (ORDER BY lower(strip_accents(c_mktsegment)) DESC, c_custkey) AS position FROM customer)
WHERE position <= 500
UNION ALL SELECT 'region_code', position, student_id FROM (
  SELECT c_custkey AS student_id, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS position FROM customer)
WHERE position <= 500"""


@register("sorted_lists", B.sql("persons_b AS (SELECT 1)", select=_PERSONS_SORTED_SQL))
def q_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the person list by a user-chosen text column (locale order, descending) and by a
    number column, first page of 500 each, with positions."""
    people = cohort.persons(spark, sf_dir)
    parts = []
    for col, descending in (("programme", True), ("region_code", False)):
        pg = D.page(people, [D.user_sort(people, col, descending), F.col("student_id").asc()], 1, 500)
        own = Window.partitionBy(F.lit(1)).orderBy(D.user_sort(people, col, descending), F.col("student_id").asc())  # a page's rows
        parts.append(pg.select(F.lit(col).alias("sorted_by"), F.row_number().over(own).alias("position"), "student_id"))
    return D.union_all(parts)


@register("filtered_count", B.sql(*B.STUDENT_CTES, select="""
SELECT count(*) AS total FROM students WHERE risk_band = 'MEDIUM' AND dropout_label IS NOT NULL"""))
def q_filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22+P13: row count of a filtered list (for pagination)."""
    st = D.conjunctive_filter(B.students(spark, sf_dir), risk_band="MEDIUM")
    return D.with_total(st.where(F.col("dropout_label").isNotNull()))


_ALERT_LIST_SQL = """
SELECT id, student_id, alert_type, is_read, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM alerts_b WHERE is_read = false AND alert_type = 'HIGH_RISK'
ORDER BY created_at DESC, id DESC LIMIT 100"""


@register("alert_list", B.sql(S.ALERTS, select=_ALERT_LIST_SQL))
def q_alert_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1+L2+P10: unread HIGH_RISK alerts, newest first (id tie-break), first page of 100."""
    al = D.conjunctive_filter(cohort.alerts(spark, sf_dir), is_read=False, alert_type="HIGH_RISK")
    pg = D.page(al, [F.col("created_at").desc(), F.col("id").desc()], 1, 100)
    return pg.select("id", "student_id", "alert_type", "is_read",
                     F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


_PILOT_SQL = f"""
hist_p AS (
  SELECT score_a AS s, count_if(label = 1)::DOUBLE AS p, count_if(label = 0)::DOUBLE AS n FROM two_scores GROUP BY 1),
auc_p AS (
  SELECT sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc FROM (
    SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hist_p)),
actuals AS (
  SELECT 'auc_x100' AS metric, {R('auc', 3)} * 100.0::DOUBLE AS value FROM auc_p
  UNION ALL SELECT 'conversion_rate', {pct_sql("count_if(status = 'COMPLETED')", "count(*)", 1)} FROM interventions_b),
targets AS (SELECT * FROM (VALUES ('auc_x100', 80.0::DOUBLE), ('conversion_rate', 60.0::DOUBLE), ('usability_score', 70.0::DOUBLE)) t(metric, target))
SELECT t.metric, a.value, t.target,
       CASE WHEN a.value IS NULL THEN NULL WHEN a.value >= t.target THEN 'green'
            WHEN a.value >= t.target * 0.75 THEN 'amber' ELSE 'red' END AS status
FROM targets t LEFT JOIN actuals a USING (metric)"""


@register("pilot_targets", B.sql(*B.SCORE_CTES, S.INTERVENTIONS, S.split_final(_PILOT_SQL)[0],
                                 select=S.split_final(_PILOT_SQL)[1]))
def q_pilot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24+E3+A17: model AUC (x100), intervention conversion and counsellor usability (not
    measured here) against the pilot targets (green / amber / red)."""
    hist = EV.score_histogram(B.two_scores(spark, sf_dir), "score_a", "label")
    auc = EV.auc(hist).select(F.lit("auc_x100").alias("metric"), (D.fround(F.col("auc"), 3) * 100).alias("value"))
    done = F.count_if(F.col("status") == "COMPLETED")
    conversion = cohort.interventions(spark, sf_dir).agg(percent(done, F.count(F.lit(1)), 1).alias("value"))
    return D.pilot_targets(auc.unionByName(conversion.withColumn("metric", F.lit("conversion_rate"))))
