"""State-table maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import clip, fround, hash_id
from ..operators import scoring as SC
from ..operators import state as ST
from ..sources import cohort
from . import base as B
from . import sqlbits as S
from .registry import register

R = S.R
FEATS = K.BASE_FEATURES


def _upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload rows cleaned like an ingest (P3: clip percentages, non-negative)."""
    u = cohort.event_upload(spark, sf_dir)
    return (u.withColumn("attendance_rate", clip("attendance_rate", 0, 100))
             .withColumn("mobile_engagement_freq", clip("mobile_engagement_freq", 0, None)))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = B.students(spark, sf_dir)
    return st.select("student_id", *FEATS, "dropout_label", F.lit(None).cast("string").alias("phone_number"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.upsert(_current(spark, sf_dir), _upload(spark, sf_dir), "student_id", FEATS,
                     ["dropout_label", "phone_number"], [F.col("uploaded_at"), F.col("event_id")])


UPLOAD_SQL = f"""
inc AS (
  SELECT CAST(user_id AS VARCHAR) || '_M' || CAST(event_id % 5 AS VARCHAR) || '_P1' AS student_id,
         {S.CLIP('value / 4.9', 0, 100)} AS attendance_rate,
         {S.CLIP("TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)", 0, None)} AS mobile_engagement_freq,
         (CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'purchase' THEN 0 END)::INTEGER AS dropout_label,
         CASE WHEN event_type = 'signup' THEN '+44' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS phone_number
  FROM events
  QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY ts DESC, event_id DESC) = 1),
merged AS (
  SELECT coalesce(c.student_id, n.student_id) AS student_id,
    {', '.join(
        f"CASE WHEN c.student_id IS NOT NULL THEN coalesce(n.{f}, c.{f}) ELSE coalesce(n.{f}, 0.0) END AS {f}"
        if f in ('attendance_rate', 'mobile_engagement_freq') else
        f"CASE WHEN c.student_id IS NOT NULL THEN c.{f} ELSE 0.0 END AS {f}" for f in FEATS)},
    coalesce(n.dropout_label, c.dropout_label) AS dropout_label,
    coalesce(n.phone_number, NULL::VARCHAR) AS phone_number,
    CASE WHEN c.student_id IS NOT NULL AND n.student_id IS NOT NULL THEN 'update'
         WHEN n.student_id IS NOT NULL THEN 'insert' ELSE 'keep' END AS _action
  FROM students c FULL OUTER JOIN inc n ON c.student_id = n.student_id)"""


@register("upsert_students", B.sql(*B.STUDENT_CTES, UPLOAD_SQL, select="SELECT * FROM merged"))
def q_upsert_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6+P3: upload batch merged into the students table (dedupe, update, insert)."""
    return merged(spark, sf_dir)


@register("load_summary", B.sql(*B.STUDENT_CTES, UPLOAD_SQL, select=f"""
SELECT count_if(_action = 'insert') AS inserted, count_if(_action = 'update') AS updated,
       count_if(_action = 'keep') AS unchanged,
       count_if(_action IN ('insert', 'update') AND risk_score IS NOT NULL) AS scored, count(*) AS total_rows
FROM (SELECT *, {R(B.sql_prob(SC.SCORER_A), 4)} AS risk_score FROM merged)"""))
def q_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20+M12: merge summary; upserted rows are re-scored (inserted, updated, scored, total)."""
    m = SC.score(merged(spark, sf_dir))
    return ST.load_summary(m).drop("warnings")  # those are in upload_checks


@register("score_upserted", B.sql(*B.STUDENT_CTES, UPLOAD_SQL, select=f"""
SELECT student_id, {R(B.sql_prob(SC.SCORER_A), 4)} AS risk_score, {S.BAND(B.sql_prob(SC.SCORER_A))} AS risk_band
FROM merged WHERE student_id IN (SELECT student_id FROM inc)"""))
def q_score_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7+M12: score only the just-upserted keys (left-semi join)."""
    m = ST.members(merged(spark, sf_dir), _upload(spark, sf_dir), "student_id")
    return SC.score(m).select("student_id", "risk_score", "risk_band")


@register("duplicate_guard", B.sql(*B.STUDENT_CTES, UPLOAD_SQL, select="""
SELECT student_id, CASE WHEN student_id IN (SELECT student_id FROM students) THEN 'rejected' ELSE 'accepted' END AS decision
FROM (SELECT DISTINCT student_id FROM inc)"""))
def q_duplicate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-entity inserts accepted, or rejected as duplicates."""
    inc = _upload(spark, sf_dir).select("student_id").distinct()
    return ST.duplicate_guard(B.students(spark, sf_dir), inc, "student_id")


@register("referential_check", B.sql(S.ALERTS, select=f"""
SELECT a.id, a.student_id, sha256('{B.SALT}:' || CAST(a.student_id AS VARCHAR)) AS anon_id, 'ok' AS status
FROM alerts_b a JOIN customer c ON a.student_id = c.c_custkey
UNION ALL
SELECT a.id, a.student_id, NULL AS anon_id, 'orphan' AS status
FROM alerts_b a WHERE a.student_id NOT IN (SELECT c_custkey FROM customer)"""))
def q_referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9+F1: alerts with the parent's anon id, orphans marked."""
    persons = cohort.persons(spark, sf_dir).withColumn("anon_id", hash_id("student_id", B.SALT))
    al = cohort.alerts(spark, sf_dir).select("id", "student_id")
    return ST.referential_check(al, persons, "student_id", "student_id", ["anon_id"]).select(
        "id", "student_id", "anon_id", "status")


@register("latest_prediction", B.sql(S.HISTORY, select=f"""
SELECT c.c_custkey AS entity_id, coalesce(h.risk_score, 0.0) AS risk_score,
       coalesce(h.risk_band, 'LOW') AS risk_band, coalesce(h.model_version, 'v1') AS model_version,
       h.risk_score IS NULL AS _inserted
FROM customer c LEFT JOIN (
  SELECT entity_id, arg_max(risk_score, ts) AS risk_score, {S.BAND('arg_max(risk_score, ts)')} AS risk_band,
         'v1' AS model_version
  FROM history_b GROUP BY entity_id) h ON c.c_custkey = h.entity_id"""))
def q_latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10+W3: newest prediction per person, or a default row (0.0, LOW, v1) when none."""
    log = cohort.risk_history(spark, sf_dir).withColumn("risk_band", SC.risk_band(F.col("risk_score"))) \
        .withColumn("model_version", F.lit("v1"))
    ent = cohort.persons(spark, sf_dir).withColumnRenamed("student_id", "entity_id")
    out = ST.latest_with_default(ent, log, "entity_id", "ts", ["risk_score", "risk_band", "model_version"],
                                 {"risk_score": F.lit(0.0), "risk_band": F.lit("LOW"), "model_version": F.lit("v1")})
    return out.drop("ts")


@register("feedback_relabel", B.sql(*S.FEATURE_CTES, S.INTERVENTIONS, select="""
SELECT metric, value FROM (
  SELECT count(*)::BIGINT AS rows,
         count_if(coalesce(succ = 1 AND f.dropout_label = 1, false))::BIGINT AS labels_overridden,
         count_if(succ = 1)::BIGINT AS rows_with_success,
         count_if(n_unsucc > 0)::BIGINT AS rows_with_unsuccessful
  FROM features f LEFT JOIN (
    SELECT student_id, max(CASE WHEN outcome = 'SUCCESSFUL' THEN 1 ELSE 0 END) AS succ,
           count_if(outcome = 'UNSUCCESSFUL') AS n_unsucc
    FROM interventions_b WHERE student_id IS NOT NULL AND student_id <> 0 GROUP BY student_id) p
  ON f.student_id_orig = p.student_id)
UNPIVOT (value FOR metric IN (rows, labels_overridden, rows_with_success, rows_with_unsuccessful))
UNION ALL
SELECT 'pending_outcomes', count_if(outcome IS NULL OR outcome NOT IN ('SUCCESSFUL', 'UNSUCCESSFUL'))::BIGINT
FROM interventions_b WHERE student_id IS NOT NULL AND student_id <> 0"""))
def q_feedback_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervention outcomes fed back into labels (SUCCESSFUL -> 0) with stats."""
    _, stats = ST.feedback_labels(B.feature_table(spark, sf_dir), cohort.interventions(spark, sf_dir),
                                  "student_id_orig", "student_id")
    return stats


@register("entity_360", B.sql(S.HISTORY, S.INTERVENTIONS, select=f"""
SELECT c.c_custkey AS student_id, c.c_nationkey AS region_code, c.c_mktsegment AS programme,
       p.n_predictions, p.latest_score, strftime(p.latest_ts, '%Y-%m-%d') AS latest_ts,
       i.n_interventions, i.n_successful, i.latest_intervention_type, pl.predictions, il.interventions,
       {R('e.v', 4)} AS explained_value
FROM customer c
LEFT JOIN (SELECT entity_id, count(*) AS n_predictions, arg_max(risk_score, ts) AS latest_score, max(ts) AS latest_ts
           FROM history_b GROUP BY entity_id) p ON c.c_custkey = p.entity_id
LEFT JOIN (SELECT student_id, count(*) AS n_interventions, count_if(coalesce(outcome = 'SUCCESSFUL', false)) AS n_successful,
                  arg_max(intervention_type, (created_at, id)) AS latest_intervention_type
           FROM interventions_b GROUP BY student_id) i ON c.c_custkey = i.student_id
LEFT JOIN (SELECT entity_id, string_agg(strftime(ts, '%Y-%m-%d') || '=' || printf('%.4f', risk_score), ';' ORDER BY ts DESC) AS predictions
           FROM (SELECT * FROM history_b QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) <= 5)
           GROUP BY entity_id) pl ON c.c_custkey = pl.entity_id
LEFT JOIN (SELECT student_id, string_agg(id || ' ' || intervention_type || ' ' || status, ';' ORDER BY created_at DESC, id DESC) AS interventions
           FROM (SELECT * FROM interventions_b QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY created_at DESC, id DESC) <= 5)
           GROUP BY student_id) il ON c.c_custkey = il.student_id
LEFT JOIN (SELECT entity_id, arg_max(risk_score, ts) AS v FROM history_b WHERE week(ts) % 2 = 0 GROUP BY entity_id) e
       ON c.c_custkey = e.entity_id"""))
def q_entity_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13+F15: person, latest prediction and its explanation (here: even weeks have one), the
    newest five predictions and interventions as lists, counts."""
    item = F.array(F.struct(F.lit("attendance_rate").alias("feature"), F.col("risk_score").alias("value"), F.lit(0.1).alias("contribution")))
    preds = (cohort.risk_history(spark, sf_dir).withColumnRenamed("entity_id", "student_id")
                   .withColumn("explanation", F.when(F.weekofyear("ts") % 2 == 0, F.to_json(item))))
    out = ST.entity_360(cohort.persons(spark, sf_dir), preds, cohort.interventions(spark, sf_dir), "student_id", 5)
    shown = lambda c, fn: F.array_join(F.transform(c, fn), ";").alias(c)
    return out.select(
        "student_id", "region_code", "programme", "n_predictions", "latest_score", F.date_format("latest_ts", "yyyy-MM-dd").alias("latest_ts"),
        "n_interventions", "n_successful", "latest_intervention_type",
        shown("predictions", lambda p: F.concat(F.date_format(p["ts"], "yyyy-MM-dd"), F.lit("="), F.format_string("%.4f", p["risk_score"]))),
        shown("interventions", lambda i: F.concat_ws(" ", i["id"].cast("string"), i["intervention_type"], i["status"])),
        fround(F.col("explanation")[0]["value"], 4).alias("explained_value"))


@register("intervention_update", B.sql(S.INTERVENTIONS, select=f"""
SELECT id, CASE WHEN status = 'SENT' AND outcome = 'SUCCESSFUL' THEN 'COMPLETED' ELSE status END AS status, outcome,
       CASE WHEN status = 'SENT' AND outcome = 'SUCCESSFUL' THEN strftime({B.AS_OF_SQL}, '%Y-%m-%d %H:%M:%S') END AS completed_at
FROM interventions_b"""))
def q_intervention_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse change rows (SENT + SUCCESSFUL -> COMPLETED) applied; completed_at stamped."""
    iv = cohort.interventions(spark, sf_dir)
    changes = iv.where((F.col("status") == "SENT") & (F.col("outcome") == "SUCCESSFUL")).select(
        "id", F.lit("COMPLETED").alias("status"), F.lit(None).cast("string").alias("outcome"))
    out = ST.partial_update(iv, changes, "id", ["status", "outcome"], B.as_of(spark, sf_dir))
    return out.select("id", "status", "outcome", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@register("alert_housekeeping", B.sql(S.ALERTS, select="""
SELECT id, student_id, alert_type, (is_read OR alert_type = 'RISK_CHANGE' OR is_dismissed) AS is_read, is_dismissed
FROM alerts_b WHERE student_id IN (SELECT c_custkey FROM customer)"""))
def q_alert_housekeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16+J17: delete orphan alerts, mark RISK_CHANGE read; dismissed implies read."""
    kept = ST.delete_orphans(cohort.alerts(spark, sf_dir), cohort.persons(spark, sf_dir), "student_id", "student_id")
    return ST.mark_read(kept, F.col("alert_type") == "RISK_CHANGE").select(
        "id", "student_id", "alert_type", "is_read", "is_dismissed")


@register("batch_writeback", B.sql(*B.STUDENT_CTES, select=f"""
SELECT student_id, {R(B.sql_prob(SC.SCORER_B), 4)} AS risk_score, {S.BAND(B.sql_prob(SC.SCORER_B))} AS risk_band,
       {S.BAND(B.sql_prob(SC.SCORER_B))} = 'HIGH' AS is_flagged, is_flagged AS was_flagged
FROM students"""))
def q_batch_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-score with a new model, write score/band/flag back by key (+ log rows)."""
    st = B.students(spark, sf_dir)
    rescored = SC.score(st.drop("risk_score", "risk_band"), SC.SCORER_B)
    new, _log = ST.scored_writeback(st.withColumn("was_flagged", F.col("is_flagged")), rescored, "student_id",
                                    B.as_of(spark, sf_dir), "fixed_b")
    return new.select("student_id", "risk_score", "risk_band", "is_flagged", "was_flagged")

