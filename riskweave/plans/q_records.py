"""Record validation, lookups, logs, histories and reports (P1, P7-P9, P12, P16, P21,
P23, F2, F17, F18, F25, S3, S5, S7, S8, S10, S11, T5, W9, J10, J12, E17, E22, E23, M10,
M11, M18, M20, U3, A20, A24)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fround, hash_id, mask_id, risk_band, surrogate_id
from ..operators import evaluation as EV
from ..operators import explain as EX
from ..operators import features as FE
from ..operators import logs as LG
from ..operators import monitoring as MO
from ..operators import scoring as SC
from ..operators import splits as SP
from ..operators import state as ST
from ..operators import timeseries as TS
from ..operators import training as TR
from ..operators import validation as VA
from ..session import cut_lineage, scratch_table_path
from ..sources import cohort
from ..sources import models as MS
from ..sources import uploads as U
from ..sources.tables import read_table
from . import base as B
from . import q_eval as QE
from . import q_explain as QX
from . import q_monitor as QM
from . import q_state as QS
from . import sqlbits as S
from .registry import register

R = S.R
FEATS = K.BASE_FEATURES


def _root(spark: SparkSession, name: str) -> str:
    return scratch_table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# --- records ------------------------------------------------------------------------------
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record batch in the schema of a manual entry: one record per event."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "ts", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("student_id"),
        (F.col("value") / 4 - 5).alias("attendance_rate"),
        F.when(F.col("event_type") != "error", F.col("value") / 5).alias("quiz_average"),
        (F.col("value") / 6).alias("assignment_submission_rate"),
        (k - 2).alias("mobile_engagement_freq"), k.alias("financial_aid_status"),
        F.upper("event_type").alias("intervention_type"),
        F.when(F.col("event_type") == "click", F.lit("+44").alias("x")).alias("phone_number"),
        F.when(F.col("event_type") == "purchase", F.col("user_id").cast("string")).alias("phone"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), "event_type")


RECORDS = """
records AS (
  SELECT event_id AS id, CASE WHEN event_type <> 'signup' THEN CAST(user_id AS VARCHAR) END AS student_id,
    value / 4 - 5 AS attendance_rate, CASE WHEN event_type <> 'error' THEN value / 5 END AS quiz_average,
    value / 6 AS assignment_submission_rate,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) - 2 AS mobile_engagement_freq,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS financial_aid_status,
    upper(event_type) AS intervention_type, CASE WHEN event_type = 'click' THEN '+44' END AS phone_number,
    CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) END AS phone, ts, event_type
  FROM events)"""


def _errors_sql() -> str:
    parts = []
    for f in FEATS:
        bad, text = (f"NOT ({f} BETWEEN 0 AND 100)", "outside 0..100") if f in K.PERCENT_FEATURES else (f"{f} < 0", "negative")
        parts.append(f"CASE WHEN {f} IS NULL THEN '{f} missing' WHEN {bad} THEN '{f} {text}' END")
    parts.append("CASE WHEN intervention_type NOT IN ('SMS', 'EMAIL', 'COUNSELLING', 'TUTORING', 'OTHER', 'CLICK', 'PURCHASE')"
                 " THEN 'intervention_type unknown: ' || intervention_type END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


TYPES = ["SMS", "EMAIL", "COUNSELLING", "TUTORING", "OTHER", "CLICK", "PURCHASE"]


@register("record_validation", B.sql(RECORDS, select=f"""
SELECT id, CASE WHEN len(e) = 0 THEN 'valid' ELSE 'rejected' END AS status, array_to_string(e, '; ') AS errors
FROM (SELECT id, {_errors_sql()} AS e FROM records)"""))
def q_record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8+P9: records split into valid and rejected ones with all their errors."""
    valid, rejected = VA.split_valid(VA.validate(records(spark, sf_dir), {"intervention_type": TYPES}))
    return (valid.select("id", F.lit("valid").alias("status"), F.lit("").alias("errors"))
            .unionByName(rejected.select("id", F.lit("rejected").alias("status"), F.array_join("errors", "; ").alias("errors"))))


@register("record_identity", B.sql(RECORDS, select=f"""
SELECT id, coalesce(phone_number, phone) AS contact, raw LIKE 'manual-%' AS surrogate,
       substr(h, 1, 8) || '...' || substr(h, -5) AS masked_id, CASE WHEN length(raw) <= 16 THEN raw
       ELSE substr(raw, 1, 8) || '...' || substr(raw, -5) END AS masked_raw
FROM (SELECT *, sha256('{B.SALT}:' || raw) AS h FROM (
  SELECT *, coalesce(student_id, 'manual-' || substr(sha256(CAST(id AS VARCHAR) || '|' || event_type), 1, 12)) AS raw FROM records))"""))
def q_record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7+F1+F2+F25: contact, surrogate id where none is given, salted hash, masked ids."""
    r = records(spark, sf_dir)
    r = r.withColumn("raw", F.coalesce("student_id", surrogate_id("id", "event_type")))
    return r.select("id", U.contact(r).alias("contact"), F.col("raw").startswith("manual-").alias("surrogate"),
                    mask_id(hash_id("raw", B.SALT)).alias("masked_id"), mask_id("raw").alias("masked_raw"))


@register("iso_timestamps", B.sql(RECORDS, select="""
SELECT id, strftime(ts, '%d %b') AS day, 'v' || strftime(ts, '%Y%m%d_%H%M%S') AS version
FROM records WHERE event_type <> 'error'"""))
def q_iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO-8601 text with Z parsed, rows that aren't (here: the error events, which
    carry their type there) skipped; day label and version stamp."""
    r = records(spark, sf_dir)
    r = r.withColumn("text", F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("iso")))
    r = r.withColumn("t", VA.parse_iso("text")).where(F.col("t").isNotNull())
    return r.select("id", F.date_format("t", "dd MMM").alias("day"), VA.version_stamp(F.col("t")).alias("version"))


@register("upload_checks", B.sql(*B.STUDENT_CTES, QS.UPLOAD_SQL, select="""
SELECT 'warning' AS severity, 'missing feature column: ' || f AS message
FROM (SELECT unnest(['quiz_average', 'assignment_submission_rate', 'financial_aid_status']) AS f)
UNION ALL SELECT 'info', (SELECT count_if(_action = 'insert') || ' inserted, ' || count_if(_action = 'update') || ' updated, 3 warnings' FROM merged)"""))
def q_upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1+A20: warnings of the upload, and its load summary with their number."""
    up = QS._upload(spark, sf_dir)
    found = U.validate_columns(up)
    rows = spark.createDataFrame(found, "severity string, message string")
    s = ST.load_summary(QS.merged(spark, sf_dir).withColumn("risk_score", F.lit(None).cast("double")), warnings=len(found))
    text = F.concat_ws("", F.col("inserted").cast("string"), F.lit(" inserted, "), F.col("updated").cast("string"),
                       F.lit(" updated, "), F.col("warnings").cast("string"), F.lit(" warnings"))
    return rows.unionByName(s.select(F.lit("info").alias("severity"), text.alias("message")))


@register("processed_labels", B.sql(RECORDS, select=f"""
SELECT id, {R('attendance_rate', 2)} AS attendance_rate, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS dropout_label
FROM records WHERE event_type IN ('purchase', 'click')"""))
def q_processed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3+S5+S6+S7: records written as processed CSV in two appends, read back, rows without
    a label dropped, the label as integer."""
    root = _root(spark, "processed")
    r = records(spark, sf_dir).select("id", fround("attendance_rate", 2).alias("attendance_rate"), F.when(
        F.col("event_type") == "purchase", 0.0).when(F.col("event_type") == "click", 1.0).alias("dropout_label"))
    for half in (F.col("id") % 2 == 0, F.col("id") % 2 != 0):
        U.append_processed(r.where(half), root)
    return U.read_processed(spark, root, "id long, attendance_rate double, dropout_label double")


@register("person_lookup", B.sql(S.ALERTS, S.INTERVENTIONS, select=f"""
SELECT kind, id, strftime(created_at, '%Y-%m-%d') AS day FROM (
  SELECT 'person' AS kind, c_custkey AS id, NULL::TIMESTAMP AS created_at, c_custkey AS sid FROM customer
  UNION ALL SELECT 'alert', id, created_at, student_id FROM alerts_b
  UNION ALL SELECT 'intervention', id, created_at, student_id FROM interventions_b)
WHERE sid = (SELECT min(student_id) FROM alerts_b)"""))
def q_person_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person found by the anonymised id (that of the first person with an alert), and
    the person's alerts and interventions."""
    al, iv = cohort.alerts(spark, sf_dir), cohort.interventions(spark, sf_dir)
    who = al.agg(F.min("student_id")).first()[0]
    anon = F.sha2(F.lit(f"{B.SALT}:{who}"), 256)
    persons = cohort.persons(spark, sf_dir).withColumn("anon_id", hash_id("student_id", B.SALT))
    found = VA.lookup(persons, anon, "student_id", "anon_id")
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    out = found.select(F.lit("person").alias("kind"), F.col("student_id").alias("id"), F.lit(None).cast("string").alias("day"))
    for kind, table in (("alert", al), ("intervention", iv)):
        child = VA.lookup(table, F.lit(str(who)), "student_id")
        out = out.unionByName(child.select(F.lit(kind).alias("kind"), "id", day))
    return out


_LATEST = """
latest AS (SELECT entity_id, arg_max(risk_score, ts) AS s FROM history_b GROUP BY entity_id)"""


@register("score_bands", B.sql(S.HISTORY, _LATEST, select=f"""
SELECT c_custkey AS student_id, coalesce(s, 0.5) AS filled, {R('greatest(least(coalesce(s * 250 / 100, 0.5), 1.0), 0.0)', 4)} AS beeswarm,
  CASE WHEN s IS NULL THEN NULL WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.6 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS heat_band,
  CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= {K.TAU} THEN 'at_risk' ELSE 'ok' END AS cohort_rule
FROM customer LEFT JOIN latest ON c_custkey = entity_id"""))
def q_score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16+P21+P23: newest score of each person (none: 0.5), beeswarm value, four-level heat
    band (no stored band here) and cohort rule."""
    last = TS.latest_per_key(cohort.risk_history(spark, sf_dir), "entity_id", "ts", ["risk_score", "ts"])
    p = cohort.persons(spark, sf_dir).join(last.withColumnRenamed("entity_id", "student_id"), "student_id", "left")
    p = p.withColumn("band", F.lit(None).cast("string"))
    rules = SC.band_rules("risk_score", "band")
    return p.select("student_id", VA.default_score().alias("filled"),
                    fround(SC.beeswarm_value(F.col("risk_score") * 250), 4).alias("beeswarm"), *rules[1:])


# --- explanations ---------------------------------------------------------------------------
@register("distinct_features", B.sql(*B.STUDENT_CTES, QX.ATTR_SQL, select="SELECT DISTINCT feature FROM attr"))
def q_distinct_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct feature names of all explanations."""
    return EX.explode_explanation(QX.explained(spark, sf_dir), ["student_id"]).select("feature").distinct()


@register("explanation_upsert", B.sql(S.HISTORY, select=f"""
SELECT entity_id, CASE WHEN h.entity_id IS NULL THEN 0.0 ELSE risk_score END AS risk_score,
       CASE WHEN h.entity_id IS NULL THEN 'LOW' ELSE {S.BAND('risk_score')} END AS risk_band,
       CASE WHEN e.entity_id IS NOT NULL AND (h.ts IS NULL OR h.ts = h.newest) THEN 'new' ELSE 'old' END AS explanation,
       h.entity_id IS NULL AS inserted
FROM (SELECT *, max(ts) OVER (PARTITION BY entity_id) AS newest FROM history_b) h
FULL JOIN (SELECT c_custkey AS entity_id FROM customer WHERE c_custkey % 2 = 0) e USING (entity_id)"""))
def q_explanation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New explanations (of the persons with even id) put on the newest row of each log,
    a minimal row inserted where there is none; all other rows kept."""
    log = cohort.risk_history(spark, sf_dir).withColumn("risk_band", risk_band("risk_score")) \
        .withColumn("explanation", F.lit("old"))
    new = cohort.persons(spark, sf_dir).where(F.col("student_id") % 2 == 0).select(
        F.col("student_id").alias("entity_id"), F.lit("new").alias("explanation"))
    out = ST.explain_latest(log, new, "entity_id", "ts", "explanation", {"risk_score": F.lit(0.0), "risk_band": F.lit("LOW")})
    return out.select("entity_id", "risk_score", "risk_band", "explanation", F.col("_inserted").alias("inserted"))


def _batch_sql() -> str:
    text = QX._msg_sql()
    return f"""
SELECT student_id, CASE WHEN aid = 1 THEN 'Please see ' || substr(anon_id, 1, 8) || ' this week.'
                        WHEN aid = 2 THEN 'Attendance ' || printf('%.1f', {R('att', 1)}) || '%, quiz average ' || printf('%.1f', {R('quiz', 1)}) || '%.'
                        ELSE {text} END AS message, 'SMS_COUNSELLOR' AS alert_type
FROM (SELECT r.student_id, r.anon_id, r.risk_band, any_value(s.financial_aid_status) AS aid,
             any_value(s.attendance_rate) AS att, any_value(s.quiz_average) AS quiz,
             string_agg(r.sentence, '; ' ORDER BY r.rank) AS f
      FROM ranked r JOIN students s USING (student_id) WHERE r.rank <= 2 AND r.risk_band = 'HIGH'
      GROUP BY r.student_id, r.anon_id, r.risk_band)"""


@register("counsellor_batch", B.sql(*B.STUDENT_CTES, QX.ATTR_SQL, select=_batch_sql()))
def q_counsellor_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M20+S8: counsellor alerts appended to the alert log: custom text where there is one
    (here: aid level 1), else the factor template, else (no factors: aid level 2) the
    attendance / quiz text."""
    e = QX.explained(spark, sf_dir).where(F.col("risk_band") == "HIGH")
    custom = F.when(F.col("financial_aid_status") == 1,
                    F.concat(F.lit("Please see "), F.substring("anon_id", 1, 8), F.lit(" this week.")))
    factors = F.when(F.col("financial_aid_status") != 2, F.transform(EX.top_factors(F.col("explanation"), 2), EX.factor_sentence))
    text = EX.counsellor_text(custom, F.col("anon_id"), F.col("risk_band"), factors)
    root = _root(spark, "alerts")
    LG.append(e.select("student_id", text.alias("message"), F.lit("SMS_COUNSELLOR").alias("alert_type")), root, "counsellor-1", "alert_type")
    return spark.read.parquet(root).select("student_id", "message", "alert_type")


# --- logs and histories -----------------------------------------------------------------------
def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """The students, re-scored by the second scorer, and the log of both runs on disk."""
    st = cut_lineage(B.students(spark, sf_dir), "students")
    now = F.to_timestamp(F.lit(B.as_of(spark, sf_dir)))
    root = _root(spark, "predictions")
    LG.append(LG.prediction_rows(st, "student_id", now - F.expr("INTERVAL 1 DAY"), F.lit("fixed_a")), root, "batch-1", "model_version")
    rescored = SC.score(st.drop("risk_score", "risk_band"), SC.SCORER_B)
    new, log = ST.scored_writeback(st, rescored, "student_id", B.as_of(spark, sf_dir), "fixed_b")
    for _ in range(2):  # the second run is started twice, as after a failure: its rows are logged once
        LG.append(log.drop("anon_id"), root, "batch-2", "model_version")
    return new, spark.read.parquet(root), root


def _log_sql(scorer: SC.LinearScorer) -> str:
    p = B.sql_prob(scorer)
    return f"SELECT student_id, {R(p, 4)} AS risk_score, {S.BAND(p)} AS risk_band, '{scorer.name}' AS model_version FROM students"


@register("prediction_log", B.sql(*B.STUDENT_CTES, select=f"{_log_sql(SC.SCORER_A)} UNION ALL {_log_sql(SC.SCORER_B)}"))
def q_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8+M10: two batch runs appended to the prediction log, a folder per model version."""
    return _two_runs(spark, sf_dir)[1].select("student_id", "risk_score", "risk_band", "model_version")


@register("prediction_history", B.sql(*B.STUDENT_CTES, QX.ATTR_SQL, select=f"""
SELECT r.student_id, 2 AS position, 'fixed_a' AS model_version, r.feature AS top_feature, {R('r.contribution', 6)} AS contribution
FROM ranked r WHERE r.rank = 1
UNION ALL SELECT student_id, 1, 'fixed_b', NULL, NULL FROM students"""))
def q_prediction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5+F14+F15: each entity's logged predictions, newest first, with their explanations
    decoded from JSON text (the second run has text that isn't JSON: decoded to null)."""
    now = F.to_timestamp(F.lit(B.as_of(spark, sf_dir)))
    e = EX.explanation_to_json(QX.explained(spark, sf_dir))
    root = _root(spark, "predictions")
    rows = LG.prediction_rows(e, "student_id", now - F.expr("INTERVAL 1 DAY"), F.lit("fixed_a"), ["explanation_json"])
    LG.append(rows, root, "batch-1", "model_version")
    again = SC.score(e.drop("risk_score", "risk_band"), SC.SCORER_B).withColumn("explanation_json", F.lit("not json"))
    LG.append(LG.prediction_rows(again, "student_id", now, F.lit("fixed_b"), ["explanation_json"]), root, "batch-2", "model_version")
    h = EX.explanation_from_json(LG.history(spark.read.parquet(root), "student_id"), "explanation_json")
    top = EX.top_factors(F.col("explanation"), 1)[0]
    return h.select("student_id", "position", "model_version", top["feature"].alias("top_feature"),
                    fround(top["contribution"], 6).alias("contribution"))


@register("nightly_log", B.sql(*B.STUDENT_CTES, select=f"""
SELECT 'log' AS kind, student_id, model_version AS detail FROM (
  {_log_sql(SC.SCORER_A)} UNION ALL {_log_sql(SC.SCORER_B)})
UNION ALL
SELECT 'alert', student_id, 'RISK_HIGH' FROM students
WHERE {S.BAND(B.sql_prob(SC.SCORER_B))} = 'HIGH' AND NOT is_flagged"""))
def q_nightly_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11+M10+W7+S8: the nightly run's prediction log and its alert log, both appended:
    entities HIGH by the stored band now that were not flagged before."""
    new, log, _ = _two_runs(spark, sf_dir)
    before = log.where("model_version = 'fixed_a'").select("student_id", (F.col("risk_band") == "HIGH").alias("is_flagged"))
    flagged = TS.newly_flagged(new.drop("is_flagged"), before, "student_id", band="risk_band")
    root = _root(spark, "alerts")
    LG.append(flagged.select("student_id", F.lit("RISK_HIGH").alias("alert_type")), root, "nightly-1", "alert_type")
    alerts = spark.read.parquet(root)
    return log.select(F.lit("log").alias("kind"), "student_id", F.col("model_version").cast("string").alias("detail")).unionByName(
        alerts.select(F.lit("alert").alias("kind"), "student_id", F.col("alert_type").cast("string").alias("detail")))


_RUNS = [("fixed_a", SC.SCORER_A, False), ("fixed_b", SC.SCORER_B, False), ("fixed_a_feedback", SC.SCORER_A, True)]


def _run_sql(i: int, scorer: SC.LinearScorer, feedback: bool) -> str:
    label = ("CASE WHEN student_id_orig IN (SELECT student_id FROM interventions_b WHERE outcome = 'SUCCESSFUL' AND student_id <> 0)"
             " THEN 0 ELSE dropout_label END") if feedback else "dropout_label"
    return (f"SELECT {i} AS run, count_if(y = 1 AND h)::DOUBLE AS tp, count_if(y = 0 AND h)::DOUBLE AS fp, count_if(y = 0 AND NOT h)::DOUBLE AS tn,"
            f" count_if(y = 1 AND NOT h)::DOUBLE AS fn FROM (SELECT {label} AS y, {R(B.sql_prob(scorer), 4)} >= {K.TAU} AS h FROM features)")


_KAPPA = "((2 * (tp * tn - fn * fp)) / ((tp + fp) * (fp + tn) + (tp + fn) * (fn + tn)))"


@register("retrain_trend", B.sql(*S.FEATURE_CTES, S.INTERVENTIONS, select=f"""
SELECT run, f1, kappa, {R('f1 - lag(f1) OVER (ORDER BY run)', 4)} AS f1_change, {R('kappa - lag(kappa) OVER (ORDER BY run)', 4)} AS kappa_change
FROM (SELECT run, {R('2 * tp / (2 * tp + fp + fn)', 4)} AS f1, {R(_KAPPA, 4)} AS kappa
      FROM ({' UNION ALL '.join(_run_sql(i + 1, s, f) for i, (_, s, f) in enumerate(_RUNS))}))"""))
def q_retrain_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9+M18+J11: run log of three scoring runs (the last against labels corrected by
    feedback) and its trend, newest ten runs, with the change against the run before."""
    base = cut_lineage(B.feature_table(spark, sf_dir), "features")
    now = F.to_timestamp(F.lit(B.as_of(spark, sf_dir)))
    root = _root(spark, "runs")
    for i, (name, scorer, feedback) in enumerate(_RUNS):
        rows = base
        if feedback:
            rows, _ = ST.feedback_labels(base, cohort.interventions(spark, sf_dir), "student_id_orig", "student_id")
        scored = rows.select(F.col("dropout_label").alias("label"), fround(scorer.probability(), 4).alias("score"))
        m = EV.classification_metrics(EV.score_histogram(scored, "score", "label"), K.TAU)
        LG.append(m.select(F.lit(name).alias("model"), "f1", "kappa", (now + F.expr(f"INTERVAL {i} HOURS")).alias("run_at")), root, f"run-{i}")
    t = LG.run_trend(spark.read.parquet(root), "run_at", ["f1", "kappa"])
    return t.select("run", "f1", "kappa", fround("f1_change", 4).alias("f1_change"), fround("kappa_change", 4).alias("kappa_change"))


_DRIFT_CTES, _DRIFT_SELECT = S.split_final(QM._DRIFT)


@register("drift_history", B.sql(S.HISTORY, QM.PERIODS_SQL, _DRIFT_CTES, select=f"""
SELECT 'no_baseline' AS check_name, NULL::DOUBLE AS psi, NULL::DOUBLE AS ks_statistic, 'NO_BASELINE' AS drift_level
UNION ALL SELECT 'periods', psi, ks_statistic, drift_level FROM ({_DRIFT_SELECT})"""))
def q_drift_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E17+W6: two drift checks appended to the check history and read back, newest 30: one
    without a baseline, one between the periods."""
    p = cut_lineage(QM.periods(spark, sf_dir), "periods")
    now = F.to_timestamp(F.lit(B.as_of(spark, sf_dir)))
    root = _root(spark, "drift")
    for name, rows in (("no_baseline", p.where("sample = 'current'")), ("periods", p)):
        LG.append(MO.drift_check(rows, "risk_score", "sample").select(
            F.lit(name).alias("check_name"), "psi", "ks_statistic", "drift_level", now.alias("checked_at")), root, f"check-{name}")
    return (spark.read.parquet(root).orderBy(F.col("checked_at").desc(), "check_name").limit(30)
            .select("check_name", "psi", "ks_statistic", "drift_level"))


# --- reports ------------------------------------------------------------------------------------
def test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 % test split, scored by both fixed scorers, written once."""
    f = SP.stratified_split(B.feature_table(spark, sf_dir), "student_key", "dropout_label").where("split = 'test'")
    return cut_lineage(f.select("student_key", *FEATS, F.col("dropout_label").alias("label"),
                                fround(SC.SCORER_A.probability(), 4).alias("score_a"),
                                fround(SC.SCORER_B.probability(), 4).alias("score_b")), "test-split")


def _long(df: DataFrame, report: str, prefix: Column | None = None) -> DataFrame:
    """One row per metric: (report, metric, value)."""
    nums = [c for c, t in df.dtypes if t in ("double", "bigint", "int") and c not in ("bin", "segment")]
    pre = F.concat(prefix.cast("string"), F.lit(".")) if prefix is not None else F.lit("")
    items = F.array(*[F.struct(F.concat(pre, F.lit(c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in nums])
    return df.select(F.lit(report).alias("report"), F.explode(items).alias("x")).select("report", "x.metric", "x.value")


def analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = test_split(spark, sf_dir)
    hist = EV.score_histogram(t, "score_a", "label")
    conf = EV.classification_metrics(hist, K.TAU).select("tp", "fp", "tn", "fn", "accuracy", "f1")
    cal = EV.calibration(t, "score_a", "label", 10)
    fair = EV.fairness(t, "score_a", "label", FE.aid_band("financial_aid_status"), K.TAU)
    dl = EV.delong(t, "label", "score_a", "score_b", paired=False).select("auc_a", "auc_b", "z_statistic", "p_value")
    halves = t.withColumn("sample", F.when(F.crc32(F.col("student_key").cast("binary")) % 2 == 0, "a").otherwise("b")) \
              .withColumnRenamed("label", "dropout_label")
    q = MO.synthetic_quality(halves, "sample", "a", "b", FEATS, digits=2).select("ks_complement", "correlation_similarity", "n_a", "n_b")
    return ST.union_all([_long(dl, "delong"), _long(q, "quality"), _long(conf, "confusion"),
                         _long(cal, "calibration", F.col("bin")), _long(fair, "fairness", F.col("segment"))])


@register("analytics_report")
def q_analytics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E23+S10+S11: DeLong, sample quality, confusion, calibration and fairness of the scored
    test split in one run, written as JSON reports and read back; a report that was never
    written reads as empty."""
    root = _root(spark, "reports")
    rows = cut_lineage(analytics(spark, sf_dir), "analytics")
    names = ["delong", "quality", "confusion", "calibration", "fairness"]
    for n in names:
        LG.write_report(rows.where(F.col("report") == n), root, n)
    return ST.union_all([LG.read_report(spark, root, n) for n in [*names, "never_written"]]).select("report", "metric", "value")


_CONF_SQL = f"""
test_t AS (SELECT *, {R(B.sql_prob(SC.SCORER_A), 4)} AS score_a FROM split_t WHERE split = 'test'),
cm AS (SELECT count_if(y = 1 AND h)::DOUBLE AS tp, count_if(y = 0 AND h)::DOUBLE AS fp, count_if(y = 0 AND NOT h)::DOUBLE AS tn,
              count_if(y = 1 AND NOT h)::DOUBLE AS fn FROM (SELECT dropout_label AS y, score_a >= {K.TAU} AS h FROM test_t))"""


@register("report_roundtrip", B.sql(*S.FEATURE_CTES, QM.SPLIT_SQL, _CONF_SQL, select=f"""
SELECT 'confusion' AS report, metric, value FROM (
  SELECT tp, fp, tn, fn, {R('(tp + tn) / (tp + fp + tn + fn)', 4)} AS accuracy, {R('2 * tp / (2 * tp + fp + fn)', 4)} AS f1 FROM cm)
UNPIVOT (value FOR metric IN (tp, fp, tn, fn, accuracy, f1))"""))
def q_report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5+S10+S11: the confusion report of the test split written as JSON and read back."""
    root = _root(spark, "reports")
    hist = EV.score_histogram(test_split(spark, sf_dir), "score_a", "label")
    conf = EV.classification_metrics(hist, K.TAU).select("tp", "fp", "tn", "fn", "accuracy", "f1")
    LG.write_report(_long(conf, "confusion"), root, "confusion")
    return LG.read_report(spark, root, "confusion").unionByName(LG.read_report(spark, root, "never_written")).select(
        "report", "metric", "value")


def _version_sql(version: str, scorer: SC.LinearScorer, newest: bool) -> str:
    return f"""SELECT '{version}' AS version, metric, value, {str(newest).lower()} AS is_newest FROM (
  SELECT {R('(tp + tn) / (tp + fp + tn + fn)', 4)} AS accuracy, {R('2 * tp / (2 * tp + fp + fn)', 4)} AS f1, tp FROM (
    SELECT count_if(y = 1 AND h)::DOUBLE AS tp, count_if(y = 0 AND h)::DOUBLE AS fp, count_if(y = 0 AND NOT h)::DOUBLE AS tn,
           count_if(y = 1 AND NOT h)::DOUBLE AS fn
    FROM (SELECT dropout_label AS y, {R(B.sql_prob(scorer), 4)} >= {K.TAU} AS h FROM split_t WHERE split = 'test')))
UNPIVOT (value FOR metric IN (accuracy, f1, tp))"""


_VERSIONS = [("v20240101_000000", SC.SCORER_A, "score_a"), ("v20240102_000000", SC.SCORER_B, "score_b")]


@register("model_metrics", B.sql(*S.FEATURE_CTES, QM.SPLIT_SQL, select=" UNION ALL ".join(
    _version_sql(v, s, v == _VERSIONS[-1][0]) for v, s, _ in _VERSIONS)))
def q_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11+S12: test metrics of two versions in the model store, projected from their metadata."""
    root, t = _root(spark, "models"), test_split(spark, sf_dir)
    for version, scorer, col in _VERSIONS:
        m = EV.classification_metrics(EV.score_histogram(t, col, "label"), K.TAU).select("accuracy", "f1", "tp").first()
        MS.save_bundle({}, root, version, list(scorer.coefs), m.asDict())
    return MS.model_metrics(spark, root)


@register("roc_comparison", B.sql(*QE.CTES, QE._ROC, select=f"""
SELECT position, max(CASE WHEN model = 'fixed_a' THEN fpr END) AS fpr_stored, max(CASE WHEN model = 'fixed_a' THEN tpr END) AS tpr_stored,
       max(CASE WHEN model = 'rule' THEN fpr END) AS fpr_rule, max(CASE WHEN model = 'rule' THEN tpr END) AS tpr_rule
FROM (SELECT model, fpr, tpr, row_number() OVER (PARTITION BY model ORDER BY i) AS position
      FROM (SELECT *, greatest(1, n // 20) AS step FROM (
        SELECT model, fpr, tpr, row_number() OVER (PARTITION BY model ORDER BY fpr, tpr, threshold DESC NULLS FIRST) - 1 AS i,
               count(*) OVER (PARTITION BY model) AS n FROM roc WHERE model IN ('fixed_a', 'rule')))
      WHERE i % step = 0 OR i = n - 1)
WHERE (SELECT count(*) FROM features WHERE dropout_label IS NOT NULL) >= 20 GROUP BY position"""))
def q_roc_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E22+J12+L7: ROC of the stored score and of the rule, thinned and merged by position into
    one wide row set; no curve under 20 labelled rows. (The in-sample logistic curve is
    ``roc_in_sample``.)"""
    scores = cut_lineage(QE.long_scores(spark, sf_dir).where("model IN ('fixed_a', 'rule')"), "scores")
    return EV.merge_curves(EV.roc_report(scores, "score", "label", "model"), {"fixed_a": "stored", "rule": "rule"})


@register("roc_in_sample")
def q_roc_in_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E22+M4: AUC (round 3) of the stored score, an in-sample logistic model and the rule."""
    f = TR.with_label(cut_lineage(B.feature_table(spark, sf_dir), "features"))
    model = TR.StandardizedLogistic(FEATS).fit(f)
    fitted = TR.positive_probability(model, f).select(F.lit("logistic").alias("model"), F.col("dropout_label").alias("label"), "score")
    scores = QE.long_scores(spark, sf_dir).where("model <> 'fixed_b'").unionByName(fitted)
    return EV.auc(EV.score_histogram(scores, "score", "label", ["model"]), ["model"]).select("model", fround("auc", 3).alias("auc"))


_FOLD_SQL = f"""
fold_cm AS (
  SELECT fold, count_if(y = 1 AND h)::DOUBLE AS tp, count_if(y = 0 AND h)::DOUBLE AS fp, count_if(y = 1 AND NOT h)::DOUBLE AS fn
  FROM (SELECT fold, dropout_label AS y, {R(B.sql_prob(SC.SCORER_A), 4)} >= {K.TAU} AS h FROM split_t) GROUP BY fold),
fold_m AS (
  SELECT fold, 'f1' AS metric, {R('2 * tp / (2 * tp + fp + fn)', 4)} AS value FROM fold_cm
  UNION ALL SELECT fold, 'precision', {R('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END', 4)} FROM fold_cm
  UNION ALL SELECT fold, 'recall', {R('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END', 4)} FROM fold_cm)"""


@register("fold_summary", B.sql(*S.FEATURE_CTES, QM.SPLIT_SQL, _FOLD_SQL, select=f"""
SELECT metric, {R('m', 4)} AS mean, {R('s', 4)} AS std, {R('lo', 4)} AS min, {R('hi', 4)} AS max,
       {R('greatest(0.0, m - 1.96 * s)', 4)} AS ci_fold_spread_low, {R('least(1.0, m + 1.96 * s)', 4)} AS ci_fold_spread_high, per_fold
FROM (SELECT metric, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi,
             string_agg(printf('%.4f', value), ',' ORDER BY fold) AS per_fold FROM fold_m GROUP BY metric)"""))
def q_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24+M2: metrics of the fixed scorer on each of the 5 folds, summarised."""
    f = SP.stratified_folds(B.feature_table(spark, sf_dir), "student_key", "dropout_label")
    scored = f.select("fold", F.col("dropout_label").alias("label"), fround(SC.SCORER_A.probability(), 4).alias("score"))
    m = EV.classification_metrics(EV.score_histogram(scored, "score", "label", ["fold"]), K.TAU, ["fold"])
    long = m.select("fold", "f1", "precision", "recall").unpivot(["fold"], ["f1", "precision", "recall"], "metric", "value")
    return TR.metric_summary(long)


@register("hash_split_sizes", B.sql(*S.FEATURE_CTES, select=f"""
SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN u < {K.SPLIT_TRAIN} THEN 'train' WHEN u < {QM.VALID_CUT!r} THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT ('0x' || substr(md5(student_key || ':{K.SEED}'), 1, 13))::BIGINT::DOUBLE / {float(16 ** 13)}::DOUBLE AS u FROM features))
GROUP BY split"""))
def q_hash_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 (threshold mode): split by the id's hash alone, no ranking pass; its sizes."""
    return SP.hash_split(B.feature_table(spark, sf_dir), "student_key").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
