"""Cohort binding: the driver's tables re-read as the application's source tables.

The rules are the fixture binding of FIXTURES.md section 3. They only shape
rows into the schemas the jobs expect; every job downstream works on any data
of these schemas. The DuckDB oracle applies the same rules in SQL
(``riskweave.plans.oracle``).

Entity key: ``(id_student, code_module, code_presentation)``, rendered as the
string ``student_key`` = ``id_student _ code_module _ code_presentation``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fround
from ..operators.features import score_and_weight, total_aggregates
from .tables import read_table

PRESENTATION = "P1"
N_ASSESSMENTS = 50   # assessment id = part key modulo 50 (binding rule)
N_MODULES = 5

# Binding-only maps (proposals of FIXTURES.md section 3).
STATUS_BY_ORDERSTATUS = {"F": "COMPLETED", "O": "PENDING", "P": "SENT"}
OUTCOME_BY_PRIORITY = {"1-URGENT": "SUCCESSFUL", "2-HIGH": "UNSUCCESSFUL", "3-MEDIUM": "PENDING"}
IMD_DECILES = [f"{10 * i}-{10 * (i + 1)}%" for i in range(10)]


def _module(col: Column) -> Column:
    return F.concat(F.lit("M"), (col % N_MODULES).cast("string"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assessments(id_assessment, code_module, code_presentation, weight text)."""
    ids = read_table(spark, sf_dir, "part", ["p_partkey"]).select(
        (F.col("p_partkey") % N_ASSESSMENTS).alias("id_assessment")).distinct()
    return ids.select(
        "id_assessment",
        _module(F.col("id_assessment")).alias("code_module"),
        F.lit(PRESENTATION).alias("code_presentation"),
        (F.lit(1) + F.col("id_assessment") % 4).cast("string").alias("weight"),
    )


def lines_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines with their customer, in the columns that the tables below need."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"])
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").drop("l_orderkey", "o_orderkey")


def student_assessment(lo: DataFrame, *extra: str) -> DataFrame:
    """studentAssessment(id_assessment, id_student, score text, '?' = not submitted)."""
    unsubmitted = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0)
    return lo.select(
        (F.col("l_partkey") % N_ASSESSMENTS).alias("id_assessment"),
        F.col("o_custkey").alias("id_student"),
        F.when(unsubmitted, F.lit("?"))
        .otherwise((F.col("l_quantity") * 2).cast("string")).alias("score"),
        *extra,
    )


def student_vle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """studentVle(id_student, code_module, code_presentation, id_site, sum_click)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value", "props"])
    return ev.select(
        F.col("user_id").alias("id_student"),
        _module(F.col("event_id")).alias("code_module"),
        F.lit(PRESENTATION).alias("code_presentation"),
        F.concat(F.col("event_type"), F.lit("-"), F.get_json_object("props", "$.k")).alias("id_site"),
        F.col("value").alias("sum_click"),
    )


def student_profile(spark: SparkSession, sf_dir: str, numbered_assessments: DataFrame, words: int) -> DataFrame:
    """studentInfo with the assessment totals of each entity beside it, from one
    aggregate over one join of the lines: (id_student, code_module,
    code_presentation, imd_band, final_result, total_weighted_score, total_weight,
    submitted_assessments). The binding gives a line the same module in both tables,
    so a line counts in the totals of its own entity, if its assessment is known."""
    lo = lines_with_orders(spark, sf_dir)
    meta = numbered_assessments.select("id_assessment", "weight", "place", F.lit(True).alias("_known"))
    scored = student_assessment(lo, "l_quantity").join(meta, "id_assessment", "left").select(
        "id_student", _module(F.col("id_assessment")).alias("code_module"),
        "id_assessment", "place", "l_quantity", "_known", *score_and_weight())
    per_key = scored.groupBy("id_student", "code_module").agg(
        F.avg("l_quantity").alias("avg_q"), *total_aggregates(F.col("_known"), words))
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    decile = F.least(F.floor((F.col("c_acctbal") + 1000) / 1100), F.lit(9)).cast("int")
    deciles = F.create_map(*[F.lit(x) for i, s in enumerate(IMD_DECILES) for x in (i, s)])
    imd = deciles[decile]
    result = (F.when(F.col("avg_q") < 22, "Withdrawn").when(F.col("avg_q") < 24, "Fail")
              .when(F.col("avg_q") < 30, "Pass").otherwise("Distinction"))
    return per_key.join(cust, per_key.id_student == cust.c_custkey, "left").select(
        "id_student", "code_module", F.lit(PRESENTATION).alias("code_presentation"), imd.alias("imd_band"), result.alias("final_result"),
        "total_weighted_score", "total_weight", "submitted_assessments")


def week_bounds(spark: SparkSession, sf_dir: str) -> tuple:
    """(current week, the week before, middle week) of the events as text, from the first
    and the last event time: three values reach the driver, the scan reads one column."""
    ts = F.col("ts").cast("timestamp")
    cur = F.date_trunc("week", F.max(ts))
    mid = F.timestamp_micros(F.floor((F.unix_micros(F.min(ts)) + F.unix_micros(F.max(ts))) / 2).cast("long"))
    row = read_table(spark, sf_dir, "events", ["ts"]).agg(
        *[F.date_format(x, "yyyy-MM-dd HH:mm:ss") for x in (cur, cur - F.expr("INTERVAL 7 DAYS"), F.date_trunc("week", mid))]).first()
    return tuple(row)


def risk_history(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """Per-entity weekly score history: (entity_id, ts, risk_score). ``since``, a
    week's start, leaves out earlier weeks in the scan."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "value"])
    if since is not None:
        ev = ev.where(F.col("ts") >= F.lit(since).cast(ev.schema["ts"].dataType))
    week = F.date_trunc("week", F.col("ts").cast("timestamp"))
    return ev.groupBy(F.col("user_id").alias("entity_id"), week.alias("ts")).agg(
        fround(F.least(F.avg("value") / 250, F.lit(1.0)), 4).alias("risk_score"))


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interventions(id, student_id, intervention_type, status, outcome, created_at)."""
    od = read_table(spark, sf_dir, "orders",
                    ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])
    status = F.create_map(*[F.lit(x) for kv in STATUS_BY_ORDERSTATUS.items() for x in kv])
    outcome = F.create_map(*[F.lit(x) for kv in OUTCOME_BY_PRIORITY.items() for x in kv])
    types = F.array(*[F.lit(t) for t in ("SMS", "EMAIL", "COUNSELLING", "TUTORING", "OTHER")])
    return od.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("student_id"),
        F.element_at(types, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("intervention_type"),
        status[F.col("o_orderstatus")].alias("status"),
        outcome[F.col("o_orderpriority")].alias("outcome"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alerts(id, student_id, alert_type, is_read, is_dismissed, created_at) from error events."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "ts", "value"])
    return ev.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("student_id"),
        F.when(F.col("value") >= 250, "HIGH_RISK").otherwise("RISK_CHANGE").alias("alert_type"),
        (F.col("event_id") % 3 == 0).alias("is_read"),
        (F.col("event_id") % 7 == 0).alias("is_dismissed"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person-level parent table (id_student) with segment and balance."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return c.select(F.col("c_custkey").alias("student_id"), F.col("c_nationkey").alias("region_code"),
                    F.col("c_mktsegment").alias("programme"))


def event_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload batch: one row per activity event, keyed like the feature
    table; features the event does not carry are null."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return ev.select(
        F.concat_ws("_", F.col("user_id").cast("string"), _module(F.col("event_id")), F.lit(PRESENTATION)).alias("student_id"),
        (F.col("value") / 4.9).alias("attendance_rate"),
        F.get_json_object("props", "$.k").cast("double").alias("mobile_engagement_freq"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 0)
        .cast("int").alias("dropout_label"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("+44"), F.lpad(F.col("user_id").cast("string"), 9, "0")))
        .alias("phone_number"),
        F.col("ts").cast("timestamp").alias("uploaded_at"), "event_id")
