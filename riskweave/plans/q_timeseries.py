"""Time-series queries over the weekly score history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import timeseries as TS
from ..sources import cohort
from . import base as B
from . import sqlbits as S
from .registry import register

R, CLIP = S.R, S.CLIP
CURRENT_WEEK = "(SELECT date_trunc('week', max(ts)) FROM events)"
A, BETA = K.FORECAST_ALPHA, K.FORECAST_BETA
H = K.FORECAST_STEPS

_SERIES = f"""
series AS (
  SELECT entity_id, list(risk_score::DOUBLE ORDER BY ts) AS vals, max(ts) AS last_ts, count(*) AS n
  FROM (SELECT * FROM history_b WHERE ts IS NOT NULL AND risk_score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) <= {K.FORECAST_WINDOW})
  GROUP BY entity_id),
holt AS (
  SELECT *, list_reduce(list_slice(vals, 2, {K.FORECAST_WINDOW}),
      lambda acc, s: {{'level': {A}::DOUBLE * s + {1 - A!r}::DOUBLE * (acc.level + acc.trend),
                       'trend': {BETA}::DOUBLE * (({A}::DOUBLE * s + {1 - A!r}::DOUBLE * (acc.level + acc.trend)) - acc.level)
                                + {1 - BETA!r}::DOUBLE * acc.trend}},
      {{'level': vals[1], 'trend': CASE WHEN len(vals) >= 2 THEN vals[2] - vals[1] ELSE 0.0::DOUBLE END}}) AS st
  FROM series),
fc AS (
  SELECT *, CASE WHEN n >= 2 THEN list_transform(range(1, {H + 1}),
                 lambda h: {R(CLIP('st.level + h * st.trend', 0, 1), 4)}) END AS forecast
  FROM holt)"""


def _label(d: str) -> str:
    return (f"CASE WHEN {d} > 0.05 THEN 'WORSENING' WHEN {d} > 0.01 THEN 'SLIGHTLY_WORSENING' "
            f"WHEN {d} < -0.05 THEN 'IMPROVING' WHEN {d} < -0.01 THEN 'SLIGHTLY_IMPROVING' ELSE 'STABLE' END")


@register("forecast_report", B.sql(S.HISTORY, _SERIES, select=f"""
SELECT entity_id, n AS n_points, 'holt' AS method, {R('vals[-1]', 4)} AS last_actual,
       forecast[-1] AS last_forecast,
       CASE WHEN n >= 2 THEN {R('forecast[-1] - vals[-1]', 4)} END AS trend_delta,
       CASE WHEN n >= 2 THEN {_label('(forecast[-1] - vals[-1])')} END AS trend_label,
       CASE WHEN n >= 2 THEN 'ok' ELSE 'insufficient_history' END AS status
FROM fc"""))
def q_forecast_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1+T2: Holt forecast (4 weeks) per entity from its last 12 weekly scores; trend label."""
    rep = TS.forecast_report(cohort.risk_history(spark, sf_dir))
    return rep.drop("forecast", "last_ts")


@register("forecast_series", B.sql(S.HISTORY, _SERIES, select=f"""
SELECT entity_id, 'history' AS type, -(rn) + 1 AS step, strftime(ts, '%Y-%m-%d') AS ts, risk_score::DOUBLE AS score
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) AS rn FROM history_b
      WHERE ts IS NOT NULL AND risk_score IS NOT NULL QUALIFY rn <= {K.FORECAST_WINDOW})
UNION ALL
SELECT entity_id, 'forecast', i AS step, strftime(last_ts + to_weeks(i::INTEGER), '%Y-%m-%d'), forecast[i]
FROM (SELECT entity_id, last_ts, forecast, unnest(range(1, len(forecast) + 1)) AS i FROM fc WHERE forecast IS NOT NULL)"""))
def q_forecast_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1+F19: history rows and forecast rows (one week apart), tagged by type."""
    h = cohort.risk_history(spark, sf_dir)
    s = TS.forecast_series(TS.forecast_report(h), h)
    return s.withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


@register("trend_forecast", B.sql(S.HISTORY, select=f"""
SELECT entity_id, n_points, step, 'linear_trend' AS method,
       {R(CLIP('icpt + slope * (step * 7.0)', 0, 1), 6)} AS forecast
FROM (SELECT entity_id, regr_slope(risk_score, x) AS slope, regr_intercept(risk_score, x) AS icpt, count(*) AS n_points
      FROM (SELECT *, (epoch(ts) - epoch(max(ts) OVER (PARTITION BY entity_id))) / 86400.0 AS x
            FROM (SELECT * FROM history_b WHERE ts IS NOT NULL AND risk_score IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) <= {K.FORECAST_WINDOW}))
      GROUP BY entity_id HAVING count(*) >= 3), (SELECT unnest(range(1, {H + 1})) AS step)"""))
def q_trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-entity least-squares trend forecast (>= 3 points), 4 weeks ahead."""
    return TS.linear_trend_forecast(cohort.risk_history(spark, sf_dir))


@register("risk_trajectory", B.sql(S.HISTORY, select=f"""
SELECT entity_id, n - rn + 1 AS week_index, 'Wk ' || CAST(n - rn + 1 AS VARCHAR) AS label, {R('risk_score', 4)} AS score
FROM (SELECT *, count(*) OVER (PARTITION BY entity_id) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) AS rn FROM history_b
        WHERE risk_score IS NOT NULL QUALIFY rn <= {K.TRAJECTORY_POINTS}))
WHERE n >= 2"""))
def q_risk_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4+W4+W5: last 8 readings per entity numbered 'Wk i' (entities with >= 2)."""
    return TS.trajectory(cohort.risk_history(spark, sf_dir))


@register("latest_score", B.sql(S.HISTORY, select="""
SELECT entity_id, arg_max(risk_score, ts) AS risk_score, strftime(max(ts), '%Y-%m-%d') AS ts
FROM history_b GROUP BY entity_id"""))
def q_latest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest reading per entity (max_by: partial aggregation, skew-safe)."""
    l = TS.latest_per_key(cohort.risk_history(spark, sf_dir), "entity_id", "ts", ["risk_score", "ts"])
    return l.withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


@register("newly_flagged", B.sql(S.HISTORY, select=f"""
SELECT c.entity_id, c.risk_score
FROM (SELECT * FROM history_b WHERE ts = {CURRENT_WEEK}) c
LEFT JOIN (SELECT entity_id, {S.BAND('risk_score')} = 'HIGH' AS was FROM history_b WHERE ts = {CURRENT_WEEK} - INTERVAL 7 DAYS) p
  USING (entity_id)
WHERE {S.BAND('c.risk_score')} = 'HIGH' AND NOT coalesce(p.was, false)"""))
def q_newly_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIGH in the newest weekly snapshot and not flagged in the week before it."""
    this, before, _ = cohort.week_bounds(spark, sf_dir)
    cur = cohort.risk_history(spark, sf_dir, since=this)  # no later week exists
    prev = (cohort.risk_history(spark, sf_dir, since=before).where(F.col("ts") == F.lit(before).cast("timestamp"))
              .withColumn("is_flagged", TS.risk_band(F.col("risk_score")) == "HIGH"))
    return TS.newly_flagged(cur, prev, "entity_id").select("entity_id", "risk_score")


@register("period_change", B.sql(S.HISTORY, select=f"""
SELECT strftime(ts, '%Y-%m-%d') AS period, total, at_risk, avg_score,
       {R('CASE WHEN lag(at_risk) OVER (ORDER BY ts) = 0 THEN 0.0 ELSE (at_risk - lag(at_risk) OVER (ORDER BY ts))::DOUBLE / lag(at_risk) OVER (ORDER BY ts) * 100 END', 1)} AS at_risk_change_pct
FROM (SELECT ts, count(*) AS total, count_if(risk_score >= {K.TAU}) AS at_risk, {R('avg(risk_score)', 4)} AS avg_score
      FROM history_b GROUP BY ts)"""))
def q_period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly cohort totals, at-risk count and its change vs the previous week."""
    p = TS.period_summary(cohort.risk_history(spark, sf_dir), "ts")
    return p.withColumn("ts", F.date_format("ts", "yyyy-MM-dd")).withColumnRenamed("ts", "period")


@register("recent_readings", B.sql(S.HISTORY, select="""
SELECT entity_id, strftime(ts, '%Y-%m-%d') AS ts, risk_score FROM history_b
ORDER BY history_b.ts DESC, entity_id DESC LIMIT 30"""))
def q_recent_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 newest readings overall (top-k: partial top-k per task, then merge)."""
    h = cohort.risk_history(spark, sf_dir)
    top = h.orderBy(F.col("ts").desc(), F.col("entity_id").desc()).limit(30)
    return top.select("entity_id", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "risk_score")
