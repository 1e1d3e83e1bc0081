"""Per-entity score histories: latest rows, last-N windows, trajectories,
Holt and linear-trend forecasts, flag transitions, period comparison
(T1-T5, W3-W7, U1, A14, F17, F19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import clip, fround, pct_change, risk_band


def last_n_per_key(df: DataFrame, key: str, order_col: str, n: int, salt_buckets: int = 16) -> DataFrame:
    """The ``n`` latest rows per key, skew-safe.

    Stage 1 keeps the top ``n`` per (key, salt) where the salt spreads one
    key's rows over ``salt_buckets`` tasks; stage 2 keeps the top ``n`` of the
    at most ``n * salt_buckets`` survivors per key. A hot key never lands in a
    single task with all its rows. Adds ``rn`` (1 = latest).
    """
    salt = F.pmod(F.xxhash64(F.col(order_col).cast("string")), F.lit(salt_buckets))
    w1 = Window.partitionBy(key, "_salt").orderBy(F.col(order_col).desc())
    stage1 = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
                .where(F.col("_r1") <= n).drop("_r1", "_salt"))
    w2 = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    return stage1.withColumn("rn", F.row_number().over(w2)).where(F.col("rn") <= n)


def latest_per_key(df: DataFrame, key: str, order_col: str, cols: list[str]) -> DataFrame:
    """Newest row per key by ``max_by`` (a partial aggregate: skew-safe)."""
    st = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(key).agg(F.max_by(st, F.col(order_col)).alias("_s"))
              .select(key, *[F.col(f"_s.{c}").alias(c) for c in cols]))


def collect_series(df: DataFrame, key: str, ts: str, value: str, n: int = K.FORECAST_WINDOW) -> DataFrame:
    """The last ``n`` valid points per key, oldest first, as ``array<struct<ts, v>>``
    (bounded by ``n`` whatever the history length)."""
    valid = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    last = last_n_per_key(valid, key, ts, n)
    return (last.groupBy(key)
                .agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(value).cast("double").alias("v"))))
                     .alias("series")))


def holt(series: Column, alpha: float = K.FORECAST_ALPHA, beta: float = K.FORECAST_BETA) -> Column:
    """T1 fold: level = s0, trend = s1 - s0 (0 if single); then for each later
    point: l' = a s + (1 - a)(l + t); t' = b (l' - l) + (1 - b) t."""
    vals = F.transform(series, lambda e: e["v"])
    first = F.element_at(vals, 1)
    trend0 = F.when(F.size(vals) >= 2, F.element_at(vals, 2) - first).otherwise(F.lit(0.0))
    init = F.struct(first.alias("level"), trend0.alias("trend"))

    def step(acc, s):
        nl = F.lit(alpha) * s + F.lit(1 - alpha) * (acc["level"] + acc["trend"])
        nt = F.lit(beta) * (nl - acc["level"]) + F.lit(1 - beta) * acc["trend"]
        return F.struct(nl.alias("level"), nt.alias("trend"))

    return F.aggregate(F.slice(vals, 2, K.FORECAST_WINDOW), init, step)


def forecast_steps(state: Column, horizon: int) -> Column:
    """Projected values level + h trend, clamped to [0, 1], round 4, h = 1..horizon."""
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)),
                       lambda h: fround(clip(state["level"] + h * state["trend"], 0, 1), 4))


def trend_label(delta: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for bound, label in K.TREND_LABELS:
        out = out.when(delta > bound, label) if bound > 0 else out.when(delta < bound, label)
    return out.otherwise("STABLE")


def forecast_report(history: DataFrame, key: str = "entity_id", ts: str = "ts", value: str = "risk_score",
                    horizon: int = K.FORECAST_STEPS) -> DataFrame:
    """T1 + T2: per entity forecast array, trend delta and label, status.

    Horizon is clamped to 1..8. The trend needs >= 2 forecasts (else 0 and
    STABLE). Entities with fewer than 2 valid points get status
    ``insufficient_history`` and no forecast (nothing is fabricated).
    """
    h = max(1, min(K.FORECAST_MAX_HORIZON, int(horizon)))
    s = collect_series(history, key, ts, value)
    n = F.size("series")
    fc = forecast_steps(holt(F.col("series")), h)
    last_actual = F.element_at(F.col("series"), -1)["v"]
    delta = F.when(F.lit(h) >= 2, F.element_at(F.col("forecast"), -1) - last_actual).otherwise(F.lit(0.0))
    ok = n >= 2
    out = s.withColumn("forecast", F.when(ok, fc))
    return out.select(
        key, n.alias("n_points"), F.lit("holt").alias("method"),
        fround(last_actual, 4).alias("last_actual"),
        F.element_at(F.col("forecast"), -1).alias("last_forecast"),
        F.when(ok, fround(delta, 4)).alias("trend_delta"),
        F.when(ok, trend_label(delta)).alias("trend_label"),
        F.when(ok, "ok").otherwise("insufficient_history").alias("status"),
        "forecast", F.element_at(F.col("series"), -1)["ts"].alias("last_ts"))


def forecast_series(report: DataFrame, history: DataFrame, key: str = "entity_id", ts: str = "ts",
                    value: str = "risk_score") -> DataFrame:
    """U1 + F19: history rows and forecast rows (one week apart) tagged by type."""
    hist = last_n_per_key(history.where(F.col(ts).isNotNull() & F.col(value).isNotNull()), key, ts,
                          K.FORECAST_WINDOW)
    hist_rows = hist.select(key, F.lit("history").alias("type"), (-F.col("rn") + 1).alias("step"),
                            F.col(ts).alias("ts"), F.col(value).cast("double").alias("score"))
    fc = report.where(F.col("forecast").isNotNull()).select(key, "last_ts", F.posexplode("forecast").alias("i", "score"))
    fc_rows = fc.select(key, F.lit("forecast").alias("type"), (F.col("i") + 1).alias("step"),
                        (F.col("last_ts") + F.make_interval(weeks=F.col("i") + 1)).alias("ts"), "score")
    return hist_rows.unionByName(fc_rows)


def linear_trend_forecast(history: DataFrame, key: str = "entity_id", ts: str = "ts", value: str = "risk_score",
                          horizon: int = K.FORECAST_STEPS) -> DataFrame:
    """Per-entity least-squares line of score on time (days), last 12
    points, projected 1..h weeks past the last point (clamped, round 4);
    needs >= 3 points."""
    last = last_n_per_key(history.where(F.col(ts).isNotNull() & F.col(value).isNotNull()), key, ts,
                          K.FORECAST_WINDOW)
    # Time in days relative to the entity's last point keeps the fit well conditioned.
    last = last.withColumn("_last", F.max(ts).over(Window.partitionBy(key)))
    days = (F.unix_timestamp(F.col(ts)) - F.unix_timestamp(F.col("_last"))) / 86400.0
    fit = last.groupBy(key).agg(
        F.regr_slope(F.col(value), days).alias("slope"), F.regr_intercept(F.col(value), days).alias("icpt"),
        F.count(F.lit(1)).alias("n_points"))
    fit = fit.where(F.col("n_points") >= 3)
    steps = fit.select(key, "n_points", "slope", "icpt",
                       F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    at = F.col("step") * 7.0
    # 6 decimals: a least-squares line through 4-decimal scores at weekly
    # steps often lands exactly on a 5th-decimal half, where 4-decimal
    # rounding would depend on the last bit of the fit.
    return steps.select(key, "n_points", "step", F.lit("linear_trend").alias("method"),
                        fround(clip(F.col("icpt") + F.col("slope") * at, 0, 1), 6).alias("forecast"))


def trajectory(history: DataFrame, key: str = "entity_id", ts: str = "ts", value: str = "risk_score",
               n: int = K.TRAJECTORY_POINTS) -> DataFrame:
    """T4 + W5: last ``n`` readings per entity, oldest first, labelled 'Wk i',
    round 4; only entities with >= 2 readings."""
    last = last_n_per_key(history.where(F.col(value).isNotNull()), key, ts, n)
    cnt = F.count(F.lit(1)).over(Window.partitionBy(key))
    lab = last.withColumn("_n", cnt).where(F.col("_n") >= 2)
    i = F.col("_n") - F.col("rn") + 1
    return lab.select(key, i.alias("week_index"), F.concat(F.lit("Wk "), i.cast("string")).alias("label"),
                      fround(F.col(value), 4).alias("score"))


def newly_flagged(current: DataFrame, previous: DataFrame, key: str, score: str = "risk_score",
                  flag_prev: str = "is_flagged", tau: float = K.TAU, band: str | None = None) -> DataFrame:
    """Entities whose band is HIGH now and that were not flagged in the
    previous snapshot (absent before counts as not flagged). A join of two
    snapshots: no window holds an entity's whole history. ``band`` names the
    stored band, which was taken from the unrounded score; without it the band
    is taken from ``score``."""
    cur = current.withColumn("_band", F.col(band) if band else risk_band(F.col(score), tau))
    prev = previous.select(key, F.col(flag_prev).alias("_was"))
    j = cur.join(prev, key, "left")
    return j.where((F.col("_band") == "HIGH") & ~F.coalesce(F.col("_was"), F.lit(False))).drop("_band", "_was")


def period_summary(scores: DataFrame, period_col: str, score: str = "risk_score") -> DataFrame:
    """Per period total, at risk (>= tau), mean; change vs the previous
    period in percent (0 when the previous is 0). The window runs over the
    aggregated periods only."""
    g = scores.groupBy(period_col).agg(F.count(F.lit(1)).alias("total"),
                                        F.count_if(F.col(score) >= K.TAU).alias("at_risk"),
                                        F.avg(score).alias("_mean"))
    w = Window.partitionBy(F.lit(1)).orderBy(period_col)
    prev = F.lag("at_risk").over(w)
    return g.select(period_col, "total", "at_risk", fround(F.col("_mean"), 4).alias("avg_score"),
                    fround(pct_change(F.col("at_risk").cast("double"), prev.cast("double")), 1).alias("at_risk_change_pct"))
