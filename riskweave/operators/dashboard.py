"""Cohort summaries, lists and pages.

Summaries are long ``(metric, value)`` tables: every source table is reduced
to one aggregate row in a single pass (conditional aggregates), unpivoted,
and the per-table results are unioned. No cross join of 1-row results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fround, percent


def metrics_row(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One aggregate pass -> long (metric, value double) rows."""
    agg = df.agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    return agg.unpivot([], list(metrics), "metric", "value")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def student_metrics(students: DataFrame) -> dict[str, Column]:
    """A7 + A8 + A9: counts, mean score of scored rows, drop-out rate of labelled rows."""
    lab = F.col("dropout_label").isNotNull()
    return {
        "total_students": F.count(F.lit(1)),
        "flagged_students": F.count_if(F.col("is_flagged")),
        "labelled_students": F.count_if(lab),
        "high_risk": F.count_if(F.col("risk_band") == "HIGH"),
        "medium_risk": F.count_if(F.col("risk_band") == "MEDIUM"),
        "low_risk": F.count_if(F.col("risk_band") == "LOW"),
        "avg_risk_score": fround(F.avg("risk_score"), 4),
        "dropout_rate_pct": percent(F.sum(F.when(lab, F.col("dropout_label"))), F.count_if(lab), 2),
    }


def alert_metrics(alerts: DataFrame, as_of: str, hours: int = 24) -> dict[str, Column]:
    """A7 + A16: unread, dismissed and alerts of the last ``hours`` before ``as_of``."""
    t = F.to_timestamp(F.lit(as_of))
    recent = (F.col("created_at") >= t - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("created_at") <= t)
    return {
        "total_alerts": F.count(F.lit(1)),
        "unread_alerts": F.count_if(~F.col("is_read")),
        "dismissed_alerts": F.count_if(F.col("is_dismissed")),
        f"alerts_last_{hours}h": F.count_if(recent),
    }


def intervention_metrics(interventions: DataFrame, as_of: str) -> dict[str, Column]:
    """A7 + A17 + A18: pending count, conversion rate, positive-outcome rate, this month."""
    t = F.to_timestamp(F.lit(as_of))
    has_outcome = F.col("outcome").isNotNull()
    positive = F.upper(F.col("outcome")).isin("SUCCESSFUL", "POSITIVE")
    return {
        "total_interventions": F.count(F.lit(1)),
        "pending_interventions": F.count_if(F.col("status") == "PENDING"),
        "conversion_rate_pct": percent(F.count_if(F.col("status") == "COMPLETED"), F.count(F.lit(1)), 1),
        "positive_outcome_pct": percent(F.count_if(has_outcome & positive), F.count_if(has_outcome), 1),
        "interventions_this_month": F.count_if(
            F.date_trunc("month", F.col("created_at")) == F.date_trunc("month", t)),
    }


def operational_summary(students: DataFrame, alerts: DataFrame, interventions: DataFrame,
                        as_of: str) -> DataFrame:
    """The dashboard summary as one long metric table (one job per table)."""
    return union_all([
        metrics_row(students, student_metrics(students)),
        metrics_row(alerts, alert_metrics(alerts, as_of)),
        metrics_row(interventions, intervention_metrics(interventions, as_of)),
    ])


def feature_statistics(df: DataFrame, features: list[str] = K.BASE_FEATURES) -> DataFrame:
    """A10: per feature mean, median, population std, min, max (round 2)."""
    long = df.select(*features).unpivot([], features, "feature", "v")
    return long.groupBy("feature").agg(
        fround(F.avg("v"), 2).alias("mean"),
        fround(F.median("v"), 2).alias("median"),
        fround(F.stddev_pop("v"), 2).alias("std"),
        fround(F.min("v"), 2).alias("min"),
        fround(F.max("v"), 2).alias("max"))


def band_distribution(students: DataFrame) -> DataFrame:
    """A11 + A12 + F21: per band count, mean score, share of total (zero groups
    never appear); the share window runs over the 3 aggregated rows only."""
    g = (students.where(F.col("risk_band").isNotNull())
                 .groupBy("risk_band")
                 .agg(F.count(F.lit(1)).alias("n"), fround(F.avg("risk_score"), 4).alias("avg_score")))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return g.select("risk_band", F.lower("risk_band").alias("band_key"), F.initcap("risk_band").alias("band_label"),
                    "n", "avg_score", fround(F.col("n") / total * 100, 2).alias("share_pct"))


def cohort_comparison(students: DataFrame, group_col: str) -> DataFrame:
    """A13 + A21: per group total, at risk (>= tau), critical (>= 0.75), mean, at-risk share."""
    return students.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("risk_score") >= K.TAU).alias("at_risk"),
        F.count_if(F.col("risk_score") >= K.CRITICAL_COHORT).alias("critical"),
        fround(F.avg("risk_score"), 4).alias("avg_score"),
    ).withColumn("at_risk_pct", F.coalesce(fround(F.col("at_risk") / F.col("total") * 100, 2), F.lit(0.0)))


def threshold_sweep(scores: DataFrame, score_col: str, taus: list[float]) -> DataFrame:
    """Count and percent of rows at or above each threshold (0 <= tau <= 1).

    The scores are first reduced to a histogram (distinct rounded values with
    counts), so the sweep runs over at most 10,001 rows at any scale.
    """
    bad = [t for t in taus if not 0.0 <= t <= 1.0]
    if bad:
        raise ValueError(f"thresholds must lie in [0, 1]: {bad}")
    hist = scores.groupBy(F.col(score_col).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    j = hist.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    return j.groupBy("tau").agg(
        F.sum(F.when(F.col("s") >= F.col("tau"), F.col("n")).otherwise(0)).alias("at_or_above"),
        F.sum("n").alias("total"),
    ).withColumn("pct", fround(F.col("at_or_above") / F.col("total") * 100, 1))


def conjunctive_filter(df: DataFrame, **equals) -> DataFrame:
    """P10: equality filters applied only for the arguments given (not None)."""
    for c, v in equals.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def search(df: DataFrame, q: str | None, cols: list[str]) -> DataFrame:
    """Case-insensitive substring match on any of ``cols`` (no wildcards)."""
    if not q:
        return df
    needle = F.lower(F.lit(q))
    cond = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c).cast("string")), needle) for c in cols])
    return df.where(cond)


def page(df: DataFrame, order: list[Column], page_no: int = 1, size: int = 50, max_size: int = 500) -> DataFrame:
    """L2: offset pagination over a total order (the id tie-break is part of ``order``)."""
    if not 1 <= size <= max_size:
        raise ValueError(f"page size must be in 1..{max_size}")
    if page_no < 1:
        raise ValueError("page numbers start at 1")
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def seek(order: list[tuple[str, bool]], after: dict) -> Column:
    """Rows that come after the row ``after`` in an order of (column, descending), nulls
    last in every column. Its last column must be unique."""
    out, same = F.lit(False), F.lit(True)
    for col, descending in order:
        c, v = F.col(col), after[col]
        if v is None:
            later, equal = F.lit(False), c.isNull()  # nothing comes after a null but other nulls
        else:
            later = ((c < F.lit(v)) if descending else (c > F.lit(v))) | c.isNull()
            equal = c == F.lit(v)
        out = out | (same & later)
        same = same & equal
    return F.coalesce(out, F.lit(False))


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], size: int = 50, after: dict | None = None,
                max_size: int = 500) -> DataFrame:
    """L2, keyset form: the first ``size`` rows after a cursor. A page at any depth is
    one filter and one top-k, where an offset sorts all the rows before it."""
    if not 1 <= size <= max_size:
        raise ValueError(f"page size must be in 1..{max_size}")
    rows = df if after is None else df.where(seek(order, after))
    return rows.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in order]).limit(size)


def cursor(page_rows: DataFrame, order: list[tuple[str, bool]]) -> dict | None:
    """The cursor of the next page: the order's values of a page's last row (a page has
    at most 500 rows); None after an empty page."""
    rows = page_rows.select(*[c for c, _ in order]).collect()
    return rows[-1].asDict() if rows else None


COLLATION = "UNICODE_CI_AI"


def user_sort(df: DataFrame, col: str | None, descending: bool, collation: str = COLLATION) -> Column:
    """L3: user-chosen sort column of ``df``. Text is compared by locale rules, without
    regard to case and accents, an absent text as the empty one; numbers, dates and
    flags sort an absent value as 0, the first day, false."""
    kind = dict(df.dtypes).get(col or "")
    if kind is None:
        c = F.lit("")  # (a number would be taken for a position)
    elif kind == "string" or kind.startswith(("string", "varchar", "char")):
        c = F.collate(F.coalesce(F.col(col), F.lit("")), collation)
    elif kind.startswith(("timestamp", "date")):
        c = F.coalesce(F.col(col), F.lit("1970-01-01").cast(kind))
    else:
        c = F.coalesce(F.col(col), F.lit(0).cast(kind))
    return c.desc() if descending else c.asc()


def with_total(df: DataFrame) -> DataFrame:
    """The filtered row count alongside each row (``count(*) over ()``) is
    avoided; the count is a separate one-row aggregate."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def pilot_targets(actuals: DataFrame) -> DataFrame:
    """Status per pilot metric: green >= target, amber >= 0.75 target, else
    red; a target that nothing was measured for has a null value and status.

    ``actuals`` is (metric, value). The targets are a 3-row literal table.
    """
    spark = actuals.sparkSession
    targets = spark.createDataFrame(K.PILOT_TARGETS, "metric string, target double")
    j = targets.join(actuals, "metric", "left")
    status = (F.when(F.col("value").isNull(), F.lit(None).cast("string"))
               .when(F.col("value") >= F.col("target"), "green")
               .when(F.col("value") >= F.col("target") * K.PILOT_AMBER, "amber").otherwise("red"))
    return j.select("metric", "value", "target", status.alias("status"))
