"""Explanations and messages: linear attribution, cohort ranking, top
factors, factor sentences, alert and brief text, JSON edges, partial
dependence (M13 linear, M14, L5, F10-F16, M11, M20, M21, E21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.columns import display_name, fround
from .scoring import LinearScorer

EXPLANATION_TYPE = T.ArrayType(T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("contribution", T.DoubleType()),
]))


def fit_background(df: DataFrame, scorer: LinearScorer) -> dict[str, float]:
    """Background means of the scorer's features (one aggregate, metric row only)."""
    row = df.agg(*[F.avg(f).alias(f) for f in scorer.coefs]).first()
    return {f: float(row[f] or 0.0) for f in scorer.coefs}


def linear_attribution(df: DataFrame, scorer: LinearScorer, background: dict[str, float]) -> DataFrame:
    """M13 (linear scorer): exact per-row contributions ``coef * (x - mean)``
    in margin units, plus ``base_value`` = intercept + sum coef * mean.
    Additive: base_value + sum(contributions) = margin. Pure columns."""
    base = scorer.intercept + sum(c * background[f] for f, c in scorer.coefs.items())
    items = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                      (F.lit(c) * (F.col(f) - F.lit(background[f]))).alias("contribution"))
             for f, c in scorer.coefs.items()]
    return df.withColumn("explanation", F.array(*items)).withColumn("base_value", F.lit(base))


def top_factors(expl: Column, n: int = 3) -> Column:
    """First ``n`` items by absolute contribution (desc; feature name breaks ties).
    A per-row array sort: no shuffle."""
    def cmp(a, b):
        ka, kb = F.abs(a["contribution"]), F.abs(b["contribution"])
        return (F.when(ka > kb, -1).when(ka < kb, 1)
                 .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    return F.slice(F.array_sort(expl, cmp), 1, n)


def factor_sentence(item: Column) -> Column:
    """'Label (v) increasing risk' when the contribution is > 0, else
    'mitigating risk'; v with one decimal from a pre-rounded value."""
    direction = F.when(item["contribution"] > 0, "increasing risk").otherwise("mitigating risk")
    return F.concat(display_name(item["feature"]), F.lit(" ("),
                    F.format_string("%.1f", fround(item["value"], 1)), F.lit(") "), direction)


def truncate_message(msg: Column, limit: int = K.MESSAGE_LIMIT) -> Column:
    """F12 tail: longer than 160 characters -> first 157 + '...'."""
    return F.when(F.length(msg) > limit, F.concat(F.substring(msg, 1, limit - 3), F.lit("..."))).otherwise(msg)


def counsellor_message(code: Column, band: Column, factors: Column) -> Column:
    """alert text with the first two factor sentences joined by '; '
    ('See dashboard' when there are none), truncated to 160."""
    fs = F.when(F.size(factors) > 0, F.array_join(F.slice(factors, 1, 2), "; ")).otherwise(F.lit("See dashboard"))
    msg = F.concat(F.lit("EWS ALERT: Student "), code, F.lit(" flagged "), band, F.lit(". Key factors: "),
                   fs, F.lit(". Please contact within 5 days."))
    return truncate_message(msg)


def counsellor_text(custom: Column, code: Column, band: Column, factors: Column) -> Column:
    """The custom text if there is one, else the factor template, else (no factors
    known) the attendance and quiz figures."""
    figures = F.concat(F.lit("Attendance "), F.format_string("%.1f", fround("attendance_rate", 1)),
                       F.lit("%, quiz average "), F.format_string("%.1f", fround("quiz_average", 1)), F.lit("%."))
    return truncate_message(F.coalesce(custom, F.when(factors.isNotNull(), counsellor_message(code, band, factors)), figures))


def flagged_message(anon: Column, score: Column, factors: Column) -> Column:
    """F13 + F10: nightly alert text 'Student <id8>… has been flagged as HIGH risk
    (score: 12.34%). Top factors: a, b'."""
    pct = F.format_string("%.2f%%", fround(score * 100, 2))
    return F.concat(F.lit("Student "), F.substring(anon, 1, 8), F.lit("… has been flagged as HIGH risk (score: "),
                    pct, F.lit("). Top factors: "), F.array_join(F.slice(factors, 1, 2), ", "))


def explanation_to_json(df: DataFrame, col: str = "explanation") -> DataFrame:
    """encode the explanation array as JSON text (for text-typed stores)."""
    return df.withColumn(col + "_json", F.to_json(F.col(col)))


def explanation_from_json(df: DataFrame, col: str) -> DataFrame:
    """decode JSON text; malformed text -> null, the row is kept."""
    return df.withColumn("explanation", F.from_json(F.col(col), EXPLANATION_TYPE, {"mode": "PERMISSIVE"}))


def explode_explanation(df: DataFrame, keep: list[str]) -> DataFrame:
    """F16: one row per item: feature, shap_value (contribution, else value,
    else 0), feature_value."""
    e = df.select(*keep, F.explode("explanation").alias("_e"))
    return e.select(*keep, F.col("_e.feature").alias("feature"),
                    F.coalesce(F.col("_e.contribution"), F.col("_e.value"), F.lit(0.0)).alias("shap_value"),
                    F.col("_e.value").alias("feature_value"))


def cohort_importance(exploded: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature and its rank (desc)."""
    g = exploded.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("_m"), F.count(F.lit(1)).alias("n"))
    return g.select("feature", display_name(F.col("feature")).alias("label"),
                    fround(F.col("_m"), 6).alias("mean_abs_contribution"), "n")


def partial_dependence(df: DataFrame, scorer: LinearScorer, grid_points: int = 20,
                       lo_q: float = 0.02, hi_q: float = 0.98) -> DataFrame:
    """Per feature a grid of ``grid_points`` values between its 2nd and
    98th percentile, all other features at their medians, scored.

    One aggregate of exact percentiles (bounded: 2-decimal features) yields
    one row; the grid is generated from it by ``explode`` (feature x point).
    """
    feats = list(scorer.coefs)
    aggs = []
    for f in feats:
        aggs += [F.percentile(f, lo_q).alias(f"{f}__lo"), F.percentile(f, hi_q).alias(f"{f}__hi"),
                 F.median(f).alias(f"{f}__med")]
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("i")) for f in feats
                      for i in range(grid_points)])
    g = one.select("*", F.explode(cells).alias("_c"))
    feat, i = F.col("_c.feature"), F.col("_c.i")
    def grid_value(f: str) -> Column:
        lo, hi = F.col(f"{f}__lo"), F.col(f"{f}__hi")
        return F.when(i == grid_points - 1, hi).otherwise(lo + i * ((hi - lo) / (grid_points - 1)))
    value = F.lit(None).cast("double")
    z = F.lit(scorer.intercept)
    for f, c in scorer.coefs.items():
        x = F.when(feat == f, grid_value(f)).otherwise(F.col(f"{f}__med"))
        z = z + F.lit(c) * x
        value = F.when(feat == f, grid_value(f)).otherwise(value)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return g.select(feat.alias("feature"), i.alias("grid_index"), fround(value, 4).alias("grid_value"),
                    fround(p, 4).alias("score"))


def brief_rows(df: DataFrame, factors: Column, actions: Column) -> DataFrame:
    """One wide row per entity: score %, band, three features, top-3
    factor sentences and the recommended actions (rendering is not built)."""
    return df.select(
        "student_id", fround(F.col("risk_score") * 100, 1).alias("score_pct"), "risk_band",
        "attendance_rate", "quiz_average", "assignment_submission_rate",
        F.array_join(F.transform(factors, factor_sentence), " | ").alias("top_factors"),
        F.array_join(actions, " | ").alias("actions"))

