"""Raw activity / assessment / profile tables -> the 5-feature entity table.

Operators: J1-J5 joins, A1-A6 aggregates, W1 percentile rank, W2 de-duplication,
P4/P5 engineered features, P17-P19 maps and bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import clip, col_, fround, to_double
from ..session import cut_lineage, join_dimension, side_by_side
from .ranking import pct_ranks, value_counts_cumulative

KEY = ["id_student", "code_module", "code_presentation"]


def student_key(*cols: str) -> Column:
    """Composite key string ``id_module_presentation``."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in (cols or KEY)])


def score_and_weight() -> list[Column]:
    """Numeric score, and numeric weight (none: 1)."""
    return [to_double("score").alias("score"), F.coalesce(to_double("weight"), F.lit(1.0)).alias("weight")]


def assessed(student_assessment: DataFrame, assessments: DataFrame) -> DataFrame:
    """Scores joined to assessment metadata; numeric score and weight. The
    metadata is broadcast if its rows, counted first, are few: the score rows are
    then not shuffled on its keys."""
    j = join_dimension(student_assessment, assessments, "id_assessment")
    return j.select("id_assessment", "id_student", "code_module", "code_presentation", *score_and_weight())


def imd_to_aid(band: str | Column) -> Column:
    """IMD band string -> 1..10, unknown -> 5."""
    m = F.create_map(*[F.lit(x) for kv in K.IMD_MAP.items() for x in kv])
    return F.coalesce(m[col_(band)].cast("double"), F.lit(K.IMD_DEFAULT))


def result_to_label(result: str | Column) -> Column:
    """Pass/Distinction -> 0, Fail/Withdrawn -> 1, anything else -> 0."""
    m = F.create_map(*[F.lit(x) for kv in K.RESULT_LABEL.items() for x in kv])
    return F.coalesce(m[col_(result)], F.lit(0)).cast("int")


def median_values(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """A6 fit: exact median of each column in one aggregate (all null -> 0).

    Exact ``median`` keeps a value -> count map per column: for columns of few
    distinct values, as the features of the feature job, which have 2 decimals in
    bounded ranges (``ranked_medians`` is for any others). Only the one metric row
    reaches the driver (like ``Imputer.fit``).
    """
    row = df.agg(*[F.median(c).alias(c) for c in columns]).first()
    return {c: (float(row[c]) if row[c] is not None else 0.0) for c in columns}


def ranked_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """A6 fit for any number of distinct values: the one or two middle values of each
    column from running counts over ranges of values (all null -> 0). At most two
    rows per column reach the driver."""
    long = df.select(*columns).unpivot([], columns, "feature", "v")
    c = value_counts_cumulative(long, "v", groups=["feature"])
    low, high = F.floor((F.col("n_total") - 1) / 2), F.floor(F.col("n_total") / 2)
    inside = lambda at: (F.col("cnt_below") <= at) & (at < F.col("cnt_below") + F.col("cnt"))
    rows = c.where(inside(low) | inside(high)).groupBy("feature").agg(((F.min("v") + F.max("v")) / 2).alias("m")).collect()
    return {x: 0.0 for x in columns} | {r["feature"]: float(r["m"]) for r in rows}


def impute_median(df: DataFrame, columns: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Fill nulls with the median of each column over all rows."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    medians = medians or median_values(df, present)
    return df.fillna({c: medians[c] for c in present})


def first_registration(profile: DataFrame, totals: list[str]) -> DataFrame:
    """One row per entity key, the first by (label, aid level): file order does not
    exist in a distributed scan, so the order is part of the API. ``totals`` belong to
    the entity. A label and an aid level (below 100) make one number, so that this is a
    plain aggregate with partial results."""
    code = result_to_label("final_result") * 100 + imd_to_aid("imd_band")
    first = profile.groupBy(*KEY).agg(F.min(code).alias("_first"), *[F.max(c).alias(c) for c in totals])
    return first.select(*KEY, F.floor(F.col("_first") / 100).cast("int").alias("dropout_label"),
                        (F.col("_first") % 100).alias("financial_aid_status"), *totals)


def activity(vle: DataFrame, rsd: float | None = None) -> DataFrame:
    """A1 + A4 in one pass over the activity log: total clicks and distinct sites per
    entity, exact or (``rsd``, a relative standard error) estimated without keeping the sites."""
    sites = F.count_distinct("id_site") if rsd is None else F.approx_count_distinct("id_site", rsd)
    # Totals are rounded to 6 decimals so that ties in the rank below do not
    # depend on the (distributed, order-free) summation order of doubles.
    return vle.groupBy(*KEY).agg(fround(F.sum("sum_click"), 6).alias("total_clicks"),
                                 sites.alias("n_distinct_sites"))


def distinct_sketches(df: DataFrame, keys: list[str], columns: list[str], lg_k: int = 12) -> DataFrame:
    """A4, opt-in approximate form: a HyperLogLog sketch per group and column. Sketches
    have a fixed size (some 2**lg_k bytes), can be stored, and merge without the rows."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(c) for c in columns])


def merge_sketches(sketches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One sketch per group of those of several uploads."""
    return sketches.groupBy(*keys).agg(*[F.hll_union_agg(c).alias(c) for c in columns])


def sketch_counts(sketches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Estimated distinct values; the standard error is ``sketch_error`` of them."""
    return sketches.select(*keys, *[F.hll_sketch_estimate(c).alias(c) for c in columns])


def sketch_error(lg_k: int = 12) -> float:
    """Relative standard error of a HyperLogLog estimate (1.04 / sqrt(2**lg_k))."""
    return 1.04 / 2 ** (lg_k / 2)


MAX_WORDS = 16  # 64-bit words of an entity's set of submitted assessments


def numbered(assessments: DataFrame) -> tuple[DataFrame, int]:
    """The metadata with the place of each assessment in its module (``place``, from 0),
    and the words that a bit per place needs. A dimension table, a row per assessment."""
    in_module = Window.partitionBy("code_module", "code_presentation").orderBy("id_assessment")
    out = cut_lineage(assessments.withColumn("place", F.dense_rank().over(in_module) - 1), "assessments")
    return out, int(out.agg(F.max("place")).first()[0] or 0) // 64 + 1


def total_aggregates(known: Column | None = None, words: int | None = None) -> list[Column]:
    """A2 + A4 aggregates over assessment rows: weighted score sum, weight sum
    (unscored rows included) and distinct submitted assessments; of the ``known`` rows only.

    With the rows' ``place`` in their module (``numbered``), the distinct count is that
    of the bits set in ``words`` words: one more number in the aggregate, where a
    distinct count shuffles every (entity, assessment) first.
    """
    of = (lambda c: c) if known is None else (lambda c: F.when(known, c))
    submitted = F.col("score").isNotNull()
    if words is None or words > MAX_WORDS:
        distinct = F.count_distinct(of(F.when(submitted, F.col("id_assessment"))))
    else:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
        sets = [F.bit_or(of(F.when(submitted & (F.floor(F.col("place") / 64) == w), bit))) for w in range(words)]
        distinct = sum((F.bit_count(F.coalesce(s, F.lit(0).cast("long"))) for s in sets), F.lit(0)).cast("long")
    return [F.coalesce(F.sum(of(F.col("score") * F.col("weight"))), F.lit(0.0)).alias("total_weighted_score"),
            F.sum(of(F.col("weight"))).alias("total_weight"), distinct.alias("submitted_assessments")]


def assessment_totals(assessed_df: DataFrame) -> DataFrame:
    """A2 + A4 in one pass over the assessment rows."""
    return assessed_df.groupBy(*KEY).agg(*total_aggregates())


def with_totals(info: DataFrame, assessed_df: DataFrame) -> DataFrame:
    """The profile rows with their assessment totals, for sources that keep them apart."""
    return info.join(assessment_totals(assessed_df), KEY, "left")


RANK_BOUND = 200_000  # distinct values that are ranked by one window per metric


def activity_ranks(act: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W1 of clicks and of sites in one pass: (total_clicks, attendance_rate) and
    (n_distinct_sites, mobile_engagement_freq), a row per distinct value."""
    long = act.select(F.explode(F.array(
        F.struct(F.lit("clicks").alias("metric"), F.col("total_clicks").alias("v")),
        F.struct(F.lit("sites").alias("metric"), F.col("n_distinct_sites").cast("double").alias("v")))).alias("x"))
    ranks = pct_ranks(long.select("x.*"), "v", "_pct", ["metric"], RANK_BOUND)
    rate = fround(clip(F.col("_pct") * 100, 0, 100), 2)
    clicks = ranks.where("metric = 'clicks'").select(F.col("v").alias("total_clicks"), rate.alias("attendance_rate"))
    sites = ranks.where("metric = 'sites'").select(F.col("v").cast("long").alias("n_distinct_sites"),
                                                   rate.alias("mobile_engagement_freq"))
    return clicks, sites


def ranked_activity(vle: DataFrame) -> DataFrame:
    """(entity key, attendance_rate, mobile_engagement_freq): A1, A4 and W1 of the activity
    log. The entities' totals are written: the ranks and the join read them."""
    act = cut_lineage(activity(vle), "entity-activity")
    clicks, sites = activity_ranks(act)
    return act.join(clicks, "total_clicks", "left").join(sites, "n_distinct_sites", "left").select(
        *KEY, "attendance_rate", "mobile_engagement_freq")


def build_feature_table(profile: DataFrame, vle: DataFrame, assessments: DataFrame) -> DataFrame:
    """S2 + J4: the full source-tables -> feature-table job.

    ``profile`` has a row per registration: the entity key, imd_band, final_result
    and the entity's assessment totals (``with_totals``, or one aggregate that gives
    both). Output: student_key, student_id_orig, 5 features, dropout_label; one row
    per entity key. Each log is aggregated once; results of entity size are joined
    left onto the profile (J2-J4), and only such tables are written: the profile and
    the activity, side by side, and the features, which the medians and the result read.
    """
    totals = ["total_weighted_score", "total_weight", "submitted_assessments"]
    base, act = side_by_side(lambda: cut_lineage(first_registration(profile, totals), "entity-profile"),
                             lambda: ranked_activity(vle))
    # At most a row per assessment, and a module's assessments in a set.
    module_counts = assessments.groupBy("code_module", "code_presentation").agg(
        F.size(F.collect_set("id_assessment")).alias("total_assessments"))
    j = base.join(act, KEY, "left").join(module_counts, ["code_module", "code_presentation"], "left")
    quiz_avg = F.col("total_weighted_score") / F.nullif(F.col("total_weight"), F.lit(0.0))
    sub = F.coalesce(F.col("submitted_assessments"), F.lit(0)).cast("double")
    tot = F.coalesce(F.nullif(F.col("total_assessments"), F.lit(0)), F.lit(1)).cast("double")
    df = j.select(student_key().alias("student_key"), F.col("id_student").alias("student_id_orig"), "attendance_rate",
                  fround(clip(quiz_avg, 0, 100), 2).alias("quiz_average"),
                  fround(clip(sub / tot * 100, 0, 100), 2).alias("assignment_submission_rate"),
                  "mobile_engagement_freq", "financial_aid_status", "dropout_label")
    # Two passes follow: the median fit and the result.
    df = impute_median(cut_lineage(df, "entity-features"), K.BASE_FEATURES)
    return df.select("student_key", "student_id_orig", *K.BASE_FEATURES, "dropout_label")


def engineer(df: DataFrame) -> DataFrame:
    """P4 + P5: academic_performance_index (unclipped) and financial_academic_risk."""
    api = 0.4 * F.col("attendance_rate") + 0.4 * F.col("quiz_average") + 0.2 * F.col("assignment_submission_rate")
    fari = (1 - F.col("financial_aid_status") / 10) * (1 - F.col("assignment_submission_rate") / 100)
    return (df.withColumn("academic_performance_index", api)
              .withColumn("financial_academic_risk", clip(fari, 0, 1)))


def aid_band(aid: str | Column) -> Column:
    """Right-closed bins (0,3], (3,6], (6,10]; outside -> null."""
    a = col_(aid)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, label in K.FAIRNESS_BANDS:
        out = out.when((a > lo) & (a <= hi), label)
    return out
