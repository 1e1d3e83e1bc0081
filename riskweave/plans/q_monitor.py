"""Monitoring and split queries (A23, E14-E20, M1-M3, M17 sizes)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import baseline as BL
from ..operators import monitoring as MO
from ..operators import splits as SP
from ..session import cut_lineage, scratch_table_path
from ..sources import cohort
from . import base as B
from . import sqlbits as S
from .registry import register

R = S.R
# Baseline period = weeks before the middle week of the events; current period = the rest.
PERIOD_SPLIT = ("(SELECT date_trunc('week', make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2)) FROM events)")
VALID_CUT = K.SPLIT_TRAIN + K.SPLIT_VALID


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = cohort.risk_history(spark, sf_dir)
    middle = cohort.week_bounds(spark, sf_dir)[2]
    return h.withColumn("sample", F.when(F.col("ts") < F.lit(middle).cast("timestamp"), "baseline")
                        .otherwise("current"))


PERIODS_SQL = f"""
periods AS (
  SELECT *, CASE WHEN ts < {PERIOD_SPLIT} THEN 'baseline' ELSE 'current' END AS sample
  FROM history_b)"""


@register("baseline_profile", B.sql(S.HISTORY, PERIODS_SQL, select=f"""
SELECT count(risk_score) AS n, {R('avg(risk_score)', 4)} AS mean, {R('stddev_pop(risk_score)', 4)} AS std,
       {', '.join(f"{R(f'quantile_cont(risk_score, {q})', 4)} AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))}
FROM periods WHERE sample = 'baseline'"""))
def q_baseline_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline score profile (n, mean, std, percentiles) of the first period."""
    return BL.profile(BL.histogram(periods(spark, sf_dir).where(F.col("sample") == "baseline"), "risk_score"))


def kolmogorov_sql(d: str, n1: str, n2: str) -> str:
    en = f"sqrt({n1} * {n2} / ({n1} + {n2}))"
    lam = f"(({en} + 0.12::DOUBLE + 0.11::DOUBLE / {en}) * {d})"
    series = (f"list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
              f" * exp(-2.0::DOUBLE * k * k * {lam} * {lam})))")
    return f"(CASE WHEN {lam} < 1e-3 THEN 1.0::DOUBLE ELSE least(greatest(2.0::DOUBLE * {series}, 0.0::DOUBLE), 1.0::DOUBLE) END)"


def ks_sql(source: str, value: str, s1: str, s2: str, groups: str = "", digits: int = 4) -> str:
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    return f"""
SELECT {g}max(abs(f1 - f2)) AS ks, first(n1) AS n1, first(n2) AS n2 FROM (
  SELECT {g}sum(c1) OVER ({part} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(c1) OVER ({part}) AS f1,
         sum(c2) OVER ({part} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(c2) OVER ({part}) AS f2,
         sum(c1) OVER ({part}) AS n1, sum(c2) OVER ({part}) AS n2
  FROM (SELECT {g}{R(value, digits)} AS v, count_if(sample = '{s1}') AS c1, count_if(sample = '{s2}') AS c2
        FROM {source} WHERE {value} IS NOT NULL AND sample IN ('{s1}', '{s2}') GROUP BY ALL))
{'GROUP BY ' + groups if groups else ''}"""


def _bin(score: str) -> str:
    return f"(CASE WHEN {score} >= 0 AND {score} <= 1 THEN least(floor({score} * 10), 9)::INTEGER END)"


_DRIFT = f"""
shares AS (
  SELECT sample, b.bin, count_if({_bin('risk_score')} = b.bin)::DOUBLE / count(risk_score)::DOUBLE AS share
  FROM periods, (SELECT unnest(range(0, 10)) AS bin) b GROUP BY sample, b.bin),
psi_t AS (
  SELECT sum((a - e) * ln(a / e)) AS psi FROM (
    SELECT bin, CASE WHEN e = 0 THEN 1e-4 ELSE e END AS e, CASE WHEN a = 0 THEN 1e-4 ELSE a END AS a FROM (
      SELECT bin, coalesce(max(CASE WHEN sample = 'baseline' THEN share END), 0.0) AS e,
             coalesce(max(CASE WHEN sample = 'current' THEN share END), 0.0) AS a
      FROM shares GROUP BY bin))),
ks_t AS ({ks_sql('periods', 'risk_score', 'baseline', 'current')}),
m_t AS (SELECT avg(CASE WHEN sample = 'baseline' THEN risk_score END) AS mb,
               avg(CASE WHEN sample = 'current' THEN risk_score END) AS mc FROM periods),
one AS (SELECT psi, ks, {kolmogorov_sql('ks', 'n1::DOUBLE', 'n2::DOUBLE')} AS ks_p, mb, mc FROM psi_t, ks_t, m_t)
SELECT {R('psi', 4)} AS psi, {R('ks', 4)} AS ks_statistic, {R('ks_p', 4)} AS ks_p_value,
       {R('abs(mc - mb) / greatest(mb, 0.01) * 100', 1)} AS mean_shift_pct,
       CASE WHEN psi > {K.PSI_SIGNIFICANT} OR ks > {K.KS_THRESHOLD} THEN 'SIGNIFICANT'
            WHEN psi > {K.PSI_WARNING} THEN 'MINOR' ELSE 'NONE' END AS drift_level,
       (psi > {K.PSI_SIGNIFICANT} OR ks > {K.KS_THRESHOLD}) AS drift_detected
FROM one"""


@register("drift_check", B.sql(S.HISTORY, PERIODS_SQL, S.split_final(_DRIFT)[0], select=S.split_final(_DRIFT)[1]))
def q_drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14+E15+E16+E17: PSI, KS (+ asymptotic p), mean shift and verdict between periods."""
    return MO.drift_check(periods(spark, sf_dir), "risk_score", "sample")


@register("drift_against_baseline", B.sql(S.HISTORY, PERIODS_SQL, S.split_final(_DRIFT)[0], select=f"""
SELECT *, 'check' AS kind, NULL::BIGINT AS n, NULL::DOUBLE AS mean, NULL::DOUBLE AS p50 FROM ({S.split_final(_DRIFT)[1]})
UNION ALL SELECT NULL, NULL, NULL, NULL, 'NO_BASELINE', false, 'before', NULL, NULL, NULL
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'profile', count(risk_score), {R('avg(risk_score)', 4)}, {R('quantile_cont(risk_score, 0.5)', 4)}
FROM periods WHERE sample = 'baseline'"""))
def q_drift_against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E17+A23+L8: a baseline stored batch by batch (one per parity of the week, one of them sent
    twice), then a check of the later period against it, which reads no raw baseline row; a
    check before there is a baseline; and the profile of the stored baseline."""
    root = scratch_table_path(spark, f"baseline-{uuid.uuid4().hex[:12]}")
    p = cut_lineage(periods(spark, sf_dir), "periods")
    current = p.where("sample = 'current'")
    before = BL.check(spark, root, current, "risk_score").withColumn("kind", F.lit("before"))
    baseline = BL.start(spark, root)
    old = p.where("sample = 'baseline'").withColumn("batch", F.weekofyear("ts") % 2)
    for batch in (0, 1, 1):
        BL.add_batch(old.where(F.col("batch") == batch), "risk_score", baseline, f"batch-{batch}")
    check = BL.check(spark, root, current, "risk_score").withColumn("kind", F.lit("check"))
    profile = BL.profile(BL.read(spark, root)).select(F.lit("profile").alias("kind"), "n", "mean", "p50")
    return before.unionByName(check).unionByName(profile, allowMissingColumns=True)


def split_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.stratified_split(B.feature_table(spark, sf_dir), "student_key", "dropout_label")


SPLIT_SQL = f"""
split_t AS (
  SELECT *, CASE WHEN pos::DOUBLE / n::DOUBLE < {K.SPLIT_TRAIN} THEN 'train'
                 WHEN pos::DOUBLE / n::DOUBLE < {VALID_CUT!r} THEN 'valid' ELSE 'test' END AS split,
         (pos % {K.N_FOLDS})::INTEGER AS fold
  FROM (SELECT *, row_number() OVER (PARTITION BY dropout_label ORDER BY md5(student_key || ':{K.SEED}')) - 1 AS pos,
               count(*) OVER (PARTITION BY dropout_label) AS n FROM features))"""


@register("stratified_split", B.sql(*S.FEATURE_CTES, SPLIT_SQL, select="""
SELECT split, dropout_label, count(*) AS n FROM split_t GROUP BY ALL"""))
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: exact stratified 70/15/15 split by seeded md5 order (sizes per split and label)."""
    return split_frame(spark, sf_dir).groupBy("split", "dropout_label").agg(F.count(F.lit(1)).alias("n"))


@register("split_assignment", B.sql(*S.FEATURE_CTES, SPLIT_SQL, select="""
SELECT student_key, split, fold FROM split_t"""))
def q_split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1+M2: per-row split and stratified fold (5 folds, seed 42)."""
    f = B.feature_table(spark, sf_dir)
    return SP.split_and_folds(f, "student_key", "dropout_label").select("student_key", "split", "fold")


@register("standardizer", B.sql(*S.FEATURE_CTES, SPLIT_SQL, select=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'avg({c})', 6)} AS mean, {R(f'stddev_pop({c})', 6)} AS std "
    f"FROM split_t WHERE split = 'train'" for c in K.BASE_FEATURES)))
def q_standardizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: standardiser fitted on the training split (mean, population std)."""
    train = split_frame(spark, sf_dir).where(F.col("split") == "train")
    fitted = SP.fit_standardizer(train, K.BASE_FEATURES)
    rows = spark.createDataFrame([(c, m, s) for c, (m, s) in fitted.items()], "feature string, mean double, std double")
    return rows.select("feature", MO.fround("mean", 6).alias("mean"), MO.fround("std", 6).alias("std"))


def _corr_sim_sql() -> str:
    from itertools import combinations
    pairs = list(combinations(K.BASE_FEATURES, 2))
    terms = " + ".join(
        f"abs(corr(CASE WHEN sample = 'train' THEN {a} END, CASE WHEN sample = 'train' THEN {b} END)"
        f" - corr(CASE WHEN sample = 'test' THEN {a} END, CASE WHEN sample = 'test' THEN {b} END))" for a, b in pairs)
    return f"SELECT 1.0 - 2 * (0.0 + {terms}) / {len(K.BASE_FEATURES) ** 2} AS cs FROM qs"


_FEAT_LONG = " UNION ALL ".join(f"SELECT sample, '{c}' AS feature, {c} AS value FROM qs" for c in K.BASE_FEATURES)
_QUALITY = f"""
qs AS (SELECT *, split AS sample FROM split_t),
ql AS ({_FEAT_LONG}),
ks_f AS ({ks_sql('ql', 'value', 'train', 'test', 'feature', 2)}),
ksc AS (SELECT avg(1 - ks) AS ksc FROM ks_f),
csim AS ({_corr_sim_sql()}),
sizes AS (SELECT count_if(sample = 'train') AS n_a, count_if(sample = 'test') AS n_b,
                 avg(CASE WHEN sample = 'train' THEN dropout_label END) AS ra,
                 avg(CASE WHEN sample = 'test' THEN dropout_label END) AS rb FROM qs)"""


@register("synthetic_quality", B.sql(*S.FEATURE_CTES, SPLIT_SQL, _QUALITY, select=f"""
SELECT {R('ksc', 4)} AS ks_complement, {R('cs', 4)} AS correlation_similarity,
       ksc >= {K.KS_COMPLEMENT_MIN} AS ks_pass, cs >= {K.CORR_SIMILARITY_MIN} AS corr_pass,
       n_a, n_b, {R('ra * 100', 2)} AS label_rate_a_pct, {R('rb * 100', 2)} AS label_rate_b_pct
FROM ksc, csim, sizes"""))
def q_synthetic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E18+E19+E20: KS complement and correlation similarity of two equal-schema
    samples (train vs test split of the feature table, whose values have 2 decimals)."""
    s = cut_lineage(split_frame(spark, sf_dir).withColumnRenamed("split", "sample"), "split")
    return MO.synthetic_quality(s, "sample", "train", "test", K.BASE_FEATURES, digits=2)


@register("learning_curve_sizes", B.sql(*S.FEATURE_CTES, SPLIT_SQL, select=f"""
SELECT f AS fraction, least(n, greatest(50, floor(n * f)::BIGINT)) AS n_rows
FROM (SELECT count(*) AS n FROM split_t WHERE split = 'train'),
     (SELECT unnest([{', '.join(f'{i / 10}::DOUBLE' for i in range(1, 11))}]) AS f)"""))
def q_learning_curve_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested training-prefix sizes n = max(50, floor(N f)) for f = 0.1 .. 1.0."""
    n = F.col("n")
    train = split_frame(spark, sf_dir).where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n"))
    fr = train.withColumn("fraction", F.explode(F.array(*[F.lit(i / 10) for i in range(1, 11)])))
    return fr.select("fraction", F.least(n, F.greatest(F.lit(50), F.floor(n * F.col("fraction")))).cast("long").alias("n_rows"))
