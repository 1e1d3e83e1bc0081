"""Evaluation queries on the two-scorer test set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fround, pct_change
from ..functions.stats import ERFC_COEFS
from ..operators import evaluation as EV
from ..operators import features as FE
from ..operators import scoring as SC
from . import base as B
from . import sqlbits as S
from .registry import register

R, TAU = S.R, K.TAU


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, label, score) for the two fixed scorers and the rule baseline."""
    f = B.feature_table(spark, sf_dir)
    a = f.select(F.lit("fixed_a").alias("model"), F.col("dropout_label").alias("label"),
                 fround(SC.SCORER_A.probability(), 4).alias("score"))
    b = f.select(F.lit("fixed_b").alias("model"), F.col("dropout_label").alias("label"),
                 fround(SC.SCORER_B.probability(), 4).alias("score"))
    r = SC.rule_baseline(f).select(F.lit("rule").alias("model"), F.col("dropout_label").alias("label"),
                                   fround(F.col("rule_prob"), 4).alias("score"))
    return a.unionByName(b).unionByName(r)


def sql_rule_prob() -> str:
    att = S.CLIP("(60.0::DOUBLE - attendance_rate) / 60.0::DOUBLE", 0, 1)
    quiz = S.CLIP("(40.0::DOUBLE - quiz_average) / 40.0::DOUBLE", 0, 1)
    raw = S.CLIP(f"({att} + {quiz}) / 2", 0, 1)
    flag = "(attendance_rate < 60 AND quiz_average < 40)"
    return f"(CASE WHEN {flag} THEN greatest({raw}, 0.5::DOUBLE) ELSE least({raw}, 0.49::DOUBLE) END)"


LONG_SCORES = f"""
long_scores AS (
  SELECT 'fixed_a' AS model, dropout_label AS label, {R(B.sql_prob(SC.SCORER_A), 4)} AS score FROM features
  UNION ALL SELECT 'fixed_b', dropout_label, {R(B.sql_prob(SC.SCORER_B), 4)} FROM features
  UNION ALL SELECT 'rule', dropout_label, {R(sql_rule_prob(), 4)} FROM features),
hist AS (
  SELECT model, {R('score', 4)} AS score, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg
  FROM long_scores WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY ALL)"""
CTES = [S.BINDING, S.FEATURES, LONG_SCORES]

W_DESC = "PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
W_ASC_EXCL = "PARTITION BY model ORDER BY score ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
W_DESC_EXCL = "PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@register("score_histogram", B.sql(*CTES, select="SELECT * FROM hist"))
def q_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, score, n_pos, n_neg) for three scorers."""
    return EV.score_histogram(long_scores(spark, sf_dir), "score", "label", ["model"])


_ROC = f"""
roc AS (
  SELECT model, score AS threshold, tp, fp, tp::DOUBLE / nullif(P, 0)::DOUBLE AS tpr,
         fp::DOUBLE / nullif(N, 0)::DOUBLE AS fpr
  FROM (SELECT model, score, sum(n_pos) OVER ({W_DESC})::BIGINT AS tp, sum(n_neg) OVER ({W_DESC})::BIGINT AS fp,
               sum(n_pos) OVER (PARTITION BY model)::BIGINT AS P, sum(n_neg) OVER (PARTITION BY model)::BIGINT AS N
        FROM hist)
  UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM hist)"""


@register("roc_curve", B.sql(*CTES, _ROC, select="SELECT * FROM roc"))
def q_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2+W8+U2: ROC points per model (running sums over the histogram), start at (0, 0)."""
    return EV.roc_points(q_score_histogram(spark, sf_dir), ["model"])


_THIN = f"""
SELECT model, threshold, tp, fp, tpr, fpr FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY fpr, tpr, threshold DESC NULLS FIRST) - 1 AS i,
         count(*) OVER (PARTITION BY model) AS n FROM roc)
WHERE i % greatest(1, floor(n / 20)::BIGINT) = 0 OR i = n - 1"""


@register("roc_thinned", B.sql(*CTES, _ROC, select=_THIN))
def q_roc_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th ROC point (about 21 per model), always ending at (1, 1)."""
    return EV.thin_curve(q_roc_curve(spark, sf_dir), ["model"])


_AUC = f"""
auc_t AS (
  SELECT model, sum(n_pos)::BIGINT AS P, sum(n_neg)::BIGINT AS N,
         sum(n_pos * (neg_below + 0.5 * n_neg)) / nullif(sum(n_pos) * sum(n_neg), 0) AS auc
  FROM (SELECT *, coalesce(sum(n_neg) OVER ({W_ASC_EXCL}), 0) AS neg_below FROM hist) GROUP BY model),
pr_t AS (
  SELECT model, sum((recall - coalesce(lag(recall) OVER w, 0.0)) * (precision + coalesce(lag(precision) OVER w, 1.0)) / 2) AS pr_auc
  FROM (SELECT model, score, tp::DOUBLE / nullif(P, 0) AS recall, tp::DOUBLE / (tp + fp) AS precision
        FROM (SELECT model, score, sum(n_pos) OVER ({W_DESC}) AS tp, sum(n_neg) OVER ({W_DESC}) AS fp,
                     sum(n_pos) OVER (PARTITION BY model) AS P FROM hist))
  WINDOW w AS (PARTITION BY model ORDER BY score DESC)
  GROUP BY model)"""
# lag() inside an aggregate is not allowed in DuckDB: compute segments first.
_AUC = _AUC.replace(
    "SELECT model, sum((recall - coalesce(lag(recall) OVER w, 0.0)) * (precision + coalesce(lag(precision) OVER w, 1.0)) / 2) AS pr_auc\n  FROM (",
    "SELECT model, sum(area) AS pr_auc FROM (SELECT model, (recall - coalesce(lag(recall) OVER w, 0.0)) * (precision + coalesce(lag(precision) OVER w, 1.0)) / 2 AS area FROM (",
).replace("  WINDOW w AS (PARTITION BY model ORDER BY score DESC)\n  GROUP BY model)",
          "  WINDOW w AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model)")


@register("auc_summary", B.sql(*CTES, _AUC, select=f"""
SELECT a.model, a.P, a.N, {R('a.auc', 4)} AS auc, {R('p.pr_auc', 4)} AS pr_auc
FROM auc_t a JOIN pr_t p USING (model)"""))
def q_auc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3+E4: ROC AUC (ties half) and trapezoid PR AUC per model."""
    h = q_score_histogram(spark, sf_dir)
    a = EV.auc(h, ["model"])
    p = EV.pr_auc(h, ["model"])
    return a.join(p, "model").select("model", "P", "N", fround(F.col("auc"), 4).alias("auc"),
                                     fround(F.col("pr_auc"), 4).alias("pr_auc"))


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END)"


def metrics_sql(tau: str) -> str:
    conf = f"""
SELECT model,
  sum(CASE WHEN score >= {tau} THEN n_pos ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN score >= {tau} THEN n_neg ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN NOT (score >= {tau}) THEN n_neg ELSE 0 END)::BIGINT AS tn,
  sum(CASE WHEN NOT (score >= {tau}) THEN n_pos ELSE 0 END)::BIGINT AS fn,
  sum(n_pos * (1 - score) ^ 2 + n_neg * score ^ 2) AS _brier,
  sum(-(n_pos * ln(greatest(score, 1e-15)) + n_neg * ln(greatest(1 - score, 1e-15)))) AS _ll
FROM hist GROUP BY model"""
    tp, fp, tn, fn = "tp::DOUBLE", "fp::DOUBLE", "tn::DOUBLE", "fn::DOUBLE"
    n = f"({tp} + {fp} + {tn} + {fn})"
    po = f"(({tp} + {tn}) / {n})"
    pe = f"((({tp} + {fp}) * ({tp} + {fn}) + ({fn} + {tn}) * ({fp} + {tn})) / ({n} * {n}))"
    return f"""
SELECT model, tp, fp, tn, fn, {R(po, 4)} AS accuracy, {R(_ratio(tp, f'{tp} + {fp}'), 4)} AS precision,
  {R(_ratio(tp, f'{tp} + {fn}'), 4)} AS recall, {R(_ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}'), 4)} AS f1,
  {R(f'CASE WHEN {pe} < 1 THEN ({po} - {pe}) / (1 - {pe}) END', 4)} AS kappa,
  {R(_ratio(tp, f'{tp} + {fn}'), 4)} AS sensitivity, {R(_ratio(tn, f'{tn} + {fp}'), 4)} AS specificity,
  {R(f'_brier / {n}', 4)} AS brier, {R(f'_ll / {n}', 4)} AS log_loss
FROM ({conf})"""


@register("classification_metrics", B.sql(*CTES, select=metrics_sql(f"{TAU}::DOUBLE")))
def q_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5+E6: confusion matrix and metrics at tau = 0.4432 per model."""
    return EV.classification_metrics(q_score_histogram(spark, sf_dir), TAU, ["model"])


@register("youden_threshold", B.sql(*CTES, _ROC, select="""
SELECT model, threshold AS youden_threshold, j AS youden_j FROM (
  SELECT model, threshold, tpr - fpr AS j FROM roc WHERE threshold IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY model ORDER BY j DESC, threshold DESC) = 1"""))
def q_youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7+F24: Youden threshold per model (ties: highest J, then highest threshold)."""
    return EV.youden(q_roc_curve(spark, sf_dir), ["model"])


def erfc_sql(x: str) -> str:
    z = f"abs({x})"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * {z}))"
    poly = f"{ERFC_COEFS[-1]}::DOUBLE"
    for c in reversed(ERFC_COEFS[:-1]):
        poly = f"({c}::DOUBLE + {t} * {poly})"
    ans = f"({t} * exp(-{z} * {z} + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0::DOUBLE - {ans} END)"


def delong_sql(paired: bool) -> str:
    c10, c01 = ("c10", "c01") if paired else ("0.0::DOUBLE", "0.0::DOUBLE")
    var = f"((va10 + vb10 - 2 * {c10}) / P + (va01 + vb01 - 2 * {c01}) / N)"
    zexpr = f"(CASE WHEN P > 0 AND N > 0 AND {var} > 0 THEN (auc_a - auc_b) / sqrt({var}) ELSE 0.0::DOUBLE END)"
    p = erfc_sql(f"(abs(_z) / {2.0 ** 0.5}::DOUBLE)")
    return f"""
, dl_long AS (
  SELECT label AS y, 'a' AS m, score_a AS score FROM two_scores
  UNION ALL SELECT label, 'b', score_b FROM two_scores),
dl_hist AS (
  SELECT m, {R('score', 4)} AS score, sum(y) AS n_pos, sum(1 - y) AS n_neg
  FROM dl_long WHERE score IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
dl_pl AS (
  SELECT m, score,
    (coalesce(sum(n_neg) OVER (PARTITION BY m ORDER BY score ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + 0.5 * n_neg) / sum(n_neg) OVER (PARTITION BY m) AS v10,
    (coalesce(sum(n_pos) OVER (PARTITION BY m ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + 0.5 * n_pos) / sum(n_pos) OVER (PARTITION BY m) AS v01
  FROM dl_hist),
dl_rows AS (
  SELECT t.label AS y, pa.v10 AS v10_a, pa.v01 AS v01_a, pb.v10 AS v10_b, pb.v01 AS v01_b
  FROM two_scores t
  JOIN dl_pl pa ON pa.m = 'a' AND pa.score = {R('t.score_a', 4)}
  JOIN dl_pl pb ON pb.m = 'b' AND pb.score = {R('t.score_b', 4)}
  WHERE t.label IS NOT NULL),
dl_agg AS (
  SELECT count_if(y = 1) AS P, count_if(y = 0) AS N,
    avg(CASE WHEN y = 1 THEN v10_a END) AS auc_a, avg(CASE WHEN y = 1 THEN v10_b END) AS auc_b,
    var_samp(CASE WHEN y = 1 THEN v10_a END) AS va10, var_samp(CASE WHEN y = 1 THEN v10_b END) AS vb10,
    covar_samp(CASE WHEN y = 1 THEN v10_a END, CASE WHEN y = 1 THEN v10_b END) AS c10,
    var_samp(CASE WHEN y = 0 THEN v01_a END) AS va01, var_samp(CASE WHEN y = 0 THEN v01_b END) AS vb01,
    covar_samp(CASE WHEN y = 0 THEN v01_a END, CASE WHEN y = 0 THEN v01_b END) AS c01
  FROM dl_rows),
dl_z AS (SELECT *, {zexpr} AS _z FROM dl_agg)
SELECT {R('auc_a', 4)} AS auc_a, {R('auc_b', 4)} AS auc_b, {R('_z', 4)} AS z_statistic,
       {R(p, 4)} AS p_value, {p} < 0.05 AS significant,
       CASE WHEN {R('auc_a', 4)} > {R('auc_b', 4)} THEN 'a' WHEN {R('auc_a', 4)} < {R('auc_b', 4)} THEN 'b'
            ELSE 'tie' END AS higher_auc
FROM dl_z"""


@register("delong_paired", B.sql(*B.SCORE_CTES, select=delong_sql(True)))
def q_delong_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8+F9: paired DeLong test of scorer a vs b (placements from the histogram)."""
    return EV.delong(B.two_scores(spark, sf_dir), "label", "score_a", "score_b", paired=True)


@register("delong_unpaired", B.sql(*B.SCORE_CTES, select=delong_sql(False)))
def q_delong_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpaired DeLong (covariance dropped), sign reported truthfully."""
    return EV.delong(B.two_scores(spark, sf_dir), "label", "score_a", "score_b", paired=False)


_CAL = f"""
edges AS (SELECT quantile_cont(score_a, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM two_scores)
SELECT bin, {R('avg(score_a)', 4)} AS mean_predicted, {R('avg(label::DOUBLE)', 4)} AS fraction_positive, count(*) AS n
FROM (SELECT t.*, len(list_filter(e, lambda x: x < t.score_a)) AS bin FROM two_scores t, edges)
GROUP BY bin"""


@register("calibration_curve", B.sql(*B.SCORE_CTES, _CAL.split("\nSELECT")[0], select="SELECT" + _CAL.split("\nSELECT", 1)[1]))
def q_calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 quantile bins of scorer a; mean predicted vs fraction positive."""
    return EV.calibration(B.two_scores(spark, sf_dir), "score_a", "label", 10)


def _aid_band_sql(c: str) -> str:
    parts = " ".join(f"WHEN {c} > {lo} AND {c} <= {hi} THEN '{lab}'" for lo, hi, lab in K.FAIRNESS_BANDS)
    return f"(CASE {parts} END)"


_FAIR = f"""
fh AS (
  SELECT segment, {R('score', 4)} AS score, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg
  FROM (SELECT {_aid_band_sql('financial_aid_status')} AS segment, dropout_label AS label,
               {R(B.sql_prob(SC.SCORER_A), 4)} AS score FROM features)
  WHERE segment IS NOT NULL AND score IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
fa AS (
  SELECT segment, sum(n_pos) AS P, sum(n_neg) AS N,
         sum(n_pos * (neg_below + 0.5 * n_neg)) / nullif(sum(n_pos) * sum(n_neg), 0) AS auc,
         sum(CASE WHEN score >= {TAU} THEN n_pos ELSE 0 END) AS tp,
         sum(CASE WHEN NOT (score >= {TAU}) THEN n_neg ELSE 0 END) AS tn
  FROM (SELECT *, coalesce(sum(n_neg) OVER (PARTITION BY segment ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM fh)
  GROUP BY segment)
SELECT segment, (P + N)::BIGINT AS n, {R('P::DOUBLE / (P + N) * 100', 1)} AS dropout_rate,
       {R('(tp + tn)::DOUBLE / (P + N) * 100', 1)} AS model_accuracy,
       {R('CASE WHEN P > 0 AND N > 0 THEN auc END', 4)} AS auc
FROM fa WHERE P + N >= {K.FAIRNESS_MIN_GROUP}"""


@register("fairness_report", B.sql(*S.FEATURE_CTES, _FAIR.split("\nSELECT segment, (P")[0],
                                   select="SELECT segment, (P" + _FAIR.split("\nSELECT segment, (P", 1)[1]))
def q_fairness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11+P17: per aid band n, drop-out %, accuracy %, AUC (groups < 5 dropped)."""
    f = B.feature_table(spark, sf_dir).withColumn("score", fround(SC.SCORER_A.probability(), 4))
    return EV.fairness(f, "score", "dropout_label", FE.aid_band("financial_aid_status"), TAU)


COMPARE_METRICS = ["auc", "f1", "precision", "kappa"]


def _compare_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = q_score_histogram(spark, sf_dir)
    m = EV.classification_metrics(h, TAU, ["model"]).join(
        EV.auc(h, ["model"]).select("model", fround(F.col("auc"), 4).alias("auc")), "model")
    long = m.select("model", *COMPARE_METRICS).unpivot(["model"], COMPARE_METRICS, "metric", "value")
    base = long.where(F.col("model") == "rule").select("metric", F.col("value").alias("baseline_value"))
    # base has one row per metric (4 rows): bounded broadcast.
    j = long.where(F.col("model") != "rule").join(F.broadcast(base), "metric")
    return j.select("model", "metric", "value", "baseline_value",
                    fround(pct_change("value", "baseline_value"), 2).alias("improvement_pct"))


_COMPARE = f"""
auc_m AS (
  SELECT model, {R('sum(n_pos * (neg_below + 0.5 * n_neg)) / nullif(sum(n_pos) * sum(n_neg), 0)', 4)} AS auc
  FROM (SELECT *, coalesce(sum(n_neg) OVER ({W_ASC_EXCL}), 0) AS neg_below FROM hist) GROUP BY model),
met AS (SELECT m.model, a.auc, m.f1, m.precision, m.kappa FROM ({metrics_sql(f'{TAU}::DOUBLE')}) m JOIN auc_m a USING (model)),
lng AS (
  SELECT model, 'auc' AS metric, auc AS value FROM met UNION ALL SELECT model, 'f1', f1 FROM met
  UNION ALL SELECT model, 'precision', precision FROM met UNION ALL SELECT model, 'kappa', kappa FROM met)
SELECT l.model, l.metric, l.value, b.value AS baseline_value,
       {R('CASE WHEN b.value = 0 THEN 0.0 ELSE (l.value - b.value) / b.value * 100 END', 2)} AS improvement_pct
FROM lng l JOIN (SELECT metric, value FROM lng WHERE model = 'rule') b USING (metric)
WHERE l.model <> 'rule'"""


@register("model_comparison", B.sql(*CTES, _COMPARE.split("\nSELECT l.model")[0],
                                    select="SELECT l.model" + _COMPARE.split("\nSELECT l.model", 1)[1]))
def q_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12+E13+U2+F23: metrics of two scorers vs the rule baseline, improvement %."""
    return _compare_spark(spark, sf_dir)
