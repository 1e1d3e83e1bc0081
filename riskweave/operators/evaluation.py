"""Classifier evaluation on a score histogram.

Every statistic is computed from E1, ``(group..., score, n_pos, n_neg)``:
scores rounded to 4 decimals leave at most 10,001 rows per group at any input
size, so windows over the histogram (running sums down the score order) are
bounded, and only the histogram build touches the raw rows (one shuffle with
map-side partial aggregation). DeLong placements are joined back to the rows
through a broadcast of that bounded histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fround
from ..functions.stats import normal_two_sided_p

EPS = 1e-15


def score_histogram(df: DataFrame, score: str, label: str, groups: list[str] | None = None,
                    digits: int = 4) -> DataFrame:
    """(groups..., score, n_pos, n_neg) with the score rounded to ``digits``."""
    groups = groups or []
    s = fround(F.col(score), digits).alias("score")
    y = F.col(label)
    return (df.where(F.col(score).isNotNull() & y.isNotNull())
              .groupBy(*groups, s)
              .agg(F.sum(y).cast("long").alias("n_pos"), F.sum(1 - y).cast("long").alias("n_neg")))


def _w(groups: list[str], desc: bool = True, upto: int = 0):
    order = F.col("score").desc() if desc else F.col("score").asc()
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    return w.orderBy(order).rowsBetween(Window.unboundedPreceding, upto)


def _totals(groups: list[str]):
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    return F.sum("n_pos").over(w), F.sum("n_neg").over(w)


def roc_points(hist: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """E2 + W8: (groups..., threshold, tp, fp, tpr, fpr) down the score order,
    ties collapsed, plus the start point (0, 0) with a null threshold."""
    groups = groups or []
    P, N = _totals(groups)
    cum = (hist.withColumn("tp", F.sum("n_pos").over(_w(groups)))
               .withColumn("fp", F.sum("n_neg").over(_w(groups)))
               .withColumn("P", P).withColumn("N", N))
    pts = cum.select(*groups, F.col("score").alias("threshold"), "tp", "fp",
                     (F.col("tp") / F.nullif(F.col("P"), F.lit(0))).alias("tpr"),
                     (F.col("fp") / F.nullif(F.col("N"), F.lit(0))).alias("fpr"))
    start = hist.select(*groups).distinct().select(
        *groups, F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return pts.unionByName(start)


def auc(hist: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """ROC AUC with ties counted half; null when a group has one class."""
    groups = groups or []
    below = F.coalesce(F.sum("n_neg").over(_w(groups, desc=False, upto=-1)), F.lit(0))
    h = hist.withColumn("neg_below", below)
    g = h.groupBy(*groups).agg(
        F.sum(F.col("n_pos") * (F.col("neg_below") + 0.5 * F.col("n_neg"))).alias("_u"),
        F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"))
    return g.select(*groups, "P", "N", (F.col("_u") / F.nullif(F.col("P") * F.col("N"), F.lit(0))).alias("auc"))


def pr_auc(hist: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Trapezoid area under the precision-recall points (descending score),
    starting at (recall 0, precision 1)."""
    groups = groups or []
    P, _ = _totals(groups)
    cum = (hist.withColumn("tp", F.sum("n_pos").over(_w(groups)))
               .withColumn("fp", F.sum("n_neg").over(_w(groups)))
               .withColumn("P", P))
    pts = cum.select(*groups, "score",
                     (F.col("tp") / F.nullif(F.col("P"), F.lit(0))).alias("recall"),
                     (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))).orderBy(F.col("score").desc())
    seg = pts.select(
        *groups,
        ((F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0)))
         * (F.col("precision") + F.coalesce(F.lag("precision").over(w), F.lit(1.0))) / 2).alias("area"))
    return seg.groupBy(*groups).agg(F.sum("area").alias("pr_auc"))


def confusion(hist: DataFrame, tau: float | Column, groups: list[str] | None = None) -> DataFrame:
    """E5: tp, fp, tn, fn at ``score >= tau``."""
    groups = groups or []
    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    hit = F.col("score") >= t
    return hist.groupBy(*groups).agg(
        F.sum(F.when(hit, F.col("n_pos")).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(hit, F.col("n_neg")).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(~hit, F.col("n_neg")).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when(~hit, F.col("n_pos")).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.col("n_pos") * (1 - F.col("score")) ** 2 + F.col("n_neg") * F.col("score") ** 2).alias("_brier"),
        F.sum(-(F.col("n_pos") * F.log(F.greatest(F.col("score"), F.lit(EPS)))
                + F.col("n_neg") * F.log(F.greatest(1 - F.col("score"), F.lit(EPS))))).alias("_ll"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_metrics(hist: DataFrame, tau: float, groups: list[str] | None = None,
                           digits: int = 4) -> DataFrame:
    """E5 + E6: confusion counts, accuracy, precision, recall, F1 (0 on zero
    division), Cohen's kappa, sensitivity, specificity, Brier, log-loss."""
    groups = groups or []
    c = confusion(hist, tau, groups)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    kappa = F.when(pe < 1, (po - pe) / (1 - pe))
    r = lambda e: fround(e, digits)
    return c.select(
        *groups, "tp", "fp", "tn", "fn",
        r(po).alias("accuracy"), r(prec).alias("precision"), r(rec).alias("recall"), r(f1).alias("f1"),
        r(kappa).alias("kappa"), r(rec).alias("sensitivity"), r(_ratio(tn, tn + fp)).alias("specificity"),
        r(F.col("_brier") / n).alias("brier"), r(F.col("_ll") / n).alias("log_loss"))


def youden(roc: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """E7 + F24: threshold maximising tpr - fpr; ties -> highest J, then highest threshold."""
    groups = groups or []
    pts = roc.where(F.col("threshold").isNotNull()).withColumn("j", F.col("tpr") - F.col("fpr"))
    key = F.struct(F.col("j"), F.col("threshold"))
    return pts.groupBy(*groups).agg(
        F.max_by("threshold", key).alias("youden_threshold"),
        F.max("j").alias("youden_j"))


def placements(hist: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """E8 building block: per score value, V10 (for positives) and V01 (for negatives).

    V10(s) = (negatives below s + half the negatives at s) / N
    V01(s) = (positives above s + half the positives at s) / P
    """
    groups = groups or []
    P, N = _totals(groups)
    neg_below = F.coalesce(F.sum("n_neg").over(_w(groups, desc=False, upto=-1)), F.lit(0))
    pos_above = F.coalesce(F.sum("n_pos").over(_w(groups, desc=True, upto=-1)), F.lit(0))
    return hist.select(*groups, "score",
                       ((neg_below + 0.5 * F.col("n_neg")) / N).alias("v10"),
                       ((pos_above + 0.5 * F.col("n_pos")) / P).alias("v01"))


def delong(df: DataFrame, label: str, score_a: str, score_b: str, paired: bool = True,
           digits: int = 4) -> DataFrame:
    """E8 (paired, sample covariance) / E9 (unpaired: covariance dropped).

    One row: auc_a, auc_b, z, p_value, significant. Degenerate input (one
    class, or zero variance of the difference) gives z = 0, p = 1.
    """
    long = (df.select(F.col(label).alias("y"), F.lit("a").alias("m"), fround(F.col(score_a), digits).alias("score"))
              .unionByName(df.select(F.col(label).alias("y"), F.lit("b").alias("m"),
                                     fround(F.col(score_b), digits).alias("score"))))
    hist = score_histogram(long, "score", "y", ["m"], digits)
    pl = placements(hist, ["m"])
    # The placement table is bounded by 2 x 10,001 score values: safe to broadcast.
    pa = pl.where(F.col("m") == "a").select(F.col("score").alias("sa"), F.col("v10").alias("v10_a"),
                                            F.col("v01").alias("v01_a"))
    pb = pl.where(F.col("m") == "b").select(F.col("score").alias("sb"), F.col("v10").alias("v10_b"),
                                            F.col("v01").alias("v01_b"))
    rows = df.select(F.col(label).alias("y"), fround(F.col(score_a), digits).alias("sa"),
                     fround(F.col(score_b), digits).alias("sb")).where("y IS NOT NULL AND sa IS NOT NULL AND sb IS NOT NULL")
    rows = rows.join(F.broadcast(pa), "sa").join(F.broadcast(pb), "sb")
    pos, neg = F.col("y") == 1, F.col("y") == 0
    agg = rows.agg(
        F.count_if(pos).alias("P"), F.count_if(neg).alias("N"),
        F.avg(F.when(pos, F.col("v10_a"))).alias("auc_a"), F.avg(F.when(pos, F.col("v10_b"))).alias("auc_b"),
        F.var_samp(F.when(pos, F.col("v10_a"))).alias("va10"), F.var_samp(F.when(pos, F.col("v10_b"))).alias("vb10"),
        F.covar_samp(F.when(pos, F.col("v10_a")), F.when(pos, F.col("v10_b"))).alias("c10"),
        F.var_samp(F.when(neg, F.col("v01_a"))).alias("va01"), F.var_samp(F.when(neg, F.col("v01_b"))).alias("vb01"),
        F.covar_samp(F.when(neg, F.col("v01_a")), F.when(neg, F.col("v01_b"))).alias("c01"))
    cov10 = F.col("c10") if paired else F.lit(0.0)
    cov01 = F.col("c01") if paired else F.lit(0.0)
    var = ((F.col("va10") + F.col("vb10") - 2 * cov10) / F.col("P")
           + (F.col("va01") + F.col("vb01") - 2 * cov01) / F.col("N"))
    ok = (F.col("P") > 0) & (F.col("N") > 0) & (var > 0)
    z = F.when(ok, (F.col("auc_a") - F.col("auc_b")) / F.sqrt(var)).otherwise(F.lit(0.0))
    out = agg.select(fround(F.col("auc_a"), 4).alias("auc_a"), fround(F.col("auc_b"), 4).alias("auc_b"),
                     fround(z, 4).alias("z_statistic"), z.alias("_z"))
    p = normal_two_sided_p(F.col("_z"))
    return out.select("auc_a", "auc_b", "z_statistic", fround(p, 4).alias("p_value"),
                      (p < 0.05).alias("significant"),
                      F.when(F.col("auc_a") > F.col("auc_b"), "a").when(F.col("auc_a") < F.col("auc_b"), "b")
                      .otherwise("tie").alias("higher_auc"))


def calibration(df: DataFrame, score: str, label: str, n_bins: int = 10) -> DataFrame:
    """Quantile-bin calibration curve; bin = number of inner edges strictly
    below the score; empty bins never appear. Rows without a score or label are
    left out.

    The edges are fitted first (one aggregate of exact percentiles; the scores
    are rounded, so the percentile map is bounded) and applied as literals.
    """
    df = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    qs = [i / n_bins for i in range(1, n_bins)]
    edges = df.agg(F.percentile(score, qs).alias("e")).first()["e"] or []
    arr = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    b = df.withColumn("bin", F.size(F.filter(arr, lambda e: e < F.col(score))))
    return b.groupBy("bin").agg(
        fround(F.avg(score), 4).alias("mean_predicted"),
        fround(F.avg(F.col(label).cast("double")), 4).alias("fraction_positive"),
        F.count(F.lit(1)).alias("n"))


def fairness(df: DataFrame, score: str, label: str, segment: Column, tau: float,
             min_group: int = K.FAIRNESS_MIN_GROUP) -> DataFrame:
    """Per segment n, positive rate %, accuracy %, AUC (null if one class);
    segments below ``min_group`` rows and null segments are dropped."""
    seg = df.withColumn("segment", segment).where(F.col("segment").isNotNull())
    hist = score_histogram(seg, score, label, ["segment"])
    a = auc(hist, ["segment"])
    c = confusion(hist, tau, ["segment"])
    j = a.join(c, "segment")
    n = F.col("P") + F.col("N")
    return j.where(n >= min_group).select(
        "segment", n.alias("n"),
        fround(F.col("P") / n * 100, 1).alias("dropout_rate"),
        fround((F.col("tp") + F.col("tn")) / n * 100, 1).alias("model_accuracy"),
        fround(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("auc")), 4).alias("auc"))


def roc_report(df: DataFrame, score: str, label: str, model: str, min_rows: int = 20) -> DataFrame:
    """Thinned ROC points of each model; none for a model with under ``min_rows`` labelled rows."""
    hist = score_histogram(df, score, label, [model])
    enough = hist.groupBy(model).agg(F.sum(F.col("n_pos") + F.col("n_neg")).alias("_rows")).where(F.col("_rows") >= min_rows)
    return thin_curve(roc_points(hist.join(enough.select(model), model, "left_semi"), [model]), [model])


def merge_curves(curves: DataFrame, names: dict[str, str], model: str = "model") -> DataFrame:
    """Curves side by side by position: (position, fpr_<name>, tpr_<name>, ...). A
    thinned curve has some twenty points, so its window is small."""
    w = Window.partitionBy(model).orderBy("fpr", "tpr", F.col("threshold").desc_nulls_first())
    at = curves.withColumn("position", F.row_number().over(w))
    cols = [F.max(F.when(F.col(model) == m, F.col(c))).alias(f"{c}_{n}") for m, n in names.items() for c in ("fpr", "tpr")]
    return at.groupBy("position").agg(*cols)


def thin_curve(roc: DataFrame, groups: list[str] | None = None, target_points: int = 21) -> DataFrame:
    """Keep every k-th point of each curve (about ``target_points``), always
    keeping the end point (1, 1)."""
    groups = groups or []
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))).orderBy(
        F.col("fpr"), F.col("tpr"), F.col("threshold").desc_nulls_first())
    cnt = F.count(F.lit(1)).over(Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1)))
    r = roc.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", cnt)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / (target_points - 1)))
    keep = (F.pmod(F.col("_i"), step) == 0) | (F.col("_i") == F.col("_n") - 1)
    return r.where(keep).drop("_i", "_n")
