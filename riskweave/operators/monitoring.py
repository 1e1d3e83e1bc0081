"""Score-distribution monitoring: PSI, KS, mean shift, drift verdict, synthetic-data
quality (E14-E20)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fround
from ..functions.stats import kolmogorov_p
from ..session import cut_lineage
from .ranking import value_counts_cumulative


def sample_histogram(df: DataFrame, score: str, sample: str, digits: int | None = 4) -> DataFrame:
    """(sample, v, n, total) of the scores rounded to ``digits`` (None: as they are): all
    that PSI, KS and the means need, in at most samples x 10**digits rows for scores in [0, 1]."""
    v = F.col(score) if digits is None else fround(F.col(score), digits)
    return (df.where(F.col(score).isNotNull() & F.col(sample).isNotNull())
              .groupBy(F.col(sample).alias("sample"), v.alias("v"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("total")))


def bin_shares(hist: DataFrame, n_bins: int = K.PSI_BINS) -> DataFrame:
    """Per (sample, bin) share of the sample; values outside [0, 1] count in
    the denominator only. Output has every bin 0..n-1 (empty -> share 0)."""
    inside = (F.col("v") >= 0) & (F.col("v") <= 1)
    b = F.when(inside, F.least(F.floor(F.col("v") * n_bins), F.lit(n_bins - 1)).cast("int"))
    per = hist.groupBy("sample").agg(F.sum("n").alias("_n"), *[
        F.coalesce(F.sum(F.when(b == i, F.col("n"))), F.lit(0)).alias(f"b{i}") for i in range(n_bins)])
    long = per.unpivot(["sample", "_n"], [f"b{i}" for i in range(n_bins)], "bin", "cnt")
    return long.select("sample", F.substring("bin", 2, 4).cast("int").alias("bin"),
                       (F.col("cnt") / F.col("_n")).alias("share"))


def psi(df: DataFrame, score: str, sample: str, expected: str, actual: str, n_bins: int = K.PSI_BINS) -> DataFrame:
    """Sum over bins of (a - e) * ln(a / e); empty shares -> 1e-4."""
    return psi_of(sample_histogram(df, score, sample, None), expected, actual, n_bins)


def psi_of(hist: DataFrame, expected: str, actual: str, n_bins: int = K.PSI_BINS) -> DataFrame:
    """E14 from a sample histogram."""
    sh = bin_shares(hist.where(F.col("sample").isin(expected, actual)), n_bins)
    floor_ = lambda c: F.when(c == 0, F.lit(K.PSI_FLOOR)).otherwise(c)
    wide = sh.groupBy("bin").agg(
        floor_(F.coalesce(F.max(F.when(F.col("sample") == expected, F.col("share"))), F.lit(0.0))).alias("e"),
        floor_(F.coalesce(F.max(F.when(F.col("sample") == actual, F.col("share"))), F.lit(0.0))).alias("a"))
    return wide.agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


def ks_statistic(df: DataFrame, value: str, sample: str, s1: str, s2: str,
                 groups: list[str] | None = None, digits: int | None = None, weight: str | None = None) -> DataFrame:
    """Two-sample KS D = max |F1 - F2| and its asymptotic p-value.

    The samples are reduced to (value, n1, n2) rows. ``digits`` rounds the values
    first, which bounds the rows (10**digits for values in [0, 1]), so one window
    per group runs over them; without it the values are taken as they are and the
    running counts are split over ranges of values. An empty sample gives null.
    """
    groups = groups or []
    v = F.col(value) if digits is None else fround(F.col(value), digits)
    one = F.col(weight) if weight else F.lit(1)
    of = lambda s: F.sum(F.when(F.col(sample) == s, one).otherwise(0)).cast("long")
    h = (df.where(F.col(value).isNotNull() & F.col(sample).isin(s1, s2))
           .groupBy(*groups, v.alias("v")).agg(of(s1).alias("c1"), of(s2).alias("c2")))
    if digits is None:
        h = cut_lineage(h, "ks")
        one_, two = (value_counts_cumulative(h, "v", weight_col=c, groups=groups).select(
            *groups, "v", (F.col("cnt_below") + F.col("cnt")).alias(f"u{i}"), F.col("n_total").alias(f"n{i}"))
            for i, c in ((1, "c1"), (2, "c2")))
        c = one_.join(two, [*groups, "v"]).select(
            *groups, F.try_divide("u1", "n1").alias("f1"), F.try_divide("u2", "n2").alias("f2"), "n1", "n2")
    else:
        gw = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
        cw = gw.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        c = h.select(*groups, F.try_divide(F.sum("c1").over(cw), F.sum("c1").over(gw)).alias("f1"),
                     F.try_divide(F.sum("c2").over(cw), F.sum("c2").over(gw)).alias("f2"),
                     F.sum("c1").over(gw).alias("n1"), F.sum("c2").over(gw).alias("n2"))
    d = c.groupBy(*groups).agg(F.max(F.abs(F.col("f1") - F.col("f2"))).alias("ks"),
                               F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    return d.withColumn("ks_p", kolmogorov_p(F.col("ks"), F.col("n1").cast("double"), F.col("n2").cast("double")))


def drift_check(df: DataFrame, score: str, sample: str, baseline: str = "baseline",
                current: str = "current", digits: int = 4) -> DataFrame:
    """E14 + E15 + E16 + E17: one verdict row (PSI, KS, mean shift %, level).

    The input is read once, into a histogram of the scores rounded to ``digits``.
    """
    return drift_of(cut_lineage(sample_histogram(df, score, sample, digits), "score-histogram"), baseline, current, digits)


def drift_of(hist: DataFrame, baseline: str = "baseline", current: str = "current", digits: int = 4) -> DataFrame:
    """The verdict row from a histogram (sample, v, n, total), which three passes read.
    Without any baseline score the level is NO_BASELINE and nothing is detected."""
    p = psi_of(hist, baseline, current)
    k = ks_statistic(hist, "v", "sample", baseline, current, digits=digits, weight="n")
    mean = lambda s: F.sum(F.when(F.col("sample") == s, F.col("total"))) / F.sum(
        F.when(F.col("sample") == s, F.col("n")))
    m = hist.agg(mean(baseline).alias("mb"), mean(current).alias("mc"))
    # three 1-row aggregates combined by a union + max: no cross join.
    names = ("psi", "ks", "ks_p", "mb", "mc")
    pad = lambda d: d.select(*[(F.col(c) if c in d.columns else F.lit(None)).cast("double").alias(c)
                               for c in names])
    one = pad(p).unionByName(pad(k)).unionByName(pad(m)).agg(*[F.max(c).alias(c) for c in names])
    has = F.col("mb").isNotNull()
    shown = lambda c: F.when(has, c)
    shift = F.abs(F.col("mc") - F.col("mb")) / F.greatest(F.col("mb"), F.lit(0.01)) * 100
    level = (F.when(~has, "NO_BASELINE")
              .when((F.col("psi") > K.PSI_SIGNIFICANT) | (F.col("ks") > K.KS_THRESHOLD), "SIGNIFICANT")
              .when(F.col("psi") > K.PSI_WARNING, "MINOR").otherwise("NONE"))
    return one.select(shown(fround(F.col("psi"), 4)).alias("psi"), shown(fround(F.col("ks"), 4)).alias("ks_statistic"),
                      shown(fround(F.col("ks_p"), 4)).alias("ks_p_value"),
                      fround(shift, 1).alias("mean_shift_pct"), level.alias("drift_level"),
                      (level == "SIGNIFICANT").alias("drift_detected"))


def correlation_similarity(df: DataFrame, sample: str, s1: str, s2: str, cols: list[str]) -> DataFrame:
    """1 - mean |R1 - R2| over the full k x k correlation matrices
    (diagonal differences are 0, each off-diagonal pair counts twice)."""
    pairs = list(combinations(cols, 2))
    def corr_of(s: str, a: str, b: str) -> Column:
        w = F.col(sample) == s
        return F.corr(F.when(w, F.col(a)), F.when(w, F.col(b)))
    agg = df.agg(*[F.abs(corr_of(s1, a, b) - corr_of(s2, a, b)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)])
    total = sum((F.col(f"d{i}") for i in range(len(pairs))), F.lit(0.0))
    return agg.select((F.lit(1.0) - 2 * total / (len(cols) ** 2)).alias("correlation_similarity"))


def synthetic_quality(df: DataFrame, sample: str, s1: str, s2: str, cols: list[str],
                      digits: int | None = None) -> DataFrame:
    """E18 + E19 + E20: KS complement averaged over features, correlation
    similarity, thresholds, sizes and label rates of two equal-schema samples.
    Values are compared as they are, or rounded to ``digits`` if given. ``df`` feeds
    three passes: pass a written table."""
    long = df.select(sample, *cols).unpivot([sample], cols, "feature", "value")
    ks = ks_statistic(long, "value", sample, s1, s2, ["feature"], digits=digits)
    ksc = ks.agg(F.avg(1 - F.col("ks")).alias("ks_complement"))
    cs = correlation_similarity(df, sample, s1, s2, cols)
    sizes = df.agg(F.count_if(F.col(sample) == s1).alias("n_a"), F.count_if(F.col(sample) == s2).alias("n_b"),
                   F.avg(F.when(F.col(sample) == s1, F.col("dropout_label"))).alias("rate_a"),
                   F.avg(F.when(F.col(sample) == s2, F.col("dropout_label"))).alias("rate_b"))
    cols_out = ["ks_complement", "correlation_similarity", "n_a", "n_b", "rate_a", "rate_b"]
    def pad(d: DataFrame, keep: list[str]) -> DataFrame:
        return d.select(*[F.col(c).cast("double").alias(c) if c in keep else F.lit(None).cast("double").alias(c)
                          for c in cols_out])
    one = (pad(ksc, ["ks_complement"]).unionByName(pad(cs, ["correlation_similarity"]))
           .unionByName(pad(sizes, ["n_a", "n_b", "rate_a", "rate_b"])).agg(*[F.max(c).alias(c) for c in cols_out]))
    return one.select(
        fround(F.col("ks_complement"), 4).alias("ks_complement"),
        fround(F.col("correlation_similarity"), 4).alias("correlation_similarity"),
        (F.col("ks_complement") >= K.KS_COMPLEMENT_MIN).alias("ks_pass"),
        (F.col("correlation_similarity") >= K.CORR_SIMILARITY_MIN).alias("corr_pass"),
        F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"),
        fround(F.col("rate_a") * 100, 2).alias("label_rate_a_pct"),
        fround(F.col("rate_b") * 100, 2).alias("label_rate_b_pct"))
