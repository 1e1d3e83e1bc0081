"""Deterministic stratified splits, folds and standardisation (M1-M3, M17 sizes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .ranking import value_counts_cumulative


def order_key(id_col: str, seed: int = K.SEED) -> Column:
    """Seeded pseudo-random order: md5 hex of ``id:seed`` (same hex in any engine)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def stratified_positions(df: DataFrame, id_col: str, label: str, seed: int = K.SEED) -> DataFrame:
    """Adds ``_pos`` (0-based rank in the seeded order within the label) and ``_n``
    (label size); exact, and no window holds a whole label (ranks come from
    range-partitioned running counts)."""
    keyed = df.withColumn("_key", order_key(id_col, seed))
    ranks = value_counts_cumulative(keyed, "_key", groups=[label]).select(
        label, "_key", F.col("cnt_below").alias("_pos"), F.col("n_total").alias("_n"))
    return keyed.join(ranks, [label, "_key"])


def split_of(pos: Column, n: Column, fractions=(K.SPLIT_TRAIN, K.SPLIT_VALID),
             names=("train", "valid", "test")) -> Column:
    """Split name by position / size against cumulative fractions."""
    frac, cut = pos / n, fractions[0]
    out = F.when(frac < cut, names[0])
    if len(fractions) > 1:
        out = out.when(frac < cut + fractions[1], names[1])
    return out.otherwise(names[-1])


def stratified_split(df: DataFrame, id_col: str, label: str, fractions=(K.SPLIT_TRAIN, K.SPLIT_VALID),
                     seed: int = K.SEED, names=("train", "valid", "test")) -> DataFrame:
    """M1: exact split per label in the seeded order."""
    p = stratified_positions(df, id_col, label, seed)
    return p.withColumn("split", split_of(F.col("_pos"), F.col("_n"), fractions, names)).drop("_key", "_pos", "_n")


def hash_split(df: DataFrame, id_col: str, fractions=(K.SPLIT_TRAIN, K.SPLIT_VALID), seed: int = K.SEED,
               names=("train", "valid", "test")) -> DataFrame:
    """M1, threshold mode: the split from the id's hash alone. Needs no shuffle and is
    stable when rows are added; sizes meet the fractions in expectation only."""
    u = F.conv(F.substring(order_key(id_col, seed), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    return df.withColumn("split", split_of(u, F.lit(1.0), fractions, names))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = K.N_FOLDS, seed: int = K.SEED) -> DataFrame:
    """M2: fold = position within the label modulo k (fold sizes differ by <= 1)."""
    p = stratified_positions(df, id_col, label, seed)
    return p.withColumn("fold", (F.col("_pos") % k).cast("int")).drop("_key", "_pos", "_n")


def split_and_folds(df: DataFrame, id_col: str, label: str, k: int = K.N_FOLDS, seed: int = K.SEED) -> DataFrame:
    """M1 + M2 from one ranking pass: ``split`` and ``fold``."""
    p = stratified_positions(df, id_col, label, seed)
    return (p.withColumn("split", split_of(F.col("_pos"), F.col("_n")))
             .withColumn("fold", (F.col("_pos") % k).cast("int")).drop("_key", "_pos", "_n"))


def fit_standardizer(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """M3 fit: mean and population std of each column on the training rows
    (one aggregate; only the metric row reaches the driver)."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                    *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0)) for c in cols}


def apply_standardizer(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """M3 apply: (x - mean) / std; a zero std leaves (x - mean)."""
    for c, (m, s) in params.items():
        df = df.withColumn(c + suffix, (F.col(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0))
    return df


def learning_curve_sizes(n: int, fractions=tuple(i / 10 for i in range(1, 11)), minimum: int = 50) -> list[int]:
    """n = max(50, floor(N * f)) for each fraction (capped at N)."""
    return [min(n, max(minimum, int(n * f))) for f in fractions]
