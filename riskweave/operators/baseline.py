"""Stored score baseline (E17, A23, L8): a histogram that batches are added to.

A baseline is a table of (v, n, total, total_sq): per score rounded to 4 decimals
the number of scores, their sum and sum of squares. Histograms add up, so a
baseline grows batch by batch, each batch under its own id (a repeated batch
replaces itself), and later checks and profiles read at most 10,001 values a
batch and never the raw rows. A new baseline is a new version; the old stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fround
from ..session import cut_lineage
from ..sources.versioned import next_folder, newest_folder
from . import logs as LG
from . import monitoring as MO

QUANTILES = [0.10, 0.25, 0.50, 0.75, 0.90]


def histogram(scores: DataFrame, score: str, digits: int = 4) -> DataFrame:
    """(v, n, total, total_sq) of the scores; null scores are left out."""
    return (scores.where(F.col(score).isNotNull()).groupBy(fround(F.col(score), digits).alias("v"))
                  .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(score).cast("double")).alias("total"),
                       F.sum(F.col(score).cast("double") * F.col(score)).alias("total_sq")))


def merge(histograms: DataFrame) -> DataFrame:
    """One histogram of several: counts and sums by value."""
    return histograms.groupBy("v").agg(*[F.sum(c).alias(c) for c in ("n", "total", "total_sq")])


def start(spark: SparkSession, root: str) -> str:
    """Folder of a new, empty baseline under ``root``; checks use it from its first batch on."""
    return next_folder(spark, root, "baseline=")


def add_batch(scores: DataFrame, score: str, baseline: str, batch: str) -> None:
    """Add the scores of a batch to a baseline."""
    LG.append(histogram(scores, score), baseline, batch)


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest baseline that has a batch, merged; None if there is none."""
    path = newest_folder(spark, root, "baseline=", "run_id=*")
    return merge(spark.read.parquet(path)) if path else None


def profile(hist: DataFrame) -> DataFrame:
    """A23 from a histogram: n, mean, population std, p10/25/50/75/90 (round 4). The
    percentiles are those of the rounded scores."""
    n = F.sum("n")
    mean = F.sum("total") / n
    std = F.sqrt(F.greatest(F.sum("total_sq") / n - mean * mean, F.lit(0.0)))
    agg = hist.agg(n.alias("n"), mean.alias("mean"), std.alias("std"), F.percentile("v", QUANTILES, F.col("n")).alias("_p"))
    return agg.select(F.coalesce("n", F.lit(0)).alias("n"), fround("mean", 4).alias("mean"), fround("std", 4).alias("std"),
                      *[fround(F.col("_p")[i], 4).alias(f"p{int(q * 100)}") for i, q in enumerate(QUANTILES)])


def check(spark: SparkSession, root: str, scores: DataFrame, score: str) -> DataFrame:
    """E14 + E15 + E16 + E17: verdict row of new scores against the stored baseline;
    level NO_BASELINE where none is stored."""
    current = histogram(scores, score).select("v", "n", "total", F.lit("current").alias("sample"))
    stored = read(spark, root)
    if stored is not None:
        current = current.unionByName(stored.select("v", "n", "total", F.lit("baseline").alias("sample")))
    return MO.drift_of(cut_lineage(current, "score-histogram"))
