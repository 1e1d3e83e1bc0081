"""Global ranking without a single-partition window (W1, W8 building blocks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def value_counts_cumulative(df: DataFrame, value_col: str, n_ranges: int | None = None,
                            weight_col: str | None = None, groups: list[str] | None = None, bound: int = 0) -> DataFrame:
    """Distinct (groups, value) with their count and the count of smaller values
    in the same group: (groups..., value, cnt, cnt_below, n_total).

    The distinct values are range-partitioned on the value itself (any orderable
    type, Spark's own order) and written once with the number of their range, so
    every later step sees the same ranges, also after a lost executor. Each range
    computes running totals, and the totals of the ranges before it (a table of
    ranges x groups rows) are added. No window sees a whole group, and no
    expression grows with the number of ranges. Null values and null groups are
    left out.

    Up to ``bound`` distinct values, which are then written and counted first, one
    window per group gives the same: that many rows are not worth the ranges.
    """
    groups = groups or []
    n_ranges = n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.col(weight_col) if weight_col else F.lit(1)
    vals = (df.where(F.col(value_col).isNotNull())
              .groupBy(*groups, value_col).agg(F.sum(weight).cast("long").alias("cnt")))
    if bound:
        vals = cut_lineage(vals, "values")
        if vals.count() <= bound:  # from the footers of the written table
            gw = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
            below = gw.orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
            present = vals.dropna(subset=groups) if groups else vals
            return present.select(*groups, value_col, "cnt", F.coalesce(F.sum("cnt").over(below), F.lit(0)).alias("cnt_below"),
                                  F.sum("cnt").over(gw).alias("n_total"))
    ranged = cut_lineage(vals.repartitionByRange(n_ranges, value_col)
                             .withColumn("_range", F.spark_partition_id()), "ranges")
    in_range = (Window.partitionBy("_range", *groups).orderBy(value_col)
                .rowsBetween(Window.unboundedPreceding, 0))
    local = ranged.withColumn("_local_cum", F.sum("cnt").over(in_range))
    per_range = ranged.groupBy("_range", *groups).agg(F.sum("cnt").alias("_range_total"))
    # ranges x groups rows: windows over it are tiny.
    gw = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    offsets = per_range.select(
        "_range", *groups,
        F.coalesce(F.sum("_range_total").over(gw.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"),
        F.sum("_range_total").over(gw).alias("n_total"),
    )
    # Both sides are partitioned by (range, groups) already: the join adds no shuffle of the values.
    return (local.join(offsets, ["_range", *groups])
                 .select(*groups, value_col, "cnt",
                         (F.col("_offset") + F.col("_local_cum") - F.col("cnt")).alias("cnt_below"),
                         "n_total"))


def pct_ranks(df: DataFrame, value_col: str, out_col: str, groups: list[str] | None = None, bound: int = 0) -> DataFrame:
    """W1 as a table: (groups..., value, percentile rank with ties averaged), a row
    per distinct value. Nulls are excluded.

    pct = (count below + (ties + 1) / 2) / n, i.e. pandas ``rank(pct=True)``;
    not ``percent_rank`` ((rank - 1) / (n - 1)) nor ``cume_dist``.
    """
    return value_counts_cumulative(df, value_col, groups=groups, bound=bound).select(
        *(groups or []), value_col,
        ((F.col("cnt_below") + (F.col("cnt") + 1) / 2) / F.col("n_total")).alias(out_col))


def avg_pct_rank(df: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """Adds the percentile rank of a column (null -> null).

    The rank table is written first, so the join back knows its size: a small one
    is broadcast, and few, frequent values shuffle nothing.
    """
    return df.join(cut_lineage(pct_ranks(df, value_col, out_col), "ranks"), value_col, "left")
