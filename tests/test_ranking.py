"""The rank primitive at cluster settings and on awkward keys."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import splits as SP
from riskweave.operators.ranking import avg_pct_rank, value_counts_cumulative


@pytest.mark.parametrize("n_ranges, bound", [(1, 0), (8, 0), (1000, 0), (4000, 0), (8, 10), (8, 1000)])
def test_running_counts_at_any_number_of_ranges(spark, n_ranges, bound):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randint(0, 60) / 7) for _ in range(500)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.v): (r.cnt, r.cnt_below, r.n_total) for r in
           value_counts_cumulative(df, "v", n_ranges=n_ranges, groups=["g"], bound=bound).collect()}
    vals = [r for r in rows if r[1] is not None]
    want = {(g, v): (sum(x == (g, v) for x in vals), sum(x[0] == g and x[1] < v for x in vals), sum(x[0] == g for x in vals))
            for g, v in set(vals)}
    assert got == want


def test_feature_job_at_cluster_partitions(spark, sf_dir):
    from riskweave.plans import base as B
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {tuple(r) for r in B.feature_table(spark, sf_dir).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        assert {tuple(r) for r in B.feature_table(spark, sf_dir).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_text_keys_beyond_ascii_and_with_a_common_prefix(spark):
    keys = [f"student-2024-{i:05d}" for i in range(300)] + ["é", "日本", "z", "Ω", "\U0001f600", "", "student-2024-"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.cnt_below for r in value_counts_cumulative(df, "k", n_ranges=40).collect()}
    order = sorted(keys, key=lambda k: k.encode())
    assert got == {k: i for i, k in enumerate(order)}


def test_common_prefix_is_spread_over_ranges(spark):
    from riskweave.session import _SCRATCH
    df = spark.range(4000).select(F.concat(F.lit("same-long-prefix-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"))
    value_counts_cumulative(df, "k", n_ranges=16).count()
    ranges = next(p for p in reversed(_SCRATCH) if "/ranges-" in p)
    sizes = [r["count"] for r in spark.read.parquet(ranges).groupBy("_range").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1000


def test_pct_rank_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, None)], "id int, v double")
    assert {r.id: r.p for r in avg_pct_rank(df, "v", "p").collect()} == {1: 1 / 3, 2: 2.5 / 3, 3: 2.5 / 3, 4: None}


def test_splits_and_folds(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    rows = SP.split_and_folds(df, "k", "y").collect()
    for label, n in ((0, 900), (1, 100)):
        of = [r for r in rows if r.y == label]
        assert len(of) == n
        share = {s: sum(r.split == s for r in of) / n for s in ("train", "valid", "test")}
        assert share == {"train": 0.7, "valid": 0.15, "test": 0.15}
        sizes = [sum(r.fold == f for r in of) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    again = {r.k: (r.split, r.fold) for r in SP.split_and_folds(df.repartition(3), "k", "y").collect()}
    assert again == {r.k: (r.split, r.fold) for r in rows}
    quick = SP.hash_split(df, "k").groupBy("split").count().collect()
    assert {r.split: round(r["count"] / 1000, 1) for r in quick} == {"train": 0.7, "valid": 0.2, "test": 0.1} or \
        all(abs(r["count"] / 1000 - {"train": .7, "valid": .15, "test": .15}[r.split]) < 0.04 for r in quick)
