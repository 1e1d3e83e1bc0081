"""Keyset pages, locale sort, child lists, stored baselines, sketches."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import baseline as BL
from riskweave.operators import dashboard as D
from riskweave.operators import features as FE
from riskweave.operators import monitoring as MO
from riskweave.operators import state as ST

ORDER = [("score", True), ("name", False), ("id", False)]


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0.1, 0.2, 0.3]), rng.choice([None, "a", "b"])) for i in range(500)]
    return spark.createDataFrame(rows, "id long, score double, name string").repartition(3).cache()


def test_keyset_equals_offset_at_any_depth(people):
    order = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in ORDER]
    after = None
    for n in range(1, 16):
        want = [r.id for r in D.page(people, order, n, 37).collect()]
        pg = D.keyset_page(people, ORDER, 37, after)
        assert [r.id for r in pg.collect()] == want
        if not want:
            break
        after = D.cursor(pg, ORDER)
    assert n == 15 and D.cursor(pg, ORDER) is None
    plan = D.keyset_page(people, ORDER, 37, {"score": 0.2, "name": "a", "id": 7})._jdf.queryExecution().toString()
    assert "offset" not in plan.lower()
    with pytest.raises(ValueError):
        D.keyset_page(people, ORDER, 501)


def test_sort_of_text_and_numbers(spark):
    rows = [(1, "éclair", 2.0, True), (2, "Zebra", None, None), (3, "apple", -1.0, False), (4, None, 1.0, True), (5, "Eagle", 0.5, None), (6, "APPLE", 3.0, False)]
    df = spark.createDataFrame(rows, "id int, name string, x double, f boolean")
    by = lambda col, desc=False: [r.id for r in df.orderBy(D.user_sort(df, col, desc), "id").collect()]
    assert by("name") == [4, 3, 6, 5, 1, 2]            # null first (as ''), case and accents don't count
    assert by("name", True) == [2, 1, 5, 3, 6, 4]
    assert by("x") == [3, 2, 5, 4, 1, 6] and by("f") == [2, 3, 5, 6, 1, 4]
    assert by("no such column") == by(None) == [1, 2, 3, 4, 5, 6]
    times = df.select("id", F.when(F.col("id") > 2, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("t"))
    assert [r.id for r in times.orderBy(D.user_sort(times, "t", False), "id").collect()] == [1, 2, 3, 4, 5, 6]


def test_child_lists_are_bounded_in_every_task(spark):
    persons = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    preds = spark.range(3000).select(
        F.when(F.col("id") < 2990, 1).otherwise(2).alias("k"), F.timestamp_seconds("id").alias("ts"), (F.col("id") / 10000).alias("risk_score"),
        F.when(F.col("id") == 100, '[{"feature":"quiz_average","value":1.0,"contribution":0.5}]').when(F.col("id") == 2995, "broken").alias("explanation"))
    steps = spark.createDataFrame([(i, 1, "SMS", "SENT", "SUCCESSFUL" if i % 2 else None, i % 3) for i in range(20)],
                                  "id int, k int, intervention_type string, status string, outcome string, d int").withColumn(
        "created_at", F.timestamp_seconds("d")).drop("d")
    out = ST.entity_360(persons, preds.repartition(4), steps, "k", 3)
    got = {r.k: r for r in out.collect()}
    assert [p.risk_score for p in got[1].predictions] == [0.2989, 0.2988, 0.2987] and got[1].n_predictions == 2990
    assert [i.id for i in got[1].interventions] == [17, 14, 11] and got[1].explanation[0].feature == "quiz_average"
    assert len(got[2].predictions) == 3 and got[2].interventions is None and got[2].explanation is None
    assert got[3].predictions is None and got[3].n_predictions is None
    plan = ST.newest_rows(preds, "k", [F.col("ts").desc()], 3, ["ts"], "p")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_baselines_add_up(spark, tmp_path):
    rng = random.Random(9)
    rows = [(round(rng.betavariate(2, 5), 4), i % 3) for i in range(900)] + [(None, 0)]
    df = spark.createDataFrame(rows, "s double, b int").cache()
    root = str(tmp_path)
    later = spark.createDataFrame([(round(rng.betavariate(3, 4), 4),) for _ in range(400)], "s double")
    assert BL.read(spark, root) is None and BL.check(spark, root, later, "s").first().drift_level == "NO_BASELINE"
    path = BL.start(spark, root)
    for b in (0, 1, 1, 2):   # a repeated batch counts once
        BL.add_batch(df.where(F.col("b") == b), "s", path, f"b{b}")
    whole, merged = (sorted(h.select("v", "n", F.round("total", 6)).collect()) for h in (BL.histogram(df, "s"), BL.read(spark, root)))
    assert whole == merged
    p, scores = BL.profile(BL.read(spark, root)).first(), sorted(s for s, _ in rows if s is not None)
    mean = sum(scores) / 900
    assert p.n == 900 and p.mean == pytest.approx(mean, abs=1e-4) and p.std == pytest.approx((sum((s - mean) ** 2 for s in scores) / 900) ** .5, abs=1e-4)
    exact = df.agg(F.percentile("s", [0.1, 0.5, 0.9])).first()[0]
    assert [p.p10, p.p50, p.p90] == pytest.approx(exact, abs=1e-4)
    both = df.select("s", F.lit("baseline").alias("sample")).unionByName(later.withColumn("sample", F.lit("current")))
    assert BL.check(spark, root, later, "s").first() == MO.drift_check(both, "s", "sample").first()
    new = BL.start(spark, root)   # a new baseline takes over with its first batch
    assert new != path and BL.read(spark, root).agg(F.sum("n")).first()[0] == 900
    BL.add_batch(later, "s", new, "b0")
    assert BL.read(spark, root).agg(F.sum("n")).first()[0] == 400


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 20_011).alias("x"), F.lit("one").alias("y"))
    parts = [FE.distinct_sketches(df.where((F.col("x") % 3 == i) | (F.col("x") < 100)), ["g"], ["x", "y"]) for i in range(3)]
    merged = FE.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"], ["x", "y"])
    got = {r.g: (r.x, r.y) for r in FE.sketch_counts(merged, ["g"], ["x", "y"]).collect()}
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct("x").alias("n")).collect()}
    assert all(abs(x - exact[g]) <= 3 * FE.sketch_error() * exact[g] and y == 1 for g, (x, y) in got.items())
    vle = df.select(F.col("g").alias("id_student"), F.lit("M").alias("code_module"), F.lit("P").alias("code_presentation"),
                    F.lit(1.0).alias("sum_click"), F.col("x").alias("id_site"))
    near, true = ({r.id_student: r.n_distinct_sites for r in FE.activity(vle, r).collect()} for r in (0.02, None))
    assert all(abs(near[g] - true[g]) < 0.08 * true[g] for g in true) and true == exact
