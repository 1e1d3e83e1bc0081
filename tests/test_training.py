"""Model jobs: coverage, repeatability, metric ranges, standardiser, store."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.operators import features as FE
from riskweave.operators import splits as SP
from riskweave.operators import retraining as RT
from riskweave.operators import training as TR
from riskweave.sources import models as MS

FEATS = K.ALL_FEATURES


@pytest.fixture(scope="module")
def rows(spark):
    """300 students whose risk falls with attendance and quiz, with noise."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 100, (300, 3))
    data = []
    for i, (a, q, s) in enumerate(x.round(2).tolist()):
        p = 1 / (1 + np.exp(0.08 * (a - 45) + 0.06 * (q - 45)))
        data.append((f"k{i}", a, q, s, float(i % 20), float(1 + i % 10), int(rng.random() < p)))
    names = "student_key string, " + ", ".join(f"{f} double" for f in K.BASE_FEATURES) + ", dropout_label int"
    df = TR.with_label(FE.engineer(spark.createDataFrame(data, names)))
    return SP.split_and_folds(df, "student_key", "dropout_label").coalesce(2).cache()


def metrics(scored, name="m"):
    return {r["metric"]: r["value"] for r in TR.test_metrics(scored, 0.5, name).collect()}


def check_ranges(m):
    assert 0.5 < m["auc"] <= 1 and all(0 <= m[k] <= 1 for k in ("accuracy", "precision", "recall", "f1", "brier"))
    assert -1 <= m["kappa"] <= 1 and m["log_loss"] >= 0


def test_logistic_is_the_penalised_maximum(rows):
    train = rows.where("split = 'train'")
    m = TR.StandardizedLogistic(FEATS).fit(train)
    pdf = train.toPandas()
    for f, (mean, std) in m.params.items():
        assert mean == pytest.approx(pdf[f].mean()) and std == pytest.approx(pdf[f].std(ddof=0))
    z = np.stack([(pdf[f] - mu) / sd for f, (mu, sd) in m.params.items()], axis=1)
    w, b, y = np.zeros(z.shape[1]), 0.0, pdf["label"].to_numpy()
    for _ in range(200):  # Newton steps on the sum of losses plus |w|^2 / 2
        p = 1 / (1 + np.exp(-(z @ w + b)))
        za = np.c_[z, np.ones(len(z))]
        g = za.T @ (p - y) + np.r_[w, 0]
        h = (za * (p * (1 - p))[:, None]).T @ za + np.diag(np.r_[np.ones(len(w)), 0])
        step = np.linalg.solve(h, g)
        w, b = w - step[:-1], b - step[-1]
    lr = m.model.stages[-1]
    assert np.allclose(lr.coefficients.toArray(), w, atol=1e-3) and abs(lr.intercept - b) < 1e-3
    check_ranges(metrics(TR.positive_probability(m, rows.where("split = 'test'"))))


def test_boosted_is_seeded_and_importances_sum_to_one(spark, rows):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    fits = [TR.gbt_pipeline(FEATS, max_iter=5).fit(train) for _ in range(2)]
    scores = [sorted((r.student_key, r.score) for r in TR.positive_probability(m, test).collect()) for m in fits]
    assert scores[0] == scores[1]
    imp = [r.importance for r in TR.feature_importance(spark, fits[0], FEATS).collect()]
    assert abs(sum(imp) - 1) < 1e-4 and imp == sorted(imp, reverse=True) and len(imp) == 7
    check_ranges(metrics(TR.positive_probability(fits[0], test)))


def test_defaults_are_the_applications_budgets():
    gbt = TR.gbt_pipeline(FEATS).getStages()[-1]
    assert (gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize(), gbt.getSubsamplingRate()) == (300, 5, 0.05, 0.8)
    maps = TR.random_param_maps(GBTClassifier())
    assert len(maps) == 100 and len({str(m) for m in maps}) > 90
    assert TR.random_param_maps(GBTClassifier()) is not None and K.STACK_ITERATIONS == 400


def test_out_of_fold_covers_every_row_once(rows):
    learners = {"lr": TR.StandardizedLogistic(FEATS), "gbt": TR.gbt_pipeline(FEATS, max_iter=2)}
    train = rows.where("split = 'train'")
    oof = TR.out_of_fold(train, learners, K.N_FOLDS).select("student_key", "p_lr", "p_gbt").collect()
    assert sorted(r.student_key for r in oof) == sorted(r.student_key for r in train.select("student_key").collect())
    assert all(0 <= r.p_lr <= 1 and 0 <= r.p_gbt <= 1 for r in oof)


def test_stack_is_saved_as_one_bundle(spark, rows, tmp_path):
    bases, meta = TR.stacking_fit(rows.where("split = 'train'").drop("split"), FEATS, max_iter=3, forest_trees=5)
    assert set(bases) == {"gbt", "gbt2", "rf", "lr"}
    test = rows.where("split = 'test'")
    scored = TR.stacking_predict(bases, meta, test)
    check_ranges(metrics(scored))
    assert {r.risk_band for r in scored.collect()} <= {"LOW", "MEDIUM", "HIGH"}
    MS.save_bundle(bases | {"meta": meta}, str(tmp_path), "v20240101_000000", FEATS, {"auc": 0.9, "f1": 0.8})
    models, row = MS.load_bundle(spark, str(tmp_path))
    again = TR.stacking_predict({n: m for n, m in models.items() if n != "meta"}, models["meta"], test)
    cols = ["student_key", "score", "p_gbt", "p_gbt2", "p_rf", "p_lr"]
    assert sorted(again.select(*cols).collect()) == sorted(scored.select(*cols).collect())
    assert row.count() == 1 and [m["name"] for m in row.first()["models"]] == ["gbt", "gbt2", "rf", "lr", "meta"]
    MS.save_bundle({}, str(tmp_path), "v20240102_000000", FEATS, {"auc": 0.95})
    got = {(r.version, r.metric): (r.value, r.is_newest) for r in MS.model_metrics(spark, str(tmp_path)).collect()}
    assert got == {("v20240101_000000", "auc"): (0.9, False), ("v20240101_000000", "f1"): (0.8, False), ("v20240102_000000", "auc"): (0.95, True)}
    assert MS.model_metrics(spark, str(tmp_path / "none")).count() == 0


def test_a_finished_fold_is_not_fitted_again(rows, tmp_path):
    class Counting:
        fits = []

        def __init__(self, dies_at=None):
            self.inner, self.dies_at = TR.gbt_pipeline(FEATS, max_iter=1), dies_at

        def fit(self, train):
            folds = {r.fold for r in train.select("fold").distinct().collect()}
            left_out = (set(range(K.N_FOLDS)) - folds).pop()
            if left_out == self.dies_at:
                raise RuntimeError("executor lost")
            self.fits.append(left_out)
            return self.inner.fit(train)

    train = rows.where("split = 'train'")
    with pytest.raises(RuntimeError):
        TR.out_of_fold(train, {"gbt": Counting(dies_at=3)}, K.N_FOLDS, str(tmp_path))
    assert sorted(Counting.fits) == [0, 1, 2, 4]
    oof = TR.out_of_fold(train, {"gbt": Counting()}, K.N_FOLDS, str(tmp_path))
    assert sorted(Counting.fits) == [0, 1, 2, 3, 4]
    assert sorted(r.student_key for r in oof.collect()) == sorted(r.student_key for r in train.collect())
    folds = {r.student_key: r.fold for r in train.collect()}
    assert all(folds[r.student_key] == r.fold for r in oof.collect())


def test_feedback_retraining_logs_one_run(spark, rows, tmp_path):
    base = rows.drop("split", "fold").withColumn("person", F.expr("cast(substring(student_key, 2) AS int)")).withColumn(
        "dropout_label", F.col("label").cast("int"))
    outcomes = spark.createDataFrame([(i, "SUCCESSFUL" if i % 3 == 0 else "UNSUCCESSFUL") for i in range(1, 60)], "student_id int, outcome string")
    args = ("student_key", "person", FEATS, str(tmp_path / "models"), "v20240101_000000", str(tmp_path / "runs"), "2024-01-01 00:00:00")
    for _ in range(2):  # a repeated run replaces its rows
        report, stats = RT.retrain_on_feedback(base, outcomes, *args, str(tmp_path / "work"), max_iter=2, forest_trees=3)
    got = {(r.model, r.metric): r.value for r in report.collect()}
    log = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert len(log) == 1 and log[0].auc == got["stack", "auc"] and {m for m, _ in got} == {"stack", "gbt", "gbt2", "rf", "lr"}
    assert {r.metric: r.value for r in stats.collect()}["labels_overridden"] > 0
    assert MS.load_bundle(spark, str(tmp_path / "models"))[1].first()["version"] == "v20240101_000000"
    none, _ = RT.retrain_on_feedback(base, outcomes.withColumn("outcome", F.lit("PENDING")), *args)
    assert none.count() == 0 and len(spark.read.parquet(str(tmp_path / "runs")).collect()) == 1


def test_search_takes_the_best_trial(rows):
    gbt = GBTClassifier(featuresCol="features", labelCol="label", seed=K.SEED)
    maps = [{gbt.maxIter: 1, gbt.maxDepth: d} for d in (1, 3)]
    cv = TR.cv_search(rows.where("split = 'train'").drop("split"), FEATS, param_maps=maps, estimator=gbt, parallelism=1, n_folds=2 + 3)
    assert len(cv.avgMetrics) == 2 and all(0.5 <= a <= 1 for a in cv.avgMetrics)


def test_fold_summary(spark):
    rows = spark.createDataFrame([("f1", k, v) for k, v in enumerate([0.9, 1.0, 0.8, 0.9, 0.9])], "metric string, fold int, value double")
    r = TR.metric_summary(rows).first()
    assert (r["mean"], r["min"], r["max"], r.ci_fold_spread_high) == (0.9, 0.8, 1.0, 1.0) and r.per_fold.startswith("0.9000,1.0000")
    assert r["std"] == pytest.approx(0.0632, abs=1e-4)


def test_store_gives_equal_scores(spark, rows, tmp_path):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    for version, m in (("v20240101_000000", TR.gbt_pipeline(FEATS, max_iter=2).fit(train)),
                       ("v20240102_000000", TR.StandardizedLogistic(FEATS).fit(train))):
        MS.save_model(m, str(tmp_path), version, FEATS, {"auc": 0.9})
        want = sorted((r.student_key, r.score) for r in TR.positive_probability(m, test).collect())
        back, meta = MS.load_model(spark, str(tmp_path))
        assert sorted((r.student_key, r.score) for r in TR.positive_probability(back, test).collect()) == want
        row = meta.first()
        assert row["version"] == version and row["features"] == FEATS and row["metrics"][0]["value"] == 0.9
    assert MS.versions(spark, str(tmp_path)) == ["v20240101_000000", "v20240102_000000"]
    MS.load_model(spark, str(tmp_path), "v20240101_000000")
    with pytest.raises(FileNotFoundError):
        MS.load_model(spark, str(tmp_path), "v1")


def test_kept_releases(spark):
    df = spark.range(10).select(F.col("id").alias("x"))
    with TR.kept(df) as d:
        assert d.storageLevel.useMemory
    assert not df.storageLevel.useMemory


def test_training_rows_are_dealt_by_their_number(spark, rows):
    assert TR.parts_of(0, 12) == TR.parts_of(40_000, 12) == 1 and TR.parts_of(75_000, 12) == 2
    assert TR.parts_of(4_500_000, 12) == 12 and TR.parts_of(27_000_000, 12) == 54
    small = TR.training_table(rows.repartition(200), "student_key")
    assert small.count() == rows.count() and small.rdd.getNumPartitions() <= 8
    many = spark.range(100_000).select(F.col("id").cast("string").alias("k"), F.rand(1).alias("x")).coalesce(1)
    table = TR.training_table(many, "k")
    sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == 100_000 and max(sizes) < 1.1 * min(sizes)
    assert TR.fits_at_once(table, 100) == 8 and TR.fits_at_once(table, 5) == 5
    assert TR.fits_at_once(spark.range(10, numPartitions=24), 5) == 1


def test_feedback_fits_on_few_parts(spark, rows, tmp_path, monkeypatch):
    seen = []
    fit = TR.stacking_fit
    monkeypatch.setattr(TR, "stacking_fit", lambda df, *a, **b: seen.append(df.rdd.getNumPartitions()) or fit(df, *a, **b))
    base = rows.drop("split", "fold").repartition(40).withColumn("person", F.expr("cast(substring(student_key, 2) AS int)")).withColumn(
        "dropout_label", F.col("label").cast("int"))
    outcomes = spark.createDataFrame([(i, "SUCCESSFUL") for i in range(1, 60)], "student_id int, outcome string")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        RT.retrain_on_feedback(base, outcomes, "student_key", "person", FEATS, str(tmp_path / "models"), "v20240101_000000",
                               str(tmp_path / "runs"), "2024-01-01 00:00:00", max_iter=1, forest_trees=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1 and seen[0] <= 8


def test_learners_of_a_fold_are_fitted_side_by_side(rows):
    import threading

    meet = threading.Barrier(2, timeout=60)

    class Meeting:
        def fit(self, train):
            meet.wait()
            return TR.gbt_pipeline(FEATS, max_iter=1).fit(train)

    train = rows.where("split = 'train'").withColumn("fold", F.col("fold") % 2)
    oof = TR.out_of_fold(train, {"a": Meeting(), "b": Meeting()}, 2)
    assert oof.count() == train.count() and {"p_a", "p_b"} <= set(oof.columns)


def test_many_rows_grow_all_trees_at_once():
    assert TR.steps_of(5_000, 300, 20) == [80, 160, 300] and TR.steps_of(5_000, 100, 20) == [80, 100]
    assert TR.steps_of(50_000, 300, 20) == [300]
    assert TR.in_parallel(len, []) == []


def test_feedback_query_refits_the_whole_stack(spark, rows, monkeypatch):
    from riskweave.plans import q_training as Q

    class Asked(Exception):
        pass

    def asked(df, features, k=K.N_FOLDS, max_iter=K.STACK_ITERATIONS, forest_trees=K.FOREST_TREES, root=None):
        raise Asked(k, max_iter, forest_trees, df.count())

    base = rows.drop("split", "fold").withColumn("student_id_orig", F.expr("cast(substring(student_key, 2) AS int)")).withColumn(
        "dropout_label", F.col("label").cast("int"))
    outcomes = spark.createDataFrame([(i, "SUCCESSFUL") for i in range(1, 60)], "student_id int, outcome string")
    monkeypatch.setattr(Q, "labelled", lambda spark, sf_dir: base)
    monkeypatch.setattr(Q.cohort, "interventions", lambda spark, sf_dir: outcomes)
    monkeypatch.setattr(Q.B, "as_of", lambda spark, sf_dir: "2024-01-01 00:00:00")
    monkeypatch.setattr(TR, "stacking_fit", asked)
    with pytest.raises(Asked) as got:
        Q.q_feedback_retrain(spark, "no folder")
    assert got.value.args[:3] == (5, 400, 400) and got.value.args[3] >= 0.8 * base.count()
