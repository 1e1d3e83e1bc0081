"""Model jobs on Spark ML.

Training data never leaves the cluster: Spark ML fits on DataFrames, fold
loops reuse one persisted frame (released at the end), and only metric rows are
collected. Boosted trees stand in for the native boosting engines; random search
over ``ParamMap``s stands in for the Bayesian sampler. The numbers of iterations,
trials and folds default to those of the application (``constants``).
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fround, risk_band
from ..session import cut_lineage, is_finished, release, scratch_table_path
from . import blocks as BL
from . import evaluation as EV
from . import splits as SP

LABEL = "label"


def with_label(df: DataFrame, label: str = "dropout_label") -> DataFrame:
    return df.withColumn(LABEL, F.col(label).cast("double"))


@contextmanager
def kept(df: DataFrame):
    """``df`` persisted for the time of a fit that reads it several times."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def in_parallel(fn: Callable, items: list, parallelism: int = K.N_FOLDS) -> list:
    """``fn`` of each item, several Spark fits at a time (as ``CrossValidator`` does)."""
    if not items:
        return []
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.getActiveSession())(fn), items, chunksize=1)


# A fit of boosted trees runs a small job per level of each tree, over every part of its
# rows: a part has at least LEAST_ROWS rows (its task is more work than its start), and
# beyond a part per core at most MOST_ROWS.
LEAST_ROWS, MOST_ROWS = 40_000, 500_000


def parts_of(rows: int, cores: int) -> int:
    """Parts into which a table of ``rows`` training rows is dealt."""
    return max(1, -(-rows // MOST_ROWS), min(cores, -(-rows // LEAST_ROWS)))


def training_table(df: DataFrame, key: str, name: str = "training") -> DataFrame:
    """``df`` written once, for fits that read it often: by the hash of its key in
    ``parts_of`` even parts, each in the key's order."""
    out = cut_lineage(df, name)
    parts = parts_of(out.count(), df.sparkSession.sparkContext.defaultParallelism)
    if parts == 1:
        return out
    even = cut_lineage(out.repartition(parts, key).sortWithinPartitions(key), name)
    release(out)
    return even


def fits_at_once(df: DataFrame, most: int) -> int:
    """How many fits on ``df`` may run at the same time: enough that their tasks keep
    every core busy some three times over. More would only hold more copies of the rows.
    Fits that are grown by one task each (``blocks``) run a fit per core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if BL.BLOCK_ROWS <= df.count() <= BL.TASK_ROWS:
        return max(1, min(most, cores))
    return max(1, min(most, -(-3 * cores // max(1, df.rdd.getNumPartitions()))))


def class_weight(train: DataFrame) -> float:
    """scale_pos_weight = negatives / positives of the training rows."""
    row = train.agg(F.count_if(F.col(LABEL) == 1).alias("p"), F.count_if(F.col(LABEL) == 0).alias("n")).first()
    return float(row["n"]) / max(float(row["p"]), 1.0)


class StandardizedLogistic:
    """M3 + M4: standardise with the training rows' mean and population standard
    deviation, then L2 logistic regression. ``regParam`` is C / n, which is the
    penalty of a sum-of-losses objective with inverse strength 1 / C (here C = 1)."""

    def __init__(self, features: list[str], max_iter: int = K.LOGISTIC_ITERATIONS, c: float = 1.0):
        self.features, self.max_iter, self.c = features, max_iter, c

    def fit(self, train: DataFrame) -> StandardizedModel:
        params = SP.fit_standardizer(train, self.features)
        rows = train.count()
        scaled = SP.apply_standardizer(train, params, "_z")
        lr = LogisticRegression(featuresCol="features", labelCol=LABEL, maxIter=self.max_iter,
                                regParam=self.c / max(1, rows), elasticNetParam=0.0, standardization=False)
        names = [f"{f}_z" for f in self.features]
        model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), lr]).fit(scaled)
        return StandardizedModel(params, model)


class StandardizedModel:
    """The fitted standardiser and model; transforms like a ``PipelineModel``."""

    def __init__(self, params: dict[str, tuple[float, float]], model: PipelineModel):
        self.params, self.model = params, model

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(SP.apply_standardizer(df, self.params, "_z"))
        return out.drop(*[f"{f}_z" for f in self.params])


def gbt_pipeline(features: list[str], weight_col: str | None = None, max_iter: int = K.BOOSTED_ITERATIONS,
                 max_depth: int = K.BOOSTED_DEPTH, step: float = K.BOOSTED_STEP, seed: int = K.SEED) -> Pipeline:
    """M5: boosted trees with class weights."""
    gbt = BL.BlockBoosting(featuresCol="features", labelCol=LABEL, maxIter=max_iter, maxDepth=max_depth,
                           stepSize=step, seed=seed, subsamplingRate=K.BOOSTED_SUBSAMPLE,
                           featureSubsetStrategy=str(K.BOOSTED_SUBSAMPLE))
    if weight_col:
        gbt.setWeightCol(weight_col)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt])


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The boosted model of the first ``n`` trees: what a fit of ``n`` iterations gives."""
    if not 1 <= n <= model.getNumTrees:
        raise ValueError(f"the model has 1..{model.getNumTrees} trees")
    sc = SparkContext.getOrCreate()
    java, jvm = model._java_obj, sc._jvm
    trees = sc._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        java.uid(), trees, weights, model.numFeatures, model.numClasses))
    return model._copyValues(cut)


def best_prefix(losses: list[float], patience: int = K.BOOSTED_PATIENCE) -> tuple[int, bool]:
    """Number of trees of the lowest loss, looking on for ``patience`` trees after
    each new lowest; and whether that search ended before the losses did."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def steps_of(rows: int, full: int, patience: int) -> list[int]:
    """Numbers of trees that are tried: 4 and 8 times the patience, then all. The more
    rows, the more trees lower the loss, and a step that does not end the search was
    grown for nothing: from ``LEAST_ROWS`` on, all are grown at once."""
    if rows >= LEAST_ROWS:
        return [full]
    return sorted({min(full, 4 * patience), min(full, 8 * patience), full})


def fit_with_patience(pipeline: Pipeline, train: DataFrame, valid: DataFrame, patience: int = K.BOOSTED_PATIENCE
                      ) -> tuple[PipelineModel, list[float]]:
    """M5: the boosted pipeline cut after the tree with the lowest validation loss, once
    ``patience`` more trees did not lower it; and the loss after each tree.

    A fit of k trees is the beginning of any longer fit with the same seed, so the
    number of trees grows in steps until the search ends (``steps_of``). The losses of
    all prefixes come from one pass over the validation rows (``evaluateEachIteration``).
    """
    gbt = pipeline.getStages()[-1]
    full = gbt.getMaxIter()
    for n in steps_of(train.count(), full, patience):
        model = pipeline.copy({gbt.maxIter: n}).fit(train)
        losses = model.stages[-1].evaluateEachIteration(PipelineModel(model.stages[:-1]).transform(valid))
        kept_trees, ended = best_prefix(losses, patience)
        if ended or n == full:
            break
    return PipelineModel([*model.stages[:-1], first_trees(model.stages[-1], kept_trees)]), losses


def forest_pipeline(features: list[str], seed: int = K.SEED, trees: int = K.FOREST_TREES) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
                            BL.BlockForest(featuresCol="features", labelCol=LABEL, numTrees=trees,
                                           maxDepth=K.FOREST_DEPTH, seed=seed)])


def positive_probability(model: Transformer | StandardizedModel, df: DataFrame, out: str = "score") -> DataFrame:
    """M9 (trained): P(y = 1), rounded to 4 after the band is taken from the raw value."""
    p = model.transform(df)
    raw = vector_to_array(F.col("probability"))[1]
    return (p.withColumn("_p", raw).withColumn("risk_band", risk_band(F.col("_p")))
             .withColumn(out, fround(F.col("_p"), 4))
             .drop("_p", "probability", "rawPrediction", "prediction", "features"))


def test_metrics(scored: DataFrame, tau: float, model_name: str, score: str = "score") -> DataFrame:
    """E3 + E6 on a scored frame: one metric row per model (long format)."""
    hist = EV.score_histogram(scored.withColumn("model", F.lit(model_name)), score, LABEL, ["model"])
    m = EV.classification_metrics(hist, tau, ["model"]).join(
        EV.auc(hist, ["model"]).select("model", fround(F.col("auc"), 4).alias("auc")), "model")
    metrics = ["auc", "accuracy", "precision", "recall", "f1", "kappa", "brier", "log_loss"]
    return m.select("model", *[F.col(c).cast("double") for c in metrics]).unpivot(["model"], metrics, "metric", "value")


test_metrics.__test__ = False  # not a pytest case


def metric_summary(per_fold: DataFrame) -> DataFrame:
    """(metric, fold, value) -> mean, population std, min, max, mean +- 1.96 std
    clamped to [0, 1] (the spread over folds) and the list of folds."""
    agg = per_fold.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.array_sort(F.collect_list(F.struct("fold", "value"))).alias("_folds"))
    lo = F.greatest(F.lit(0.0), F.col("mean") - 1.96 * F.col("std"))
    hi = F.least(F.lit(1.0), F.col("mean") + 1.96 * F.col("std"))
    return agg.select("metric", fround(F.col("mean"), 4).alias("mean"), fround(F.col("std"), 4).alias("std"),
                      fround("min", 4).alias("min"), fround("max", 4).alias("max"),
                      fround(lo, 4).alias("ci_fold_spread_low"), fround(hi, 4).alias("ci_fold_spread_high"),
                      F.array_join(F.transform("_folds", lambda x: F.format_number(x["value"], 4)), ",").alias("per_fold"))


def youden_from_scores(scored: DataFrame, score: str = "score") -> float:
    """E7 on a validation split; only the one threshold reaches the driver."""
    hist = EV.score_histogram(scored, score, LABEL)
    row = EV.youden(EV.roc_points(hist)).first()
    return float(row["youden_threshold"]) if row and row["youden_threshold"] is not None else K.TAU


def feature_importance(spark, model: PipelineModel, features: list[str]) -> DataFrame:
    """Tree importances named and sorted (a k-row frame)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp, strict=True), key=lambda t: -t[1])
    return spark.createDataFrame([(f, round(float(v), 6)) for f, v in rows], "feature string, importance double")


def random_param_maps(est: GBTClassifier, n_trials: int = K.SEARCH_TRIALS, seed: int = K.SEED) -> list:
    """M6: seeded random draws over the boosted-tree parameters that Spark ML has:
    iterations, depth, step size (log scale), row and feature subsampling, least rows
    of a leaf (child weight) and least gain of a split (gamma). The weight of the
    positive class and the two leaf penalties of other engines have no counterpart."""
    rng = random.Random(seed)
    grid = []
    for _ in range(n_trials):
        b = ParamGridBuilder()
        b.addGrid(est.maxIter, [rng.randint(100, 500)])
        b.addGrid(est.maxDepth, [rng.randint(3, 10)])
        b.addGrid(est.stepSize, [round(10 ** rng.uniform(-2, -0.5229), 5)])
        b.addGrid(est.subsamplingRate, [round(rng.uniform(0.6, 1.0), 3)])
        b.addGrid(est.featureSubsetStrategy, [str(round(rng.uniform(0.6, 1.0), 3))])
        b.addGrid(est.minInstancesPerNode, [rng.randint(1, 10)])
        b.addGrid(est.minInfoGain, [round(rng.uniform(0.0, 0.05), 4)])
        grid += b.build()
    return grid


def cv_search(df_with_folds: DataFrame, features: list[str], n_trials: int = K.SEARCH_TRIALS, parallelism: int = 4,
              n_folds: int = K.N_FOLDS, param_maps: list | None = None, estimator: GBTClassifier | None = None):
    """M6: k-fold AUC search over random ParamMaps (folds from ``fold``). ``n_trials``
    and ``param_maps`` are the caller's budget; the default is the full search."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = estimator or GBTClassifier(featuresCol="features", labelCol=LABEL, seed=K.SEED)
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=param_maps or random_param_maps(gbt, n_trials),
                        evaluator=BinaryClassificationEvaluator(labelCol=LABEL, metricName="areaUnderROC"),
                        foldCol="fold", numFolds=n_folds, parallelism=parallelism, seed=K.SEED)
    with kept(assembler.transform(df_with_folds)) as data:
        return cv.fit(data)


def out_of_fold(df_with_folds: DataFrame, learners: dict, k: int, root: str | None = None) -> DataFrame:
    """M7 level 1: out-of-fold probabilities of each base learner (one column per
    learner); every row is predicted exactly once, by models not trained on it.

    Each fold is written to its own folder of ``root`` as soon as it is fitted. A job
    that starts again on the same ``root`` fits the folds that are not finished only.
    The learners of all folds are fitted side by side.
    """
    spark = df_with_folds.sparkSession
    root = root or scratch_table_path(spark, f"out-of-fold-{uuid.uuid4().hex}")
    fitted: dict[int, dict] = {f: {} for f in range(k) if not is_finished(spark, f"{root}/fold={f}")}
    lock = Lock()

    def one(job: tuple[int, str]) -> None:
        f, name = job
        model = learners[name].fit(df_with_folds.where(F.col("fold") != f))
        with lock:
            fitted[f][name] = model
            last = len(fitted[f]) == len(learners)
        if last:
            out = df_with_folds.where(F.col("fold") == f)
            for n in learners:
                out = positive_probability(fitted[f][n], out, f"p_{n}").drop("risk_band")
            out.drop("fold").write.mode("overwrite").parquet(f"{root}/fold={f}")

    jobs = [(f, name) for f in fitted for name in learners]
    in_parallel(one, jobs, fits_at_once(df_with_folds, len(jobs)))
    return spark.read.option("basePath", root).parquet(*[f"{root}/fold={f}" for f in range(k)])


def stack_learners(features: list[str], max_iter: int = K.STACK_ITERATIONS, forest_trees: int = K.FOREST_TREES) -> dict:
    """Base learners of the stack: two boosted forests (depth 5 and 4 stand for the two
    engines), a random forest and a logistic model."""
    return {"gbt": gbt_pipeline(features, max_iter=max_iter, max_depth=5),
            "gbt2": gbt_pipeline(features, max_iter=max_iter, max_depth=4, seed=K.SEED + 1),
            "rf": forest_pipeline(features, trees=forest_trees), "lr": StandardizedLogistic(features)}


def stacking_fit(df_with_folds: DataFrame, features: list[str], k: int = K.N_FOLDS, max_iter: int = K.STACK_ITERATIONS,
                 forest_trees: int = K.FOREST_TREES, root: str | None = None) -> tuple[dict, PipelineModel]:
    """M7: base learners -> OOF columns -> logistic meta-learner; bases refitted on
    all training rows for serving. ``root`` keeps the out-of-fold table for a restart."""
    learners = stack_learners(features, max_iter, forest_trees)
    with kept(df_with_folds) as data:
        oof = out_of_fold(data, learners, k, root)
        n = data.count()
        meta = Pipeline(stages=[VectorAssembler(inputCols=[f"p_{x}" for x in learners], outputCol="features"),
                                LogisticRegression(featuresCol="features", labelCol=LABEL, regParam=1.0 / max(1, n),
                                                   standardization=False, maxIter=1000)]).fit(oof)
        bases = dict(zip(learners, in_parallel(lambda p: p.fit(data), list(learners.values()), fits_at_once(data, len(learners)))))
    return bases, meta


def stacking_predict(bases: dict, meta: PipelineModel, df: DataFrame) -> DataFrame:
    """M8: per-base probabilities, meta score (round 4) and band."""
    out = df
    for n, m in bases.items():
        out = positive_probability(m, out, f"p_{n}").drop("risk_band")
    return positive_probability(meta, out, "score")
