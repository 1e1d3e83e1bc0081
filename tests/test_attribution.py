"""M13 by coalitions, and boosted trees cut by patience (M5)."""

import itertools
import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.operators import attribution as AT
from riskweave.operators import training as TR

FEATS = K.ALL_FEATURES


def table(spark, n=240, seed=1, noise=0.15):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [round(rng.uniform(0, 100), 2) for _ in FEATS]
        y = int((x[0] < 45 and x[1] < 60) != (rng.random() < noise))
        rows.append((f"k{i:04d}", *x, float(y)))
    cols = ", ".join(f"{f} double" for f in FEATS)
    return spark.createDataFrame(rows, f"student_key string, {cols}, label double").repartition(2)


@pytest.fixture(scope="module")
def fitted(spark):
    df = table(spark).cache()
    return df, TR.gbt_pipeline(FEATS, max_iter=8, max_depth=4).fit(df)


def margin(model, x):
    return 2 * model.stages[-1].predictRaw(Vectors.dense(x))[1]


def by_orders(model, x, background):
    """Mean marginal contribution of each feature over all orders of the features."""
    n, total, value = len(x), [0.0] * len(x), {}
    for mask in range(2 ** n):
        value[mask] = sum(margin(model, [x[i] if mask >> i & 1 else b[i] for i in range(n)]) for b in background) / len(background)
    for order in itertools.permutations(range(n)):
        mask = 0
        for i in order:
            total[i] += value[mask | 1 << i] - value[mask]
            mask |= 1 << i
    return [t / math.factorial(n) for t in total], value[0]


def test_equals_all_orders(spark, fitted):
    df, model = fitted
    background = AT.background_rows(df, FEATS, "student_key", 3)
    out = AT.tree_attribution(df.orderBy("student_key").limit(10), model, FEATS, background, "student_key").collect()
    assert len(out) == 10
    for r in out:
        want, base = by_orders(model, [e.value for e in r.explanation], background)
        assert r.base_value == pytest.approx(base, abs=1e-9)
        assert [e.contribution for e in r.explanation] == pytest.approx(want, abs=1e-9)
        assert [e.feature for e in r.explanation] == FEATS


def test_adds_up_to_the_score(spark, fitted):
    df, model = fitted
    background = AT.background_rows(df, FEATS, "student_key")
    out = AT.tree_attribution(df, model, FEATS, background, "student_key")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "ArrowEval", "Cartesian", "NestedLoop"))
    scored = TR.positive_probability(model, df).select("student_key", F.col("score").alias("s"))
    rows = out.join(scored, "student_key").collect()
    assert len(rows) == df.count() and len({r.base_value for r in rows}) == 1
    for r in rows:
        assert r.base_value + sum(e.contribution for e in r.explanation) == pytest.approx(r.margin, abs=1e-6)
        assert r.risk_score == pytest.approx(r.s, abs=1e-4)
    weights = AT.coalition_weights(7)
    assert len(weights) == 128 and all(sum(w[i] for _, w in weights) == pytest.approx(0, abs=1e-12) for i in range(7))


def test_nulls_and_bounds(spark, fitted):
    df, model = fitted
    background = AT.background_rows(df, FEATS, "student_key", 2)
    holes = df.limit(3).withColumn("quiz_average", F.lit(None).cast("double"))
    assert AT.tree_attribution(holes, model, FEATS, background, "student_key").count() == 0
    for n in (0, 51):
        with pytest.raises(ValueError):
            AT.background_rows(df, FEATS, "student_key", n)
    with pytest.raises(ValueError):
        AT.background_rows(holes, FEATS, "student_key")
    with pytest.raises(ValueError):
        AT.tree_attribution(df, model, [f"f{i}" for i in range(11)], background, "student_key")


def test_best_prefix():
    assert TR.best_prefix([3.0, 2.0, 2.5, 1.0, 1.5, 1.6], 2) == (4, True)
    assert TR.best_prefix([3.0, 2.0, 2.5, 2.4, 1.0], 2) == (2, True)      # the search ended before the last
    assert TR.best_prefix([3.0, 2.0, 1.0], 2) == (3, False)
    assert TR.best_prefix([1.0], 20) == (1, False)


def test_patience_goes_beyond_the_first_rise(spark):
    train, valid = table(spark, 200, 3, 0.3).cache(), table(spark, 40, 4, 0.3).cache()
    pipe = TR.gbt_pipeline(FEATS, max_iter=120, max_depth=3, step=0.3)
    model, losses = TR.fit_with_patience(pipe, train, valid, patience=10)
    first_rise = next(i for i in range(1, len(losses)) if losses[i] > losses[i - 1])
    assert model.stages[-1].getNumTrees == losses.index(min(losses[:model.stages[-1].getNumTrees + 10])) + 1
    assert len(losses) < 120 and model.stages[-1].getNumTrees != first_rise
    patient = [TR.best_prefix(losses, p)[0] for p in (1, 10)]
    assert patient[1] >= patient[0] and patient[0] <= first_rise


def test_cut_model_is_the_shorter_fit(spark, fitted):
    df, model = fitted
    short = TR.gbt_pipeline(FEATS, max_iter=5, max_depth=4).fit(df)
    cut = PipelineModel([model.stages[0], TR.first_trees(model.stages[-1], 5)])
    a, b = (TR.positive_probability(m, df).orderBy("student_key").collect() for m in (short, cut))
    assert [r.score for r in a] == [r.score for r in b] and cut.stages[-1].getNumTrees == 5
    assert cut.stages[-1].getFeaturesCol() == "features" and len(cut.stages[-1].featureImportances) == len(FEATS)
    with pytest.raises(ValueError):
        TR.first_trees(model.stages[-1], 9)


def test_boxes_give_what_cells_give(spark, fitted):
    df, model = fitted
    background = AT.background_rows(df, FEATS, "student_key")
    boxes = AT.tree_boxes(model.stages[-1])
    assert sum(len(t.toDebugString.split("Predict")) - 1 for t in model.stages[-1].trees) >= len(boxes)
    rows = df.select("student_key", F.array(*FEATS).alias("_x")).limit(20)
    cols = ["base_value", "margin", *[f"_s{i}" for i in range(7)]]
    a, b = (o.orderBy("student_key").collect() for o in (AT._by_boxes(rows, boxes, background, 7, "student_key"),
                                                         AT._by_cells(rows, model.stages[-1], background, 7, "student_key")))
    assert len(a) == len(b) == 20
    for x, y in zip(a, b):
        assert x["student_key"] == y["student_key"] and [x[c] for c in cols] == pytest.approx([y[c] for c in cols], abs=1e-9)
    # The trees are not scored again for every coalition and background row, and few rows are not left to one task.
    out = AT.tree_attribution(df.coalesce(1).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn(
        "student_key", F.concat_ws("-", "student_key", "x")), model, FEATS, background, "student_key")
    assert "UDF" not in out._jdf.queryExecution().executedPlan().toString() and out.rdd.getNumPartitions() > 1
    assert out.count() == 50 * df.count()


def test_one_leaf(spark, fitted):
    df, _ = fitted
    stump = TR.gbt_pipeline(FEATS, max_iter=1, max_depth=0).fit(df)
    r = AT.tree_attribution(df, stump, FEATS, [[1.0] * 7], "student_key").first()
    assert r.base_value == pytest.approx(r.margin) and all(e.contribution == 0 for e in r.explanation)


def test_boxes_are_summed_without_sorting(spark, fitted):
    df, model = fitted
    background = AT.background_rows(df, FEATS, "student_key")
    out = AT.tree_attribution(df, model, FEATS, background, "student_key")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan
    # Rows at a threshold, beside it, and without a number fall on the sides that the trees send them to.
    boxes = AT.tree_boxes(model.stages[-1])
    cuts = AT.thresholds_of(boxes, 7)
    edges = [c + d for c in cuts[0][:5] for d in (0.0, 1e-9, -1e-9)] + [math.nan, math.inf, -math.inf]
    odd = spark.createDataFrame([(f"e{i}", [e, *[float(10 * i % 100)] * 6]) for i, e in enumerate(edges)], "student_key string, _x array<double>")
    for r in AT._by_boxes(odd, boxes, background, 7, "student_key").collect():
        assert r.margin == pytest.approx(margin(model, r._x), abs=1e-9)
        assert r.base_value + sum(r[f"_s{i}"] for i in range(7)) == pytest.approx(r.margin, abs=1e-6)
    lo = [AT._mask((c, math.inf), cuts[0]) for c in cuts[0]]
    assert AT._mask(None, cuts[0]) == 0 and AT._mask((-math.inf, math.inf), [float(i) for i in range(63)]) == -1 and len(set(lo)) == len(lo)
