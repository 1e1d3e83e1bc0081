"""M13, tree half: exact per-row attribution of any fitted classifier by coalitions.

With n features there are 2**n coalitions. The value of a coalition for a row is
the model's mean margin over a background, with the coalition's features taken
from the row and the others from the background row. Weighing the values by
Shapley's formula gives one contribution per feature, and the contributions and
the base value (the empty coalition) add up to the row's margin.

As a Spark job, boosted trees go leaf by leaf: a leaf is a box of the features on its
path, and a mix of a row and a background row falls into it if every one of them comes
from a row that is inside. So the sum over all coalitions and background rows is a
function of *which* of the path's features the row has inside the box: a small table
per box (2**d entries for d features), made once from the model and the background.
The boxes, a table of the model's size, are broadcast, matched with each row and
summed by key: a look-up per box instead of a score of all trees per coalition and
background row, and the same sums.

Any other classifier is scored cell by cell: the coalitions and the background are
literals of fixed size (2**n masks, at most ``MAX_BACKGROUND`` rows), exploded on each
row, so nothing is joined; the cells are scored by the model inside the JVM.

In both forms the rows are dealt by key, all cells of a row come from one task and no
other row is shuffled.
"""

from __future__ import annotations

import re
from math import factorial, inf, nan

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fround, risk_band

MAX_BACKGROUND = 50
MAX_FEATURES = 10
MAX_PATH = 6           # features on a leaf's path: its table has 2**MAX_PATH entries at most
MAX_CUTS = 63          # thresholds of a feature: the intervals between them are bits of a number
BOX_GROUPS = 64        # the boxes are matched group by group
ROWS_PER_TASK = 2_000  # a task is worth starting for so many rows


def coalition_weights(n: int) -> list[tuple[int, list[float]]]:
    """(mask, weight of the coalition's value in each feature's contribution):
    positive for the features inside the coalition, negative for the others."""
    inside = [factorial(s - 1) * factorial(n - s) / factorial(n) for s in range(1, n + 1)]
    outside = [-factorial(s) * factorial(n - s - 1) / factorial(n) for s in range(n)]
    sizes = [bin(mask).count("1") for mask in range(2 ** n)]
    return [(mask, [inside[s - 1] if mask >> i & 1 else outside[s] for i in range(n)]) for mask, s in enumerate(sizes)]


def background_rows(df: DataFrame, features: list[str], key: str, n: int = 16) -> list[list[float]]:
    """``n`` background rows (at most ``MAX_BACKGROUND``), those of smallest hash of
    the key: a plain sample that does not change from run to run."""
    if not 1 <= n <= MAX_BACKGROUND:
        raise ValueError(f"background must have 1..{MAX_BACKGROUND} rows")
    whole = df.where(" AND ".join(f"{f} IS NOT NULL" for f in features))
    rows = whole.orderBy(F.md5(F.col(key).cast("string")), F.col(key)).select(*[F.col(f).cast("double") for f in features])
    got = [[float(v) for v in r] for r in rows.limit(n).collect()]
    if not got:
        raise ValueError("no background row without nulls")
    return got


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def log_odds(model: Transformer) -> Column:
    """Margin of a binary classifier's raw prediction in log-odds units, so that
    1 / (1 + exp(-margin)) is its probability (boosted trees keep half of it)."""
    name = type(model.stages[-1] if isinstance(model, PipelineModel) else model).__name__
    factor = {"GBTClassificationModel": 2.0, "LogisticRegressionModel": 1.0}.get(name)
    if factor is None:
        raise ValueError(f"no margin in log-odds for {name}")
    return vector_to_array(F.col("rawPrediction"))[1] * factor


Box = tuple[tuple[int, float, float], ...]  # (feature, above, up to) of the features on a path


def tree_boxes(model: GBTClassificationModel) -> dict[Box, float] | None:
    """The leaves of all trees as boxes and their margins (log-odds, tree weights
    included); equal boxes of several trees are one. None if a split isn't a threshold."""
    boxes: dict[Box, float] = {}
    for tree, weight in zip(model.trees, model.treeWeights):
        path: list[tuple[int, float, bool]] = []  # (feature, threshold, at or below it) from the root
        for line in tree.toDebugString.splitlines()[1:]:
            text = line.strip()
            if m := re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", text):
                path.append((int(m[1]), float(m[2]), True))
            elif m := re.fullmatch(r"Else \(feature (\d+) > (\S+)\)", text):
                path.append((int(m[1]), float(m[2]), False))
            elif m := re.fullmatch(r"Predict: (\S+)", text):
                sides: dict[int, tuple[float, float]] = {}
                for f, t, below in path:
                    lo, hi = sides.get(f, (-inf, inf))
                    sides[f] = (lo, min(hi, t)) if below else (max(lo, t), hi)
                box = tuple((f, *sides[f]) for f in sorted(sides))
                boxes[box] = boxes.get(box, 0.0) + 2.0 * weight * float(m[1])
                while path and not path[-1][2]:  # both sides of these splits are done
                    path.pop()
                if path:  # the other side of this one follows
                    path.pop()
            elif text:
                return None
    return boxes


def box_table(box: Box, value: float, background: list[list[float]], n: int) -> tuple[float, list[float]]:
    """A box's part of the base value; and for every set of the path's features (bit by
    bit) that a row has inside the box, its part of the n contributions, one after the other.

    With a row inside in the features A and a background row in B, the coalitions that
    reach the leaf hold all of A - B and nothing of B - A, and A + B is the whole path.
    """
    d = len(box)
    whole = 2 ** d - 1
    inside = [sum(1 << j for j, (f, lo, hi) in enumerate(box) if _inside(b[f], lo, hi)) for b in background]
    out = [0.0] * (2 ** d * n)
    for a in range(2 ** d):
        for b in inside:
            if a | b != whole:
                continue
            p, q = (a & ~b).bit_count(), (b & ~a).bit_count()
            up = factorial(p - 1) * factorial(q) / factorial(p + q) if p else 0.0
            down = factorial(p) * factorial(q - 1) / factorial(p + q) if q else 0.0
            for j, (f, _, _) in enumerate(box):
                if a & ~b & (1 << j):
                    out[a * n + f] += value * up / len(background)
                elif b & ~a & (1 << j):
                    out[a * n + f] -= value * down / len(background)
    return value * inside.count(whole) / len(background), out


def _inside(v: float, lo: float, hi: float) -> bool:
    return not v <= lo and (hi == inf or v <= hi) if lo > -inf else hi == inf or v <= hi


def thresholds_of(boxes: dict[Box, float], n: int) -> list[list[float]]:
    """The thresholds of each feature in all boxes, ascending."""
    return [sorted({t for box in boxes for f, *sides in box if f == i for t in sides if abs(t) < inf}) for i in range(n)]


def _mask(side: tuple[float, float] | None, thresholds: list[float]) -> int:
    """The intervals between a feature's thresholds that lie inside (above, up to], a bit
    each, as a signed 64-bit number; the k-th interval ends with the k-th threshold."""
    if side is None:
        return 0
    first = 0 if side[0] == -inf else thresholds.index(side[0]) + 1
    last = len(thresholds) if side[1] == inf else thresholds.index(side[1])
    bits = sum(1 << k for k in range(first, last + 1))
    return bits - (1 << 64) if bits >> 63 else bits


def _by_boxes(rows: DataFrame, boxes: dict[Box, float], background: list[list[float]], n: int, key: str) -> DataFrame:
    """key, _x, base_value, margin, _s0.. from the boxes of a boosted model. A box knows the
    intervals inside it (``_in``) and which sets of its features add anything (``_live``):
    pairs of a row and a box that add zeros only are dropped before they are summed."""
    cuts = thresholds_of(boxes, n)
    tables, base = [], 0.0
    for i, (box, value) in enumerate(boxes.items()):
        part, table = box_table(box, value, background, n)
        base += part
        whole = 2 ** len(box) - 1
        live = sum(1 << a for a in range(whole + 1) if a == whole or any(table[a * n:(a + 1) * n]))
        sides = {f: (lo, hi) for f, lo, hi in box}
        place = {f: j for j, (f, _, _) in enumerate(box)}
        masks = [_mask(sides.get(f), cuts[f]) for f in range(n)]
        tables.append((i % BOX_GROUPS, whole, value, live - (1 << 64) if live >> 63 else live, *masks,
                       *[place.get(f, 0) for f in range(n)], table))
    schema = ", ".join(["_g int NOT NULL", "_whole int NOT NULL", "_value double NOT NULL", "_live long NOT NULL",
                        *[f"_in{f} long NOT NULL" for f in range(n)], *[f"_at{f} int NOT NULL" for f in range(n)], "_t array<double>"])
    model = F.broadcast(rows.sparkSession.createDataFrame(tables, schema))
    interval = lambda f: F.size(F.filter(_doubles(cuts[f]), lambda t: F.coalesce(F.col("_x")[f], F.lit(nan)) > t)) if cuts[f] else F.lit(0)
    groups = F.array(*[F.lit(g) for g in range(min(BOX_GROUPS, len(tables)))])
    hit = F.lit(0)
    for f in range(n):
        inside = F.call_function("shiftrightunsigned", F.col(f"_in{f}"), F.col(f"_k{f}")).bitwiseAND(1).cast("int")
        hit = hit.bitwiseOR(F.call_function("shiftleft", inside, F.col(f"_at{f}")))
    xs = [f"_x{f}" for f in range(n)]
    rows = rows.select(key, *[F.col("_x")[f].alias(x) for f, x in enumerate(xs)], *[interval(f).alias(f"_k{f}") for f in range(n)])
    cells = rows.select(key, *xs, *[f"_k{f}" for f in range(n)], F.explode(groups).alias("_g")).join(model, "_g")
    cells = cells.select(key, *xs, "_whole", "_value", "_live", "_t", hit.alias("_hit"))
    cells = cells.where(F.call_function("shiftrightunsigned", F.col("_live"), F.col("_hit")).bitwiseAND(1) == 1)
    # Numbers only: with an array in its buffer the aggregate would sort all cells, on disk.
    sums = cells.groupBy(key).agg(
        *[F.first(x).alias(x) for x in xs],
        F.sum(F.when(F.col("_hit") == F.col("_whole"), F.col("_value")).otherwise(0.0)).alias("margin"),
        *[F.sum(F.get("_t", F.col("_hit") * n + i)).alias(f"_s{i}") for i in range(n)])
    return sums.select(key, F.array(*xs).alias("_x"), F.lit(base).alias("base_value"), "margin", *[f"_s{i}" for i in range(n)])


def _by_cells(rows: DataFrame, classifier: Transformer, background: list[list[float]], n: int, key: str) -> DataFrame:
    """key, _x, base_value, margin, _s0.. by scoring every coalition with every background row."""
    masks = F.array(*[F.struct(F.lit(m).alias("mask"), _doubles(w).alias("w")) for m, w in coalition_weights(n)])
    cells = (rows.withColumn("_c", F.explode(masks))
                 .withColumn("_b", F.explode(F.array(*[_doubles(b) for b in background]))))
    mixed = F.array(*[F.when(F.col("_c.mask").bitwiseAND(1 << i) != 0, F.col("_x")[i]).otherwise(F.col("_b")[i]) for i in range(n)])
    scored = classifier.transform(cells.withColumn(classifier.getFeaturesCol(), array_to_vector(mixed)))
    scored = scored.select(key, "_x", "_c", log_odds(classifier).alias("_v"))
    mean = lambda c: F.sum(c) / len(background)
    at = lambda mask: mean(F.when(F.col("_c.mask") == mask, F.col("_v")).otherwise(0.0))
    return scored.groupBy(key).agg(
        F.first("_x").alias("_x"), at(0).alias("base_value"), at(2 ** n - 1).alias("margin"),
        *[mean(F.col("_c.w")[i] * F.col("_v")).alias(f"_s{i}") for i in range(n)])


def tree_attribution(df: DataFrame, model: PipelineModel, features: list[str], background: list[list[float]],
                     key: str) -> DataFrame:
    """M13 (trained): ``df`` reduced to key, base_value, margin, risk_score, risk_band
    and explanation (feature, value, contribution), a row per key.

    ``model`` ends with a classifier on the vector of ``features``; the key must be
    unique. Rows with a null feature are left out: a coalition has no value there.
    """
    n = len(features)
    if n > MAX_FEATURES:
        raise ValueError(f"2**{n} coalitions are too many: at most {MAX_FEATURES} features")
    rows = df.select(F.col(key), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    rows = rows.where(~F.exists("_x", lambda v: v.isNull()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(max(1, df.rdd.getNumPartitions(), min(2 * cores, -(-df.count() // ROWS_PER_TASK))), key)
    classifier = model.stages[-1]
    boxes = tree_boxes(classifier) if isinstance(classifier, GBTClassificationModel) else None
    if boxes and max(map(len, boxes)) <= MAX_PATH and max(map(len, thresholds_of(boxes, n))) <= MAX_CUTS:
        out = _by_boxes(rows, boxes, background, n, key)
    else:
        out = _by_cells(rows, classifier, background, n, key)
    items = [F.struct(F.lit(f).alias("feature"), F.col("_x")[i].alias("value"), F.col(f"_s{i}").alias("contribution"))
             for i, f in enumerate(features)]
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return out.select(key, "base_value", "margin", fround(p, 4).alias("risk_score"), risk_band(p, K.TAU).alias("risk_band"),
                      F.array(*items).alias("explanation"))
