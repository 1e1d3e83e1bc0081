"""Operator 12, hard negatives by bounds along a spanning tree of anchors.

Anchors come in blocks of about ``ANCHORS``. Within a block each anchor hangs on the
nearest anchor before it, which gives a spanning tree with short edges and few
levels. For a row x the score at a child is the score at its parent plus
<child - parent, x>, so it lies within edge length * |x| of it: bounds travel
down the tree, level by level, and only rows whose bounds overlap the window
that an anchor still looks for are scored anew. Bounds that were not replaced by
a score widen with every edge.

Two scans of the rows for each ``PASS`` blocks. The first looks for rows of the
anchor's label, its window opens at the lowest of the best ``POSITIVES`` so far;
the second looks for rows of other labels between ``LOW`` and ``HIGH`` hundredths
of a positive's score, its windows open at the lowest of the best ``NEGATIVES`` so
far. A task keeps these best lists and returns them; Spark merges the tasks'
lists by window ranks. The anchors of a pass (and the windows) are the only thing
that goes through the driver and by broadcast; a pass ends with a written table.

Scores are exact integers: 64-bit floats where no sum can pass 2^53, else 64-bit
integers. Components are floor(``SCALE`` * x), held within +-``CLAMP``.

Edge cases: rows with a null label, a null vector or a component that is null or
not finite take no part; shorter vectors count as padded with zeros; rows with a
null id are no anchors and come last among ties; repeated rows are rows of their
own (a repeated anchor is an anchor twice, and a copy can be its positive); an
anchor without positives, or a positive of score below 0, gives no row; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import scratch_table_path

from .common import prepare, step

SCALE = 256
ANCHOR_EVERY = 100     # rows whose id it divides are anchors
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90     # hundredths of the positive's score
ANCHORS = 4096         # anchors of a block, about
PASS = 8               # blocks scanned for at once
CLAMP = 1 << 24
_ROWS = 1024           # rows scored at once (the first of a task are fewer: they set the windows)
_DENSE = 0.02          # share of overlapping pairs from which a product of all is quicker
_LOWEST = np.iinfo(np.int64).min


def quantised(rows: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding",
              shift_every: int = 7, labels: int = 10) -> DataFrame:
    """Rows that take part: rid (unique), id, label and q (integer components).
    Where ``shift_every`` divides the id the label becomes (label + 1) % ``labels``."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x)
    src = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                      F.col(f"`{vector}`").alias("v"))
    src = src.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    shifted = F.when(F.col("id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    scaled = F.transform("v", lambda x: F.greatest(F.lit(-CLAMP), F.least(
        F.lit(CLAMP), F.floor(x.cast("double") * SCALE))).cast("int"))
    return src.select(F.monotonically_increasing_id().alias("rid"), "id", shifted.alias("label"), scaled.alias("q"))


def dense(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of integers, padded with zeros to ``width``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with the rows of y."""
    bound = lengths(x).max(initial=0) * lengths(y).max(initial=0)
    if bound * 1.001 < 2 ** 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def pair_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products row by row."""
    return np.einsum("ij,ij->i", x, y)


def spanning_tree(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent (-1 at the root), edge length and depth of each row: every row
    hangs on the nearest row before it."""
    n, f = len(q), q.astype(np.float64)
    parent, depth, sq = np.full(n, -1), np.zeros(n, np.int64), (f ** 2).sum(1)
    for a in range(1, n, 1024):
        b = min(n, a + 1024)
        near = sq[:b] - 2 * (f[a:b] @ f[:b].T)
        near[np.arange(b) >= np.arange(a, b)[:, None]] = np.inf
        parent[a:b] = near.argmin(1)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    edge = np.where(parent < 0, 0.0, lengths(q - q[parent]))
    return parent, edge, depth


class Block:
    """Anchors of one block, in levels of their tree."""

    def __init__(self, rid, label, q, parent, edge, depth):
        self.rid, self.label, self.q, self.parent = rid, label, q, parent
        self.edge = edge * (1 + 1e-9)
        self.levels = [np.flatnonzero(depth == k) for k in range(int(depth.max(initial=-1)) + 1)]

    def overlapping(self, q: np.ndarray, allowed, low: np.ndarray, high: np.ndarray, seen: list[int] | None = None
                    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, anchors, scores) of the pairs whose bounds overlap the anchor's
        window low .. high; ``allowed`` gives, for anchors, which rows may pair.
        ``seen`` counts the pairs that were scored anew, and all pairs."""
        norm = lengths(q)[:, None] * (1 + 1e-9)
        at = np.zeros(len(self.rid), np.int64)
        below = above = None
        for level in self.levels:
            at[level] = np.arange(len(level))
            if below is None:
                lo = np.full((len(q), len(level)), -np.inf)
                hi = -lo
                open_ = np.ones(lo.shape, bool)  # the root is scored for every row
            else:
                up, wide = at[self.parent[level]], norm * self.edge[level] + 1
                lo, hi = below[:, up] - wide, above[:, up] + wide
                open_ = (hi >= low[level]) & (lo <= high[level]) & allowed(level)
            if seen is not None:
                seen[0] += int(open_.sum())
                seen[1] += open_.size
            if open_.mean() > _DENSE:
                r, c = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
                part = scores(q[r], self.q[level[c]])
                i, k = np.nonzero(open_[np.ix_(r, c)])
                rows, cols, s = r[i], c[k], part[i, k]
            else:
                rows, cols = np.nonzero(open_)
                s = pair_scores(q[rows], self.q[level[cols]])
            lo[rows, cols] = hi[rows, cols] = s
            below, above = lo, hi
            if len(rows):
                yield rows, level[cols], s


class Best:
    """The best ``size`` rows of each of ``n`` lists: by score, then id, null ids last."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        self.who = np.zeros(0, np.int64)
        self.score, self.id, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, bool))
        self.lowest = np.full(n, _LOWEST)

    def add(self, who, score, ids, none) -> None:
        if not len(who):
            return
        cols = [np.concatenate(p) for p in ((self.who, who), (self.score, score), (self.id, ids), (self.none, none))]
        order = np.lexsort((cols[2], cols[3], -cols[1], cols[0]))
        cols = [c[order] for c in cols]
        first = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.who, self.score, self.id, self.none = (c[rank < self.size] for c in cols)
        full = rank == self.size - 1
        self.lowest[cols[0][full]] = cols[1][full]


def _chunks(n: int, start: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows: short ones while few rows were seen."""
    a = 0
    while a < n:
        b = min(n, a + max(64, min(_ROWS, start + a)))
        yield a, b
        a = b


def best_positives(block: Block, best: Best, rid, label, ids, none, q, start: int, seen=None) -> None:
    """Take rows into the lists of the anchors' positives."""
    for a, b in _chunks(len(rid), start):
        same = lambda level: label[a:b, None] == block.label[level]  # noqa: B023, E731
        for r, c, s in block.overlapping(q[a:b], same, best.lowest.astype(np.float64), np.full(best.n, np.inf), seen):
            ok = (label[a + r] == block.label[c]) & (rid[a + r] != block.rid[c]) & (s >= best.lowest[c])
            r, c, s = r[ok], c[ok], s[ok]
            best.add(c, s, ids[a + r], none[a + r])


def best_negatives(block: Block, best: Best, low: np.ndarray, high: np.ndarray, label, ids, none, q, start: int, seen=None) -> None:
    """Take rows into the lists of the anchors' windows (low .. high, a column each)."""
    n, k = low.shape
    for a, b in _chunks(len(ids), start):
        other = lambda level: label[a:b, None] != block.label[level]  # noqa: B023, E731
        begin = np.where(low <= high, np.maximum(low, best.lowest.reshape(n, k)), np.iinfo(np.int64).max)
        end = np.where(low <= high, high, _LOWEST).max(1)
        for r, c, s in block.overlapping(q[a:b], other, begin.min(1).astype(np.float64) - 1, end.astype(np.float64) + 1, seen):
            ok = label[a + r] != block.label[c]
            r, c, s = r[ok], c[ok], s[ok]
            for w in range(k):
                ok = (s >= begin[c, w]) & (s <= high[c, w]) & (low[c, w] <= high[c, w])
                best.add(c[ok] * k + w, s[ok], ids[a + r[ok]], none[a + r[ok]])


def _trees(anchors: DataFrame, width: int) -> DataFrame:
    """The spanning tree of each block, found on the executors."""

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rid", ignore_index=True)
        parent, edge, depth = spanning_tree(dense(pa.array(group["q"].tolist(), pa.list_(pa.int32())), width))
        return group.assign(at=np.arange(len(group)), parent=parent, edge=edge, depth=depth)

    schema = "rid bigint, id bigint, label bigint, q array<int>, block bigint, at bigint, parent bigint, edge double, depth bigint"
    return anchors.groupBy("block").applyInPandas(tree, schema)


def _block(rows: pa.Table, width: int) -> Block:
    rows = rows.sort_by("at")
    return Block(*(rows[c].to_numpy() for c in ("rid", "label")), dense(rows["q"], width),
                 *(rows[c].to_numpy() for c in ("parent", "edge", "depth")))


def _scan(rows: DataFrame, width: int, blocks, take, size: int, lists: int) -> DataFrame:
    """Best lists of every block over each task's rows: block, list, score, id.
    ``blocks`` is a broadcast list of (block number, Block, ...), ``take`` adds rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(b[1].rid) * lists, size) for b in blocks.value]
        start = 0
        for rb in batches:
            cols = {c: rb.column(i) for i, c in enumerate(("rid", "id", "label", "q"))}
            none = np.asarray(cols["id"].is_null().to_numpy(zero_copy_only=False))
            ids = cols["id"].fill_null(0).to_numpy(zero_copy_only=False)
            rid, label = (cols[c].to_numpy(zero_copy_only=False) for c in ("rid", "label"))
            q = dense(cols["q"], width)
            for b, kept in zip(blocks.value, best):
                take(b, kept, rid, label, ids, none, q, start)
            start += rb.num_rows
        for b, kept in zip(blocks.value, best):
            if len(kept.who):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kept.who), b[0]), pa.int64()), pa.array(kept.who, pa.int64()),
                     pa.array(kept.score, pa.int64()), pa.array(kept.id, pa.int64(), mask=kept.none)],
                    names=["block", "list", "score", "id"])

    out = rows.select("rid", "id", "label", "q").mapInArrow(run, "block bigint, list bigint, score bigint, id bigint")
    order = Window.partitionBy("block", "list").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _take_positives(b, kept, rid, label, ids, none, q, start) -> None:
    best_positives(b[1], kept, rid, label, ids, none, q, start)


def _take_negatives(b, kept, rid, label, ids, none, q, start) -> None:
    best_negatives(b[1], kept, b[2], b[3], label, ids, none, q, start)


def _windows(n: int, places: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the distinct positive scores of each anchor, and these scores."""
    low, high = np.ones((n, POSITIVES), np.int64), np.zeros((n, POSITIVES), np.int64)
    value = np.zeros((n, POSITIVES), np.int64)
    for i, s in sorted(set(zip(places.tolist(), positive.tolist()))):
        w = int((low[i] <= high[i]).sum())
        if -(-LOW * s // 100) <= HIGH * s // 100:
            low[i, w], high[i, w], value[i, w] = -(-LOW * s // 100), HIGH * s // 100, s
    return low, high, value


def mine(rows: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    for every anchor row, its positives and their hard negatives."""
    spark = prepare(rows.sparkSession)
    rows = step(quantised(rows, id_col, label, vector), "vectors")
    anchors = rows.where(F.col("id") % ANCHOR_EVERY == 0)
    width = int(rows.agg(F.max(F.size("q"))).first()[0] or 0)
    n_blocks = -(-anchors.count() // ANCHORS)
    blocked = anchors.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(max(1, n_blocks))))
    trees = step(_trees(blocked, width), "anchor-trees")
    base = scratch_table_path(spark, f"llm-negatives-{uuid.uuid4().hex}")
    for first in range(0, max(1, n_blocks), PASS):
        here = trees.where(F.col("block").between(first, first + PASS - 1))
        table = here.toArrow()
        kinds = sorted(set(table["block"].to_pylist()))
        blocks = [(k, _block(table.filter(pa.compute.equal(table["block"], k)), width)) for k in kinds]
        shared = spark.sparkContext.broadcast(blocks)
        positives = step(_scan(rows, width, shared, _take_positives, POSITIVES, 1), "positives")
        found = positives.select("block", "list", "score").toArrow()
        with_windows, values = [], []
        for k, b in blocks:
            own = found.filter(pa.compute.equal(found["block"], k))
            low, high, value = _windows(len(b.rid), own["list"].to_numpy(), own["score"].to_numpy())
            with_windows.append((k, b, low, high))
            values.append(pd.DataFrame({"block": k, "list": np.arange(low.size), "positive_score": value.ravel()})[(low <= high).ravel()])
        windowed = spark.sparkContext.broadcast(with_windows)
        negatives = _scan(rows, width, windowed, _take_negatives, NEGATIVES, POSITIVES)
        names = pd.concat([pd.DataFrame({"block": [0], "list": [0], "positive_score": [0]})[:0], *values])
        scored = negatives.join(spark.createDataFrame(names, "block bigint, list bigint, positive_score bigint"), ["block", "list"])
        scored = scored.select("block", F.expr(f"list div {POSITIVES}").alias("at"), "positive_score", "rank",
                               F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = positives.select("block", F.col("list").alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = (pairs.join(here.select("block", "at", F.col("id").alias("anchor_id")), ["block", "at"])
                    .join(scored, ["block", "at", "positive_score"]))
        out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                   "negative_score").write.parquet(f"{base}/pass={first}")
        shared.destroy()
        windowed.destroy()
    return spark.read.parquet(base).drop("pass")


ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: greatest(-{CLAMP}, least({CLAMP}, floor({SCALE} * x::DOUBLE)))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.r <> b.r),
p AS (
  SELECT r, anchor_id, br AS pr, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
WINDOW w AS (PARTITION BY p.r, p.pr ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
