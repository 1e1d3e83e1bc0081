"""Operator 12: lists equal to a plain sort of all scores, bounds that never miss, bounds that prune."""

import duckdb
import numpy as np
import pytest

from riskweave.llm import negatives as N
from riskweave.sources.tables import read_table


def brute(rows):
    """The contract by a sort of all scores: rows of (vec_id, label, vector)."""
    kept = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [max(-N.CLAMP, min(N.CLAMP, int(np.floor(256 * float(x))))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda t: (-t[1], t[0] is None, t[0] or 0)
    out = []
    for i, (anchor, label, q) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        all_ = [(r[0], dot(q, r[2]), r[1] == label) for j, r in enumerate(kept) if j != i]
        for pid, ps, _ in sorted((t for t in all_ if t[2]), key=order)[:5]:
            window = sorted((t for t in all_ if not t[2] and 30 * ps <= 100 * t[1] <= 90 * ps), key=order)[:10]
            out += [(anchor, pid, k + 1, nid, ps, ns) for k, (nid, ns, _) in enumerate(window)]
    return out


def got(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[c] for c in cols) for r in N.mine(df).collect()), key=str)


def table(rng, n, dim, centres=6, step=25):
    c = rng.normal(size=(centres, dim))
    return [(int(i * step), int(rng.integers(0, 4)), (c[i % centres] + .2 * rng.normal(size=dim)).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("per_block", [1, 7, 4096])
def test_equals_brute_force(spark, monkeypatch, per_block):
    monkeypatch.setattr(N, "ANCHORS", per_block)
    rng = np.random.default_rng(per_block)
    rows = table(rng, 120, 8)
    rows += rows[:3] + rows[4:6]                                   # repeated rows, anchors among them
    rows += [(None, 1, rows[0][2]), (None, 2, rows[3][2]), (9001, None, rows[0][2]), (9002, 1, None),
             (9003, 1, [1.0, None]), (9004, 1, [float("nan")] * 8), (9100, 1, [float("inf")] * 8), (9200, 2, [.5, .5]),
             (9300, 2, []), (-100, 3, rows[1][2])]
    rows += [(10_000 + i, 1, rows[0][2]) for i in range(14)]       # ties
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string").repartition(3)
    assert got(df) == sorted(brute(rows), key=str)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(int(25 * i), int(i % 3), (rng.normal(size=4) * 10.0 ** rng.integers(0, 12)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(df) == sorted(brute(rows), key=str)


def test_table_equals_sql(spark):
    d = "/root/testdata/sf0.1"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = duck.execute(N.ORACLE_SQL)
    names = [c[0] for c in want.description]
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=str)
    assert len(want) > 500 and got(read_table(spark, d, "embeddings", ["vec_id", "label", "embedding"])) == want


def test_tree_spans_and_bounds_hold():
    rng = np.random.default_rng(4)
    q = rng.integers(-300, 300, (2500, 6))
    parent, edge, depth = N.spanning_tree(q)
    assert parent[0] == -1 and (parent[1:] < np.arange(1, len(q))).all() and (parent[1:] >= 0).all()
    assert (depth[1:] == depth[parent[1:]] + 1).all() and depth.max() < 60
    near = ((q[1700] - q[:1700]) ** 2).sum(1)
    assert near[parent[1700]] == near.min() and np.isclose(edge[1700] ** 2, near.min())


def test_only_overlapping_rows_are_scored():
    """On rows in tight clusters, most pairs are ruled out by bounds."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 400
    q = np.round(centres[np.arange(4000) % 20] + rng.normal(size=(4000, 16)) * 8).astype(np.int64)
    label, rid = np.arange(4000) % 20, np.arange(4000)
    anchors = rid[::40] + rng.integers(0, 20, 100)
    block = N.Block(anchors, label[anchors], q[anchors], *N.spanning_tree(q[anchors]))
    seen, best = [0, 0], N.Best(len(anchors), N.POSITIVES)
    N.best_positives(block, best, rid, label, rid, np.zeros(4000, bool), q, 0, seen)
    assert seen[0] < 0.1 * seen[1]
    for i, a in enumerate(anchors):
        s = q @ q[a]
        want = sorted(((-s[j], j) for j in range(4000) if label[j] == label[a] and j != a))[:5]
        assert [(-x, j) for x, j in want] == list(zip(best.score[best.who == i].tolist(), best.id[best.who == i].tolist()))


def test_empty_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(1, 1, [1.0])], [(100, 1, [1.0])]):
        assert N.mine(spark.createDataFrame(rows, schema)).count() == 0
