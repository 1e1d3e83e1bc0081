"""Operator 4 against its contract."""

import random
from collections import defaultdict

import pytest

from riskweave.llm import mixing as M


def water_fill(sizes, cap=3):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        want = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > cap * sizes[s]]
        if not over:
            return fixed | want
        fixed |= {s: cap * sizes[s] for s in over}


def made(n=1500, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "Ä", "tiny", None])
        if source == "tiny" and rnd.random() < 0.9:
            source = "a"
        rows.append((i, " ".join(["w"] * rnd.randint(0, 40)), source))
    rows += [(n, None, "a"), (None, "x y z", "b"), (5000, "r " * 7, "empty"), (6000, "", "void")]
    return rows + [(7000, "s t u", "hot")] * 6


@pytest.mark.parametrize("fan_in", [8, 256])
def test_targets_bounds_and_reruns(spark, fan_in, monkeypatch):
    monkeypatch.setattr(M.decide, "__defaults__", (M.MAX_COPIES, fan_in))
    rows = made()
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string, size string")
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    for r in got:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
    want = water_fill(dict(sizes))
    for s in sizes:
        assert next(r.target for r in got if r.source == s) == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = M.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_expectation_is_kept(spark, monkeypatch):
    """Over many seeds each document is taken its expected number of times."""
    df = spark.createDataFrame([(i, "w " * (i + 1), "a" if i < 6 else "b") for i in range(12)],
                               "doc_id long, text string, source string")
    total, n = defaultdict(int), 24
    for seed in range(n):
        monkeypatch.setattr(M, "SEED", seed)
        for r in M.mix(df).collect():
            total[r.doc_id] += r.copies
            want = r.target / r.source_size if r.source == "a" else None
            if want is not None:
                assert r.copies in (int(want), int(want) + 1)
    a = sum(range(1, 7))
    expected = sum(range(1, 13)) / 3 / a
    for i in range(6):
        assert total[i] / n == pytest.approx(expected, abs=0.25)


def test_mixed_rows_follow_the_decisions(spark):
    rows = made(300, 2)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, m long")
    out = M.mixed(df)
    assert out.columns == df.columns
    want = defaultdict(int)
    for r in M.mix(df).collect():
        want[r.doc_id] += r.copies
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}


def plain_fold(items, level, u):
    """Pivotal rounding of one bucket as a plain loop: (key, size, p) in order, largest first."""
    out, acc = {}, None
    for k, s, p in items:
        if acc is None:
            acc = (k, s, p)
            continue
        (a, sa, pa), (sx, px) = acc, (s, p)
        more, less = min((1 - pa) * sa, px * sx), min(pa * sa, (1 - px) * sx)
        d = more if u[k] * (more + less) < less else -less  # rises with the chance that keeps both expectations
        pa, px = pa + d / sa, px - d / sx
        pa, px = (round(v) if min(v, 1 - v) < 1e-9 else v for v in (pa, px))
        if pa in (0, 1):
            out[a], acc = pa, (k, sx, px)
        else:
            out[k], acc = px, (a, sa, pa)
    return out, acc


def test_fold_is_pivotal_rounding(spark):
    rnd = random.Random(5)
    rows = [("s", 0, (i, 7 * i), float(rnd.randint(1, 30)), rnd.random(), i) for i in range(200)]
    df = spark.createDataFrame(rows, "source string, bucket long, k struct<doc_id:long,th:long>, s double, p double, h long")
    got = M._fold(df, 0).first()
    u = {(r.k.doc_id, r.k.th): r.u for r in df.select("k", M._uniform(M.SEED, 0, M.F.col("k.doc_id"), M.F.col("k.th")).alias("u")).collect()}
    out, (k, s, p) = plain_fold([(r[2], r[3], r[4]) for r in sorted(rows, key=lambda r: (-r[3], r[5]))], 0, u)
    assert {(o.k.doc_id, o.k.th): o.p for o in got.out} == pytest.approx(out)
    assert (got.k.doc_id, got.s) == (k[0], s) and got.p == pytest.approx(p, abs=1e-6)
    mass = sum(r[3] * r[4] for r in rows)
    assert sum(o.p * rows[o.k.doc_id][3] for o in got.out) + got.p * got.s == pytest.approx(mass)


def test_hot_equal_rows_in_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "_PART", 16)
    monkeypatch.setattr(M, "_PARTS", 4)
    rows = [(1, "a b c", "s", "en" if i % 3 else "de", 5) for i in range(100)] + [(i, "w x", "t", "en", 3) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long")
    got = [r.copies for r in M.mix(df).collect() if r.doc_id == 1]
    assert len(got) == 100 and max(got) - min(got) <= 1
    runs = [sorted(map(tuple, M.mixed(x).collect())) for x in (df, df.repartition(5), df.orderBy("lang").repartition(2))]
    assert runs[0] == runs[1] == runs[2] and sum(r[0] == 1 for r in runs[0]) == sum(got)


def test_many_sources_equal_plain_resharing(spark):
    rnd = random.Random(3)
    sizes = {f"src{i:04d}é" if i % 7 else f"src{i}": rnd.choice([1, 3, 50, 4000]) for i in range(400)} | {None: 77}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, m long")
    got = {r.source: r.target for r in M.targets(rows).collect()}
    assert got == pytest.approx(water_fill(sizes))
    two = spark.createDataFrame([("a", 0, 1), ("b", 0, 1)], "source string, size long, m long")
    assert [r.target for r in M.targets(two).collect()] == [0, 0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0 and M.mixed(df).count() == 0
