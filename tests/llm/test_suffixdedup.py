"""Operator 10 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from riskweave.llm import suffixdedup as S

N = S.LENGTH


def brute(rows):
    """rows: (doc_id, text) in order of precedence; equal rows are one document."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        cut = bytearray(len(data))
        for a in range(len(data) - N + 1):
            w = data[a:a + N]
            if w in seen:
                cut[a:a + N] = b"\1" * N
            seen.add(w)
        spans = sum(bool(c) and (not i or not cut[i - 1]) for i, c in enumerate(cut))
        kept = bytes(b for b, c in zip(data, cut) if not c)
        out.append((doc_id, len(data), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdeé", k=rnd.randint(1, 9))) for _ in range(n))


def made(seed=0):
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randint(0, 120)) for _ in range(20)]
    passage = prose(rnd, 60)
    line = prose(rnd, 25)
    for _ in range(25):  # a passage, whole or in part, in many texts
        a, b = sorted((rnd.randrange(len(passage)), rnd.randrange(len(passage))))
        texts.append(prose(rnd, rnd.randint(0, 20)) + passage[a:b] + prose(rnd, rnd.randint(0, 20)))
        texts.append(prose(rnd, 3) + line + prose(rnd, 3))
    for t in texts[:10]:  # copies, exact and near
        texts += [t, t[:200] + "X" + t[200:], t + t]
    texts += [None, "", "a" * 99, "a" * 100, "a" * 350, "ab" * 300, passage, "é" * 60]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string").repartition(5)
    got = sorted(tuple(r) for r in S.remove_repeats(df, **kw).collect())
    assert got == sorted(brute(rows))


def test_matches_brute_force(spark):
    check(spark, made())


def test_large_groups_and_pieces(spark, monkeypatch):
    """Anchor groups are split down to single windows, and long texts are hashed in pieces."""
    monkeypatch.setattr(S, "GROUP", 1)
    check(spark, made(1)[:70])


def test_small_pieces_and_batches(spark, monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 400)
    monkeypatch.setattr(S, "_WINDOWS", 300)
    monkeypatch.setattr(S, "_tables", {})
    check(spark, made(2)[:70])


def test_repeated_ids_null_ids_and_empty(spark):
    rnd = random.Random(9)
    a, b = prose(rnd, 60), prose(rnd, 60)
    df = spark.createDataFrame([(1, a), (1, a), (2, b + a), (2, b), (None, a), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 99), r.n_bytes, r.n_removed) for r in S.remove_repeats(df).collect())
    la, lb = len(a.encode()), len(b.encode())
    # Equal rows are one document; the null id comes last; of the two texts with id 2 one keeps b.
    assert [g for g in got if g[0] == 1] == [(1, la, 0)] * 2
    assert [g for g in got if g[0] == 99] == [(99, 0, 0), (99, la, la)]
    removed = sorted(g[2] for g in got if g[0] == 2)
    assert removed in ([0, la + lb], sorted([la, lb]))
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    rows = [(f"d{i:03d}", t) for i, t in made(4)[:60]]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    assert sorted(tuple(r) for r in S.remove_repeats(df).collect()) == sorted(brute(rows))
    rnd = random.Random(1)
    a, last = prose(rnd, 60), (1 << 63) - 1
    df = spark.createDataFrame([(None, a), (last, a), (None, a + "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in S.remove_repeats(df).collect())
    n = len(a.encode())
    assert got == [(0, n), (0, n), (last, 0)]  # rows without id come after the largest id there is


def test_removal_is_decided_by_bytes(spark, monkeypatch):
    """With hashes of few values no different block is taken for a repeat: the job stops instead."""
    texts = [prose(random.Random(i), 80) for i in range(6)]
    real = S._scramble
    monkeypatch.setattr(S, "_scramble", lambda x: real(x) & np.uint64(1 << 60))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 7):
        with pytest.raises(Exception, match="take another seed"):
            S.remove_repeats(df.repartition(parts)).collect()


def test_another_seed_gives_the_same(spark):
    rows = made(5)[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in S.remove_repeats(df, seed=3).collect()) == sorted(brute(rows))


@pytest.mark.parametrize("size", [8, 9, 16, 107, 180])
def test_same_bytes(size):
    rng = np.random.default_rng(size)
    buf = rng.integers(0, 2, 80_000).astype(np.uint8)
    buf[40_000:] = buf[:40_000]
    a, b = rng.integers(0, 39_000, 300), rng.integers(40_000, 79_000, 300)
    b[::2] = a[::2] + 40_000
    buf[b[::20] + size - 1] ^= 1
    got = S.same_bytes(buf, a, b, np.full(300, size))
    assert got.tolist() == [buf[x:x + size].tobytes() == buf[y:y + size].tobytes() for x, y in zip(a, b)] and got.any() and not got.all()


def test_kept_bytes(spark):
    rows = made(3)[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in S.remove_repeats(df, with_text=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


@pytest.mark.parametrize("seed", range(3))
def test_equal_windows_choose_equal_anchors(seed):
    rng = np.random.default_rng(seed)
    buf = rng.integers(97, 100, 3000).astype(np.uint8)
    buf[1500:1900] = buf[100:500]
    h, b, first, distance, windows = S.blocks_of(buf, np.array([0]), np.array([3000]))
    assert windows.sum() == 3000 - N + 1 and (first[1:] == first[:-1] + windows[:-1]).all()
    assert distance.max() < S._SPAN and windows.max() <= S._SPAN
    anchor = {}
    for k in range(len(h)):
        for j in range(windows[k]):
            w = buf[first[k] + j:first[k] + j + N].tobytes()
            assert anchor.setdefault(w, (h[k], distance[k] - j)) == (h[k], distance[k] - j)
