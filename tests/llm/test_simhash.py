"""Operator 5 against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskweave.llm import simhash as S
from riskweave.llm.components import connected_components, local_stars

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def brute_components(ids, prints, bits=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


def made():
    rnd = random.Random(1)
    vocab = [f"w{i}é" for i in range(50)]
    texts = []
    for _ in range(12):
        base = rnd.choices(vocab, k=rnd.randint(1, 120))
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append("\n ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    texts += [None, "", " \t", "one", "ONE", "a b c", "a b c d", "a b c d", "x " * 5000]
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    return ids, texts


def test_classes_match_brute_force(spark):
    ids, texts = made()
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()}
    prints = [brute_print(t) for t in texts]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_components(ids, prints))}
    assert got == want
    kept = S.dedupe(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "quite other words here now"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in S.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 2)]
    assert S.dedupe(df).count() == 3
    assert S.near_duplicates(df.limit(0)).count() == 0
    assert S.dedupe(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, wide", [(3, False), (2048, False), (3, True), (2048, True)])
def test_links_lose_no_pair(spark, block, wide):
    """All pairs within 4 bits stay connected, dense balls and split buckets included."""
    rng = np.random.default_rng(block)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(30):
            p = centre
            for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                p ^= 1 << bit
            prints.add(p)
    prints = sorted(prints)
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(S.links(df, block=block, wide=wide)).collect()}
    got = [roots.get(p, p) for p in signed]
    want = brute_components(list(range(len(prints))), prints)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_wide_keys_bring_fewer_pairs_together(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(x),) for x in rng.integers(-(1 << 63), 1 << 63, 30_000)], "fp long")

    def pairs(wide):
        n = df.select(F.explode(S._keys(F.col("fp"), wide)).alias("k")).groupBy("k").count()
        return n.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]

    assert pairs(True) < pairs(False) / 20


def test_classes_are_the_same_by_wide_keys(spark, monkeypatch):
    ids, texts = made()
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    want = sorted(S.near_duplicates(df).collect())
    monkeypatch.setattr(S, "WIDE", 1)
    assert sorted(S.near_duplicates(df).collect()) == want


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3)] + [(500, 500 + i) for i in range(1, 40)]
    df = spark.createDataFrame(path, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {500 + i: 500 for i in range(1, 40)}
    assert connected_components(df.limit(0)).count() == 0
    u, v = local_stars(np.array([5, 4, 9]), np.array([4, 3, 8]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(4, 3), (5, 3), (9, 8)]


def test_fingerprint_uses_sparks_own_xxhash64(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c é"))).first()[0] & (1 << 64) - 1
    assert h == xxhash.xxh64_intdigest("a b c é".encode(), 42) == S.fingerprint("a b c é".encode())
