"""Operator 6 against a plain fill."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.llm import sharding as S


def test_fill_is_even_and_follows_preferences():
    import hashlib
    names = [f"n{i}" for i in range(7)]
    owner = S.fill(names, 101)
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    # By full permutations: each shard in turn claims its first free slot.
    perms = []
    for n in names:
        d = hashlib.md5(n.encode()).digest()
        off, skip = int.from_bytes(d[:8], "big") % 101, int.from_bytes(d[8:], "big") % 100 + 1
        perms.append([(off + k * skip) % 101 for k in range(101)])
        assert len(set(perms[-1])) == 101
    want, turn = {}, 0
    while len(want) < 101:
        slot = next(s for s in perms[turn % 7] if s not in want)
        want[slot], turn = turn % 7, turn + 1
    assert owner == [want[s] for s in range(101)]


def test_losing_a_shard_moves_few():
    names = [f"n{i}" for i in range(20)]
    a, b = S.fill(names, 4999), S.fill(names[:-1], 4999)
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved < 0.15 * 4999


def test_bad_tables():
    with pytest.raises(ValueError):
        S.fill(["a"], 100)
    with pytest.raises(ValueError):
        S.fill([], 101)


def test_placement(spark):
    rows = [(i, "t", "old") for i in range(3000)] + [(None, "n", None), (5, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = S.place(df, shards=10, slots=1009, slot_col="slot").collect()
    assert len(out) == len(rows)
    table = S.fill([f"shard-{i:05d}" for i in range(10)], 1009)
    assert all(r.shard == f"shard-{table[r.slot]:05d}" for r in out)
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    sizes = Counter(r.shard for r in out)
    assert len(sizes) == 10 and max(sizes.values()) < 1.4 * 300
    assert S.place(df.limit(0)).count() == 0
    same = spark.createDataFrame([("5",)], "doc_id string")
    assert S.place(same, shards=10, slots=1009).first().shard == next(r.shard for r in out if r.doc_id == 5)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 7, "old", "s")], "doc_id long, _row string, _slot int, Shard string, _shard string")
    out = S.place(df)
    assert out.columns == ["doc_id", "_row", "_slot", "_shard", "shard"]
    r = out.first()
    assert (r._row, r._slot, r._shard) == ("a", 7, "s") and r.shard.startswith("shard-")
    assert S.place(df, slot_col="_SLOT").columns == ["doc_id", "_row", "_shard", "shard", "_SLOT"]
    assert S.place(df.select("Shard", F.col("doc_id").alias("id")).select("Shard", "id"), "id").columns == ["id", "shard"]
