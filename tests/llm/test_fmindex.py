"""Operator 9 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from riskweave.llm import fmindex as FM

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, window=FM.WINDOW):
    wins = {}
    for item, text in bench:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, items = set(), set()
        for i in range(len(w)):
            for size in {len(x) for x in wins}:
                if i + size <= len(w) and tuple(w[i:i + size]) in wins:
                    hit.update(range(i, i + size))
                    items |= wins[tuple(w[i:i + size])]
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(items), sha, bool(hit)))
    return sorted(out, key=str)


def made(seed=3):
    rnd = random.Random(seed)
    vocab = ["a", "b", "Ça", "d1", "e", "é"]
    bench = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 10, 14])))) for i in range(6)]
    bench = [(i, t) for i, t in bench if len(t.split()) > 2] + [(90, None), (91, ""), (92, "...;"), (93, bench[1][1])]
    docs = [(i, " ".join(rnd.choices(vocab + ["zz"], k=rnd.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"x y, {t}! zz {t}") for i, (_, t) in enumerate(bench)]
    docs += [(200, None), (201, ""), (202, "  "), (202, "  "), (None, bench[0][1]), (203, bench[0][1].upper())]
    return docs, bench


def test_matches_brute_force(spark):
    docs, bench = made()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((tuple(r) for r in FM.decontaminate(d, b).collect()), key=str)
    assert got == brute(docs, bench)


def test_blocks_shards_and_clashing_columns(spark, monkeypatch):
    docs, bench = made(5)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words long, _out string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(FM, "BLOCK_BYTES", 60)
    monkeypatch.setattr(FM, "SHARD_SYMBOLS", 20)
    got = sorted((tuple(r) for r in FM.decontaminate(d, b).collect()), key=str)
    assert got == brute(docs, bench)
    clean = FM.drop_contaminated(d, b)
    assert clean.columns == d.columns
    assert clean.count() == sum(not r[-1] for r in brute(docs, bench))


def test_empty_tables(spark):
    docs, bench = made()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert not any(r.contaminated for r in FM.decontaminate(d, b.limit(0)).collect())
    assert FM.decontaminate(d.limit(0), b).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    seq = np.append(rng.integers(0, 4, 300), 0)
    index = FM.FMIndex(seq, 3, sample=7)
    pats = [tuple(rng.integers(1, 4, rng.integers(1, 5))) for _ in range(30)]
    width = max(map(len, pats))
    mat = np.array([[0] * (width - len(p)) + list(p) for p in pats])
    lo, hi = index.search(mat, np.array([len(p) for p in pats]))
    for p, a, b in zip(pats, lo, hi):
        want = [i for i in range(len(seq) - len(p) + 1) if tuple(seq[i:i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_repeated_benchmark_rows_share_no_block(spark, monkeypatch):
    """A benchmark of which a third is one row has blocks as small as without the repeats."""
    items = [(f"i{k}", f"item {k} has words of its own, such as w{k} x{k} y{k} z{k}") for k in range(60)]
    bench = items + items[:1] * 30
    docs = [(k, f"before it {t} and after") for k, (_, t) in enumerate(items[:9])] + [(99, "nothing of that")]
    monkeypatch.setattr(FM, "BLOCK_BYTES", 500)
    sizes, build = [], FM.Windows

    def windows(rows, *rest):
        sizes.append(sum(len(t) for _, t in rows))
        return build(rows, *rest)

    monkeypatch.setattr(FM, "Windows", windows)
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    out = FM.decontaminate(docs, spark.createDataFrame(bench, "item_id string, text string"))
    assert sum(sizes) == sum(len(t) for _, t in items) and max(sizes) < 3 * 500
    monkeypatch.setattr(FM, "Windows", build)
    plain = FM.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(out.collect()) == sorted(plain.collect())


def test_blocks_do_not_chain_and_long_documents(spark, monkeypatch):
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(40)]
    long = " ".join(f"filler{i % 977}" for i in range(60_000)) + " " + items[7][1] + " end " + items[30][1]
    docs = [(1, long), (2, items[3][1]), (2, items[3][1]), (3, None), (4, "clean")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    one = FM.decontaminate(d, b)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "Exchange" not in text
    want = sorted(one.collect())
    assert want[0].n_hit == 24 and want[0].n_items == 2 and [r.contaminated for r in want] == [True, True, True, False, False]
    monkeypatch.setattr(FM, "BLOCK_BYTES", 300)
    many = FM.decontaminate(d, b)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # the merge; the passes are written
    assert sorted(many.collect()) == want
