"""Operator 2: gradients, windows, held-out accuracy."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from riskweave.llm import toxicity as T
from riskweave.sources.tables import read_table


def small():
    rnd = random.Random(0)
    good = ["meadow", "river", "stone", "green", "walk", "evening", "cloud"]
    texts, y = [], []
    for i in range(120):
        w = rnd.choices(good, k=rnd.randint(3, 90))
        if i % 3 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(["zorgle", "blortfink"])
        texts.append(" ".join(w).encode())
        y.append(int(i % 3 == 0))
    return texts, np.array(y)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    words = [b"river", b"stone", b"zorgle"]
    gram = {g: i + 1 for i, g in enumerate(sorted(set(T.grams_of(words)[0].tolist())))}
    net = T.Network({w: i + 1 for i, w in enumerate(words[:2])}, gram, np.array([0, .1, .2], np.float32),
                    rng.normal(size=len(gram) + 1).astype(np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    i = net.inputs(words)
    ids = np.array([[1, 2, 3, 1], [3, 2, 0, 0], [0, 0, 0, 0]])
    weight = rng.normal(size=3)

    def loss():
        x = net.embed(i)
        return float(weight @ net.forward(net.project(x), ids)[0])

    x = net.embed(i)
    _, kept = net.forward(net.project(x), ids, keep=True)
    g = net.backward(i, x, kept, weight)
    for k, v in net.p.items():
        for at in rng.integers(0, v.size, 4).tolist():
            old = v.flat[at]
            v.flat[at] = old + 1e-3
            up = loss()
            v.flat[at] = old - 1e-3
            down = loss()
            v.flat[at] = old
            assert abs((up - down) / 2e-3 - g[k].flat[at]) < 2e-2 * max(0.05, abs(g[k].flat[at])), (k, at)


def test_grams_are_those_of_each_word():
    words = ["abc", "é", "a", "wörter", "日本語"]
    keys, owner = T.grams_of([w.encode() for w in words])
    for k, w in enumerate(words):
        mine = {int(x) for x in keys[owner == k]}
        b = f"<{w}>"
        assert len(mine) == len({b[i:i + n] for n in (3, 4, 5) for i in range(len(b) - n + 1)})
        assert mine == {int(x) for x in T.grams_of([w.encode()])[0]}


def test_quick_form_equals_forward():
    texts, y = small()
    net = T.train(texts, y, epochs=1)
    words = sorted({w for t in texts for w in t.split()})
    proj = net.project(net.embed(net.inputs(words)))
    ids = np.random.default_rng(0).integers(1, len(words) + 1, (300, T.WINDOW))
    ids[::3, 5:] = 0
    assert np.allclose(T.window_logits(net, proj, ids), net.forward(proj, ids)[0], atol=1e-4)


def test_a_window_starts_at_every_word():
    for n in [0, 1, T.WINDOW - 1, T.WINDOW, T.WINDOW + 1, 500]:
        ids = np.arange(1, n + 1)
        got = T._windows(ids)
        assert len(got) == max(1, n - T.WINDOW + 1)
        assert all(np.array_equal(w[w > 0], ids[i:i + T.WINDOW]) for i, w in enumerate(got))


def test_score_is_that_of_a_plain_loop_over_all_windows():
    texts, y = small()
    net = T.train(texts, y, epochs=2)
    rnd, s = random.Random(1), T.Scorer(net)
    kinds = sorted({w for t in texts for w in t.split()}) + [b"unseen", "wörter".encode()]
    for n in (0, 1, 7, 8, 9, 40, 300):
        words = rnd.choices(kinds, k=n)
        own = sorted(set(words))
        proj = net.project(net.embed(net.inputs(own)))
        logits = []
        for a in range(max(1, n - T.WINDOW + 1)):
            ids = [own.index(w) + 1 for w in words[a:a + T.WINDOW]]
            logits.append(net.forward(proj, np.array([ids + [0] * (T.WINDOW - len(ids))]))[0][0])
        assert abs(s.scores([b" ".join(words)])[0] - 1 / (1 + np.exp(-max(logits)))) < 1e-5


def test_learns_and_scores_the_worst_window(monkeypatch):
    texts, y = small()
    net = T.train(texts, y)
    scores = T.Scorer(net).scores(texts)
    assert np.mean((np.array(scores) >= 0.5) == y) > 0.97
    # The score of a long text is that of its worst window, wherever that is.
    clean = b"river stone green " * 400
    s = T.Scorer(net)
    assert s.scores([clean])[0] < 0.5 < s.scores([clean + b"zorgle " + clean])[0]
    alone = [s.scores([b" ".join(clean.split()[a:a + T.WINDOW])])[0] for a in range(300 - T.WINDOW + 1)]
    assert abs(max(alone) - s.scores([b" ".join(clean.split()[:300])])[0]) < 1e-5
    # The word cache may be dropped at any time.
    monkeypatch.setattr(T, "_CACHE", 5)
    few = T.Scorer(net)
    assert np.allclose([few.scores([t])[0] for t in texts], scores, atol=1e-5)
    assert T.train(texts, np.zeros(len(y), int)) is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents", ["doc_id", "text"]), read_table(spark, sf, "labels")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = T.toxicity(some, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    hit = sum(r.predicted == r.toxic for r in held) / len(held)
    found = [r.predicted for r in held if r.toxic]
    assert hit > 0.97 and np.mean(found) >= 0.92


def test_edge_rows(spark):
    texts, y = small()
    rows = [(i, t.decode(), "s") for i, t in enumerate(texts)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "?!", "s"), (None, "zorgle", "s"), (3, rows[3][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(k), None) for i, k in enumerate(y)] + [(900, 1, None), (901, None, None), (None, 1, None)],
                                   "doc_id long, toxic long, quality long")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    empty = {r.score for r in got if r.doc_id in (900, 901, 902)}
    assert len(empty) == 1
    # An id with many texts brings one of them to the fit.
    many = spark.createDataFrame([(5, f"river stone {i}") for i in range(3000)], "doc_id long, text string")
    collected = []
    real = T.train
    T.train = lambda t, *a, **k: collected.append(len(t)) or real(t, *a, **k)
    try:
        assert T.fit(docs.select("doc_id", "text").union(many), labels) is not None and collected[0] <= 120
    finally:
        T.train = real
    none = T.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert T.toxicity(docs.limit(0), labels).count() == 0
    assert T.toxicity(docs, labels.where(F.lit(False))).count() == len(rows)
