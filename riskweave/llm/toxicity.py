"""Operator 2, toxicity: a bidirectional gated recurrent network with attention
pooling over word and character inputs, trained in numpy.

A word's input is its embedding, the mean embedding of its character 3- to
5-grams (so that forms never seen still have one), and two fixed features: the
log-odds of the word, and the largest log-odds of its character grams, both from
the training documents. Two GRUs read a window of ``WINDOW`` words from either
end; attention weighs the states of its words into one vector and a logit.

A document is scored by all windows of its whole text, one from every word on that
has a whole window after it (a shorter text is one window): the score is that of
the most toxic window. Training is the same: the loss is taken at the largest
window logit of a labelled document.

The fit uses a bounded sample of labelled rows: about ``TRAIN_DOCS`` documents
of each label, by id hash, one text each, of at most ``TRAIN_WORDS`` words. Rows
that are held out are never learned from; labels, lang, source and ids are no
inputs. What only longer documents hold is not learned: their windows are scored
like any other, by what shorter documents taught.

Edge cases: null, empty and wordless texts are one empty window, whose score is
the network's for a zero state; texts of any length are scored whole; a null
label is no label; of several texts of one id the fit takes one; without labels
of both kinds every score is 0; repeated rows are each scored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lookup, held_out, map_texts, prepare, step, texts_of
from .fmindex import words_of

WINDOW = 8                    # words; there is a window from every word on
TRAIN_DOCS = 1500             # labelled documents of each label, about: the bound of the fit
TRAIN_WORDS = 1500            # words of a training document, at most
MAX_WORDS, MAX_GRAMS = 30_000, 20_000  # embeddings, most frequent first
MIN_DOCS = 3                  # training documents that must hold a word or gram
DIM, HIDDEN, ATTEND = 8, 4, 4
EPOCHS, BATCH, RATE = 4, 32, 0.01  # few epochs: some labels are wrong, and are learned late
STEPS = 200                   # updates at least: a small sample is gone through more often
MISSED = 2.0                  # a toxic document that is missed weighs so much more than a clean one flagged
_CHUNK = 4096                 # windows run through the network at once
_CACHE = 120_000              # words a task keeps the inputs of


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Character 3- to 5-grams of all words at once, each word between < and >: the
    grams as numbers, and the position of their word. (A word has no < or >.)"""
    text = "".join(f"<{w.decode('utf-8', 'replace')}>" for w in words)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(cp == ord("<")) - 1
    keys, owners = [], []
    three = cp[:-2] | cp[1:-1] << np.uint64(21) | cp[2:] << np.uint64(42)
    odd, one = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
    four = three[:-1] * odd + cp[3:] + one
    five = four[:-1] * odd + cp[4:] + one
    for k, n in ((three, 3), (four, 4), (five, 5)):
        inside = owner[:len(k)] == owner[n - 1:n - 1 + len(k)]
        keys.append(k[inside])
        owners.append(owner[:len(k)][inside])
    return np.concatenate(keys), np.concatenate(owners)


class Network:
    """Parameters, forward and backward pass. ``word`` and ``gram`` number the embeddings; 0 is none."""

    def __init__(self, word: dict[bytes, int], gram: dict[int, int], word_odds: np.ndarray, gram_odds: np.ndarray,
                 seed: int = 7):
        rng = np.random.default_rng(seed)
        self.word, self.word_odds, self.gram_odds = word, word_odds, gram_odds
        self.grams = Lookup(np.array(list(gram), np.uint64))  # numbered from 1 in their order
        d = 2 * DIM + 2

        def random(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else shape[0]), shape).astype(np.float32)

        self.p = {"ew": 0.1 * random(len(word) + 1, DIM), "ec": 0.1 * random(len(gram) + 1, DIM),
                  "wx": random(2, d, 3 * HIDDEN), "bx": np.zeros((2, 3 * HIDDEN), np.float32),
                  "u": random(2, HIDDEN, 3 * HIDDEN), "wa": random(2 * HIDDEN, ATTEND),
                  "ba": np.zeros(ATTEND, np.float32), "va": random(ATTEND), "wo": random(2 * HIDDEN),
                  "bo": np.full(1, -1, np.float32)}

    def inputs(self, words: list[bytes]) -> dict:
        """What the network reads of each distinct word: row 0 is padding, word i is row i + 1."""
        w = np.array([0, *map(self.word.get, words, repeat(0))])
        flat, owner = np.empty(0, np.int64), np.empty(0, np.int64)
        if words:
            keys, of = grams_of(words)
            at = self.grams.find(keys)
            flat, owner = at[at >= 0] + 1, of[at >= 0] + 1
            order = np.argsort(owner, kind="stable")  # three sorted runs
            flat, owner = flat[order], owner[order]
        count = np.bincount(owner, minlength=len(w))
        has = np.flatnonzero(count)
        start = (np.cumsum(count) - count)[has]
        odds = np.zeros(len(w), np.float32)
        if len(has):
            odds[has] = np.maximum(np.maximum.reduceat(self.gram_odds[flat], start), 0)
        return {"w": w, "flat": flat, "owner": owner, "has": has, "start": start, "share": 1 / np.maximum(count, 1).astype(np.float32),
                "fixed": np.stack([self.word_odds[w], odds], axis=1)}

    def embed(self, i: dict) -> np.ndarray:
        chars = np.zeros((len(i["w"]), DIM), np.float32)
        if len(i["has"]):
            chars[i["has"]] = np.add.reduceat(self.p["ec"][i["flat"]], i["start"], axis=0)
        words = self.p["ew"][i["w"]] * (i["w"] > 0)[:, None]
        return np.concatenate([words, chars * i["share"][:, None], i["fixed"]], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input part of all gates, for both directions: (2, words, 3 * HIDDEN)."""
        return np.einsum("nd,kdh->knh", x, self.p["wx"]) + self.p["bx"][:, None]

    def forward(self, proj: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows ``ids`` (windows x WINDOW, 0 pads at the end)."""
        p, (n, length) = self.p, ids.shape
        mask = ids > 0
        states = np.empty((n, length, 2 * HIDDEN), np.float32)
        steps = []
        for k in range(2):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(length) if k == 0 else range(length - 1, -1, -1):
                x, hu = proj[k][ids[:, t]], h @ p["u"][k]
                zr = 0.5 + 0.5 * np.tanh(0.5 * (x[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN]))
                z, r, hun = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN:] + r * hun)
                m = mask[:, t, None]
                new = np.where(m, c + z * (h - c), h)
                if keep:
                    steps.append((k, t, h, z, r, hun, c))
                h = new
                states[:, t, k * HIDDEN:(k + 1) * HIDDEN] = h
        s = np.tanh(states @ p["wa"] + p["ba"])
        e = np.where(mask, s @ p["va"], -np.inf)
        top = e.max(axis=1, keepdims=True)
        a = np.exp(e - np.where(np.isfinite(top), top, 0))
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
        pooled = np.einsum("nt,nth->nh", a, states)
        logit = pooled @ p["wo"] + p["bo"][0]
        return logit, {"ids": ids, "mask": mask, "states": states, "steps": steps, "s": s, "a": a, "pooled": pooled}

    def backward(self, i: dict, x: np.ndarray, f: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        states, a, s, ids, mask = f["states"], f["a"], f["s"], f["ids"], f["mask"]
        g["wo"], g["bo"] = f["pooled"].T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["wo"]
        da = np.einsum("nth,nh->nt", states, dpool)
        ds = a[:, :, None] * dpool[:, None]
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", de, s)
        dpre = de[:, :, None] * p["va"] * (1 - s * s)
        g["wa"], g["ba"] = np.einsum("nth,nta->ha", states, dpre), dpre.sum(axis=(0, 1))
        ds += dpre @ p["wa"].T
        dproj = np.zeros((2, len(x), 3 * HIDDEN), np.float32)
        dh, last = None, None
        for k, t, h, z, r, hun, c in reversed(f["steps"]):
            if k != last:
                dh, last = np.zeros_like(h), k
            d = ds[:, t, k * HIDDEN:(k + 1) * HIDDEN] + dh
            m = mask[:, t, None]
            dn = np.where(m, d, 0)
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * hun * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=1)
            g["u"][k] += h.T @ du
            dh = np.where(m, 0, d) + dn * z + du @ p["u"][k].T
            np.add.at(dproj[k], ids[:, t], np.concatenate([dz, dr, dc], axis=1))
        g["bx"] = dproj.sum(axis=1)
        g["wx"] = np.einsum("nd,knh->kdh", x, dproj)
        dx = np.einsum("knh,kdh->nd", dproj, p["wx"])
        np.add.at(g["ew"], i["w"], dx[:, :DIM] * (i["w"] > 0)[:, None])
        each = (dx[:, DIM:2 * DIM] * i["share"][:, None])[i["owner"]]
        for d in range(DIM):
            g["ec"][:, d] += np.bincount(i["flat"], each[:, d], len(g["ec"]))
        return g

    def state(self) -> dict:
        return vars(self)

    @classmethod
    def load(cls, state: dict) -> Network:
        new = cls.__new__(cls)
        vars(new).update(state)
        return new


def _windows(ids: np.ndarray) -> np.ndarray:
    """All windows of a text of these words, one at least (0 pads at the end)."""
    padded = np.pad(ids, (0, max(0, WINDOW - len(ids))))
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)


def _log_odds(docs: Iterable[Iterable], label: np.ndarray, most: int) -> tuple[dict, np.ndarray]:
    """Numbers (from 1) and scaled log-odds of the most frequent features, by documents that hold them."""
    seen = [Counter(), Counter()]
    for features, y in zip(docs, label.tolist(), strict=True):
        seen[y].update(features)
    both = seen[0] + seen[1]
    kept = sorted((k for k, n in both.items() if n >= MIN_DOCS), key=lambda k: (-both[k], k))[:most]
    n1, n0 = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    odds = [np.log((seen[1][k] + 0.5) / (n1 + 1)) - np.log((seen[0][k] + 0.5) / (n0 + 1)) for k in kept]
    return {k: i + 1 for i, k in enumerate(kept)}, np.array([0.0, *odds], np.float32) / 3


def train(texts: list[bytes], label: np.ndarray, epochs: int = EPOCHS, seed: int = 7, steps: int = STEPS) -> Network | None:
    """A network fitted on whole texts, in ``epochs`` passes and ``steps`` updates at
    least; None without both labels."""
    if len(set(label.tolist())) < 2:
        return None
    docs = [words_of(t) for t in texts]
    word, word_odds = _log_odds((set(d) for d in docs), label, MAX_WORDS)
    gram, gram_odds = _log_odds((np.unique(grams_of(list(set(d)))[0]).tolist() if d else [] for d in docs), label, MAX_GRAMS)
    net, rng = Network(word, gram, word_odds, gram_odds, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    time, weight = 0, {y: len(label) / 2 / max(1, (label == y).sum()) for y in (0, 1)}
    weight[1] *= MISSED
    for _ in range(max(epochs, -(-steps * BATCH // len(docs)))):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            batch = [docs[i] for i in order[a:a + BATCH]]
            y = label[order[a:a + BATCH]]
            kinds = sorted({w for d in batch for w in d})
            at = {w: i + 1 for i, w in enumerate(kinds)}
            wins = [_windows(np.array([at[w] for w in d], np.int64)) for d in batch]
            i = net.inputs(kinds)
            x = net.embed(i)
            proj, ids = net.project(x), np.concatenate(wins)
            first = np.cumsum([0] + [len(w) for w in wins])
            logit = window_logits(net, proj, ids)
            best = np.array([s + int(logit[s:e].argmax()) for s, e in zip(first[:-1], first[1:], strict=True)])
            top, kept = net.forward(proj, ids[best], keep=True)
            # Away from 0 and 1 by a little: labels are of documents, and a window may show less.
            d = (1 / (1 + np.exp(-top)) - (0.02 + 0.96 * y)) * np.array([weight[k] for k in y.tolist()]) / len(y)
            g = net.backward(i, x, kept, d.astype(np.float32))
            time += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                net.p[k] = (net.p[k] - RATE * (m[k] / (1 - 0.9 ** time))
                            / (np.sqrt(v[k] / (1 - 0.99 ** time)) + 1e-6)).astype(np.float32)
    return net


def window_logits(net: Network, proj: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logits of many windows: those without padding by the quick form of ``forward``."""
    out, full = np.empty(len(ids)), ids[:, -1] > 0
    for part, logits in ((full, _full_logits), (~full, lambda n, x, i: n.forward(x, i)[0])):
        at = np.flatnonzero(part)
        for a in range(0, len(at), _CHUNK):
            out[at[a:a + _CHUNK]] = logits(net, proj, ids[at[a:a + _CHUNK]])
    return out


def _full_logits(net: Network, proj: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """``Network.forward`` for windows without padding: both directions at once, no masks,
    no state kept for a backward pass."""
    p, (n, length), h2 = net.p, ids.shape, 2 * HIDDEN
    half = np.ones(3 * HIDDEN, np.float32)
    half[:h2] = 0.5  # gates z and r are 0.5 + 0.5 tanh(x / 2)
    u = np.ascontiguousarray(p["u"] * half)
    turned = np.ascontiguousarray(ids.T)
    x, hu = np.empty((2, n, 3 * HIDDEN), np.float32), np.empty((2, n, 3 * HIDDEN), np.float32)
    zr, c, h = np.empty((2, n, h2), np.float32), np.empty((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((length, n, h2), np.float32)
    for t in range(length):
        np.take(proj[0], turned[t], axis=0, out=x[0], mode="clip")
        np.take(proj[1], turned[length - 1 - t], axis=0, out=x[1], mode="clip")
        np.matmul(h, u, out=hu)
        np.multiply(x[:, :, :h2], 0.5, out=zr)
        zr += hu[:, :, :h2]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[:, :, HIDDEN:], hu[:, :, h2:], out=c)
        c += x[:, :, h2:]
        np.tanh(c, out=c)
        h -= c
        h *= zr[:, :, :HIDDEN]
        h += c
        states[t, :, :HIDDEN] = h[0]
        states[length - 1 - t, :, HIDDEN:] = h[1]
    flat = states.reshape(length * n, h2)
    s = flat @ p["wa"]
    s += p["ba"]
    np.tanh(s, out=s)
    e = (s @ p["va"]).reshape(length, n)
    e -= e.max(axis=0)
    np.exp(e, out=e)
    # The output is linear in the pooled state: the states' own outputs are pooled.
    out = (flat @ p["wo"]).reshape(length, n)
    return (e * out).sum(axis=0) / e.sum(axis=0) + p["bo"][0]


class Scorer:
    """Scores whole texts; keeps the projected inputs of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.row: dict[bytes, int] = {}
        self.proj = np.ascontiguousarray(self.net.project(self.net.embed(self.net.inputs([]))))
        self.used = 1

    def _learn(self, new: list[bytes]) -> None:
        """Rows of the input table for words not met before; the table grows by doubling."""
        made = self.net.project(self.net.embed(self.net.inputs(new)))[:, 1:]
        need = self.used + len(new)
        if need > self.proj.shape[1]:
            grown = np.empty((2, max(need, 2 * self.proj.shape[1]), 3 * HIDDEN), np.float32)
            grown[:, :self.used] = self.proj[:, :self.used]
            self.proj = grown
        self.proj[:, self.used:need] = made
        for w in new:
            self.row[w] = len(self.row) + 1
        self.used = need

    def scores(self, texts: list[bytes]) -> list[float]:
        docs = [words_of(t) for t in texts]
        new = list({w for d in docs for w in d if w not in self.row})
        if len(self.row) + len(new) > _CACHE and self.row:
            self._reset()
            new = list({w for d in docs for w in d})
        if new:
            self._learn(new)
        best = np.full(len(docs), -np.inf)
        rows, owner, held = [], [], 0
        for k, d in enumerate(docs):
            windows = _windows(np.fromiter(map(self.row.__getitem__, d), np.int64, len(d)))
            rows.append(windows)
            owner.append(np.full(len(windows), k))
            held += len(windows)
            if held >= 4 * _CHUNK:
                self._run(rows, owner, best)
                held = 0
        self._run(rows, owner, best)
        return (1 / (1 + np.exp(-best))).tolist()

    def _run(self, rows: list[np.ndarray], owner: list[np.ndarray], best: np.ndarray) -> None:
        if not rows:
            return
        ids, own = np.concatenate(rows), np.concatenate(owner)
        rows.clear(), owner.clear()
        np.maximum.at(best, own, window_logits(self.net, self.proj, ids))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Network | None:
    """The network fitted on about ``train_docs`` labelled documents of each label."""
    prepare(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")) \
                  .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Of a document labelled twice, the larger label.
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, F.lit(train_docs / sizes[1])).otherwise(F.lit(train_docs / sizes[0]))
    some = step(known.where(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).coalesce(1), "labelled")
    sample = (docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(some, "doc_id")
                  .where("text is not null").where(F.length("text") <= 16 * TRAIN_WORDS))
    # One text of each id: as many rows as ids were taken.
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted((r["doc_id"], bytes(r["text"]), r["toxic"]) for r in sample.collect())
    rows = [r for r in rows if len(words_of(r[1])) <= TRAIN_WORDS]
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64))


def score(docs: DataFrame, net: Network | None, keep: list[str], text: str = "text") -> DataFrame:
    """``_row`` with the ``keep`` columns and the score in ``_out.score``."""
    sent = docs.sparkSession.sparkContext.broadcast(net.state() if net else None)

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(Network.load(sent.value)) if sent.value else None
        for rb in batches:
            texts = texts_of(rb)
            s: list[float] = []
            for a in range(0, len(texts), 256):
                s += scorer.scores(texts[a:a + 256]) if scorer else [0.0] * len(texts[a:a + 256])
            yield rb, pa.StructArray.from_arrays([pa.array(s, pa.float64())], names=["score"])

    return map_texts(docs, run, "struct<score:double>", keep, text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    out = score(docs, fit(docs, labels), ["doc_id"])
    return out.select(F.col("_row.doc_id").alias("doc_id"), held_out(F.col("_row.doc_id")).alias("held_out"),
                      F.col("_out.score").alias("score"), (F.col("_out.score") >= 0.5).cast("int").alias("predicted"))
