"""Operator 8, language identification by hyperdimensional profiles.

Every letter has a random vector of +1 / -1 drawn from its code point. A letter
n-gram binds its letters, each permuted (rolled) by its place: for ``abc``
roll(a, 2) * roll(b, 1) * c. A text's vector bundles (adds) the vectors of all
its n-grams, and is compared by cosine with one prototype per language: the
bundle of that language's training texts, less the mean of all prototypes, so
that n-grams common to every language count for none.

Anything that is not a letter is one word boundary, a symbol with a vector of
its own. Prototypes are fitted on a bounded sample of labelled rows
(``TRAIN_DOCS`` documents of each of the ``MAX_LANGS`` most frequent languages, by
hash order); every text is scored whole. With D dimensions, the vectors of a batch are one product of the
document x n-gram count matrix with the n-gram vectors.

Edge cases: null text, or no letter: ``und``, score 0; ties go to the language
first in code-point order; without any training row every text is ``und``;
repeated rows are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, prepare

DIM = 1024          # dimensions of a vector
NGRAM = 3           # letters
MAX_LANGS = 256     # languages that are learned, those of most documents (a bound on the fit)
TRAIN_DOCS = 1500   # documents of a language that prototypes are fitted on, about (a bound on the fit)
SHARPNESS = 20.0    # softmax weight of the cosines in the score
SEED = 20240229
_DOCS = 256         # documents multiplied at once
_CHARS = 1 << 18    # characters whose n-grams are counted at once
_CACHE = 40_000     # n-gram vectors a task keeps


def _letters() -> np.ndarray:
    """For each code point whether it is a letter (Unicode category L*)."""
    table = np.zeros(0x110000, bool)
    for cp in range(len(table)):
        table[cp] = unicodedata.category(chr(cp))[0] == "L"
    # Blocks of ideographs that later versions of Unicode than this Python's have filled.
    table[0x20000:0x2FFFE] = table[0x30000:0x3FFFE] = True
    return table


class Vectors:
    """Letter and n-gram vectors, made when first met."""

    def __init__(self, dim: int = DIM, ngram: int = NGRAM, seed: int = SEED):
        self.dim, self.ngram, self.seed = dim, ngram, seed
        self.is_letter = _letters()
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.matrix = np.empty((0, dim), np.int8)

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            rng = np.random.default_rng([self.seed, cp])
            self.letters[cp] = rng.integers(0, 2, self.dim, np.int8) * 2 - 1
        return self.letters[cp]

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of the n-grams (21 bits a letter), as rows."""
        if len(self.row) + len(grams) > _CACHE:
            self.row, self.matrix = {}, np.empty((0, self.dim), np.int8)
        new = [g for g in grams.tolist() if g not in self.row]
        if new:
            made = np.ones((len(new), self.dim), np.int8)
            for i, g in enumerate(new):
                for place in range(self.ngram):
                    made[i] *= np.roll(self.letter(g >> 21 * place & 0x1FFFFF), place)
                self.row[g] = len(self.row)
            self.matrix = np.concatenate([self.matrix, made])
        return self.matrix[[self.row[g] for g in grams.tolist()]].astype(np.float32)

    def grams(self, text: str) -> Iterator[np.ndarray]:
        """The letter n-grams of a text, each as one integer, in parts; none without a letter."""
        tail, letters = np.zeros(1, np.int64), False  # one boundary (0) before the first word
        for a in range(0, len(text), _CHARS):
            cp = np.frombuffer(text[a:a + _CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = self.is_letter[cp]
            letters = letters or bool(letter.any())
            # A run of others is one boundary: its first stays, if a letter comes before.
            s = np.where(letter, cp, 0)[letter | np.r_[tail[-1] != 0, letter[:-1]]].astype(np.int64)
            s = np.concatenate([tail, s])
            if a + _CHARS >= len(text):
                s = np.concatenate([s, np.zeros(int(s[-1] != 0), np.int64)])
                if not letters:
                    return
                s = np.pad(s, (0, max(0, self.ngram - len(s))))
            if len(s) >= self.ngram:
                out = np.zeros(len(s) - self.ngram + 1, np.int64)
                for place in range(self.ngram):
                    out = out << 21 | s[place:len(out) + place]
                yield out
            tail = s[-(self.ngram - 1):]

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A text's vector in each row, and whether it has a letter."""
        out, found = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), bool)
        doc, gram, count, held = [], [], [], 0
        for i, t in enumerate(texts):
            for g in self.grams(t):
                found[i] = True
                u, n = np.unique(g, return_counts=True)
                doc.append(np.full(len(u), i))
                gram.append(u)
                count.append(n)
                held += len(u)
                if held > 400_000:
                    self._add(out, doc, gram, count)
                    held = 0
        self._add(out, doc, gram, count)
        return out, found

    def _add(self, out: np.ndarray, doc: list, gram: list, count: list) -> None:
        if not doc:
            return
        d, g, n = np.concatenate(doc), np.concatenate(gram), np.concatenate(count)
        kinds, at = np.unique(g, return_inverse=True)
        for a in range(0, len(kinds), _CACHE // 4):
            here = (at >= a) & (at < a + _CACHE // 4)
            if here.any():
                v = self.rows(kinds[a:a + _CACHE // 4])
                first = int(d[here].min())
                counts = np.zeros((int(d[here].max()) - first + 1, len(v)), np.float32)
                np.add.at(counts, (d[here] - first, at[here] - a), n[here].astype(np.float32))
                out[first:first + len(counts)] += counts @ v
        doc.clear(), gram.clear(), count.clear()


def _vectors(cache: list, dim: int, ngram: int) -> Vectors:
    if not cache:
        cache.append(Vectors(dim, ngram))
    return cache[0]


def fit(docs: DataFrame, dim: int = DIM, ngram: int = NGRAM, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, one row each.

    Learns from text and non-null lang of rows that are not held out; of each
    language about ``train_docs`` documents, those of smallest id hash. The
    driver gets one vector a language and task.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    most = [(r["lang"], train_docs / r["n"]) for r in sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()]
    if not most:
        return [], np.zeros((0, dim), np.float32)
    shares = docs.sparkSession.createDataFrame(most, "lang string, share double")  # MAX_LANGS rows at most
    sample = (rows.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("_at"))
                  .join(F.broadcast(shares), "lang").where(F.col("_at") < F.col("share") * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]):
        vectors, sums = Vectors(dim, ngram), {}
        for rb in batches:
            lang = rb.column(0).to_pylist()
            text = rb.column(1).to_pylist()
            for a in range(0, len(text), _DOCS):
                b, _ = vectors.bundles(text[a:a + _DOCS])
                length = np.linalg.norm(b, axis=1, keepdims=True)
                b /= np.where(length > 0, length, 1)  # each document weighs alike
                for i, k in enumerate(lang[a:a + _DOCS]):
                    sums[k] = sums.get(k, 0) + b[i].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                          pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                         names=["lang", "v"])

    parts = sample.select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    total = (parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
                  .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")))
    got = sorted((r["lang"], [e["x"] for e in r["v"]]) for r in total.collect())
    langs = [k for k, _ in got]
    protos = np.round(np.array([v for _, v in got]).reshape(len(langs), dim), 6)
    if not langs:
        return [], np.zeros((0, dim), np.float32)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        protos -= protos.mean(axis=0)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    return langs, protos.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """``_row`` with the ``keep`` columns, ``_out`` with lang_pred and score (the
    language's share in a softmax of the cosines)."""
    langs, protos = model
    cache: list = []

    def run(batches: Iterator[pa.RecordBatch]):
        vectors = _vectors(cache, protos.shape[1], NGRAM)
        for rb in batches:
            raw = rb.column(1).to_pylist()
            lang, score = [], []
            for a in range(0, len(raw), _DOCS):
                texts = [(t or b"").decode("utf-8", "replace") for t in raw[a:a + _DOCS]]
                b, found = vectors.bundles(texts)
                length = np.linalg.norm(b, axis=1)
                cosine = (b @ protos.T) / np.where(length > 0, length, 1)[:, None]
                for i in range(len(texts)):
                    if not langs or not found[i]:
                        lang.append("und")
                        score.append(0.0)
                    else:
                        e = np.exp(SHARPNESS * (cosine[i] - cosine[i].max()).astype(np.float64))
                        best = int(e.argmax())
                        lang.append(langs[best])
                        score.append(float(e[best] / e.sum()))
            yield rb, pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=["lang_pred", "score"])

    return map_texts(docs, run, "struct<lang_pred:string,score:double>", keep, text)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    prepare(docs.sparkSession)
    out = predict(docs, fit(docs.select("doc_id", "text", "lang")), ["doc_id"])
    return out.select(F.col("_row.doc_id").alias("doc_id"), held_out(F.col("_row.doc_id")).alias("held_out"),
                      F.col("_out.lang_pred").alias("lang_pred"), F.col("_out.score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``, or a score under ``min_score``)."""
    prepare(docs.sparkSession)
    out = predict(docs, fit(docs.select("doc_id", "text", "lang")), docs.columns)
    return out.where((F.col("_out.lang_pred") != "und") & (F.col("_out.score") >= min_score)).select("_row.*")
