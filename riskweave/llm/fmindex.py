"""Operator 9, benchmark decontamination with an FM-index per training shard.

Words are lower-cased (A-Z) runs of digits, letters a-z and non-ASCII
characters. A window is ``WINDOW`` consecutive words of a benchmark item; a
shorter item is one window. A shard is a bounded run of documents of one Spark
task. Its words are numbered by the benchmark's vocabulary and an FM-index is
built over them: suffix order by prefix doubling, Burrows-Wheeler transform in a
wavelet matrix, suffix positions sampled every ``SAMPLE`` words. All windows are
searched backwards at once, their occurrences located by walking to the next
sampled position, and the covered words merged into removal spans.

Two exact reductions keep the index small: a word that is in no benchmark item
ends a run (no window crosses it), and a run shorter than the shortest window is
left out (no window fits in it). No occurrence is lost by either.

The benchmark's distinct rows are cut into blocks by hash, of about ``BLOCK_BYTES``
of text each (more where a single item is longer). A block is sent to the tasks by
broadcast. A benchmark of one block needs one pass over the documents and no
shuffle. A larger one is worked off block by block: a pass writes the spans of the
texts that were hit, and its broadcast is dropped before the next begins, so that one
block is held at any time; at the end the written spans are joined to the documents
by the SHA-256 of their text and merged.

Edge cases: null or wordless texts and items have no words and no windows;
equal windows of several items count for each of them; a null item_id is the
empty text; repeated documents are each reported; an empty benchmark finds
nothing; no document crosses into another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, step

WINDOW = 10              # words
SAMPLE = 16              # distance of sampled suffix positions, in words
SHARD_SYMBOLS = 400_000  # indexed words of one shard, at most (a longer single document is a shard alone)
SHARD_BYTES = 24 << 20   # text of one shard, at most (same exception)
BLOCK_BYTES = 16 << 20   # benchmark text sent to the tasks at once

# Byte classes: letters a-z (after lower-casing), digits and all bytes of non-ASCII characters make words.
_WORD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
              else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


class WaveletMatrix:
    """Rank and access over a sequence of small integers, a bit per level and symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, ones))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    @staticmethod
    def _ones(level, i: np.ndarray) -> np.ndarray:
        packed, ones = level
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return ones[word] + np.bitwise_count(packed[word] & low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position i."""
        start, end = np.zeros_like(i), i
        for k, level in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            s, e = self._ones(level, start), self._ones(level, end)
            start = np.where(one, self.zeros[k] + s, start - s)
            end = np.where(one, self.zeros[k] + e, end - e)
        return end - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        symbol, start, at = np.zeros_like(i), np.zeros_like(i), i
        for k, level in enumerate(self.levels):
            s, e = self._ones(level, start), self._ones(level, at)
            one = (level[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            symbol = symbol << 1 | one
            start = np.where(one, self.zeros[k] + s, start - s)
            at = np.where(one, self.zeros[k] + e, at - e)
        return symbol, at - start


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix positions in order. Symbol 0 ends a run; each 0 counts as a symbol of
    its own (ordered by position, before all others), so no order crosses a run."""
    n = len(seq)
    ends = np.flatnonzero(seq == 0)
    counts = np.bincount(seq, minlength=1)
    counts[0] = 0
    below = len(ends) + np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank = below[seq]
    rank[ends] = np.arange(len(ends))
    active = np.flatnonzero((seq != 0) & (counts[seq] > 1))
    k = 1
    while len(active):
        # An active suffix has k symbols in common with another, none of them a 0, so + k is in range.
        first, second = rank[active], rank[active + k]
        order = np.argsort(first * n + second)
        active, first, second = active[order], first[order], second[order]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        old = np.r_[True, first[1:] != first[:-1]]
        at = np.arange(len(active))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = first + start - np.maximum.accumulate(np.where(old, at, 0))
        alone = new & np.r_[new[1:], True]
        active, k = active[~alone], 2 * k
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Backward search over runs of symbols >= 1 that are each closed by a 0."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        order = suffix_order(seq)
        before = seq[order - 1]  # the transform; row of position 0 wraps to the last 0
        counts = np.bincount(seq, minlength=symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.bwt = WaveletMatrix(before, max(1, int(symbols).bit_length()))
        # Sampled: every sample-th position, and each run's first (a walk never leaves its run).
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.kept_before = kept, np.cumsum(kept) - kept
        self.positions = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of right-aligned patterns, all stepped together."""
        last = patterns[:, -1]
        lo, hi = self.first[last].copy(), self.first[last + 1].copy()
        for back in range(2, patterns.shape[1] + 1):
            go = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(go):
                break
            c = patterns[go, -back]
            lo[go] = self.first[c] + self.bwt.rank(c, lo[go])
            hi[go] = self.first[c] + self.bwt.rank(c, hi[go])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled position, add the steps."""
        out = np.empty(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.kept[row]
            out[todo[done]] = self.positions[self.kept_before[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            if len(row):
                symbol, rank = self.bwt.access_rank(row)
                row = self.first[symbol] + rank
            steps += 1
        return out


class Windows:
    """Distinct windows of a benchmark block, right-aligned, with the items that hold them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                holders.setdefault(tuple(ids[i:i + window]), set()).add(item)
        self.lengths = np.array([len(w) for w in holders], np.int64)
        self.shortest = int(self.lengths.min()) if len(holders) else 0
        self.patterns = np.zeros((len(holders), window), np.int64)
        for row, w in enumerate(holders):
            self.patterns[row, window - len(w):] = w
        self.items = [sorted(s) for s in holders.values()]


def _runs(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of the words in runs (of ids >= 1) that are long enough for a window."""
    inside = np.r_[False, ids > 0, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    long = end - start >= shortest
    start, size = start[long], (end - start)[long]
    if not len(start):
        return np.empty(0, np.int64)
    first = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - first, size)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class _Shard:
    """Documents gathered for one index."""

    def __init__(self, windows: Windows):
        self.w = windows
        self.clear()

    def clear(self) -> None:
        self.docs = self.symbols = self.size = 0
        self.ids, self.doc, self.word = [], [], []

    def add(self, text: bytes) -> int:
        ws = words_of(text)
        self.size += len(text)
        if ws and self.w.shortest:
            get = self.w.vocab.get
            ids = np.array([get(x, 0) for x in ws], np.int64)
            at = _runs(ids, self.w.shortest)
            if len(at):
                # A 0 after each run.
                cut = np.flatnonzero(np.diff(at) > 1) + 1
                self.ids.append(np.append(np.insert(ids[at], cut, 0), 0))
                self.word.append(np.append(np.insert(at, cut, -1), -1))
                self.doc.append(np.full(len(self.ids[-1]), self.docs))
                self.symbols += len(self.ids[-1])
        self.docs += 1
        return len(ws)

    def full(self) -> bool:
        return self.symbols >= SHARD_SYMBOLS or self.size >= SHARD_BYTES

    def hits(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Merged word spans and matched items by document of the shard."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if not self.ids:
            return spans, items
        seq, doc, word = (np.concatenate(x) for x in (self.ids, self.doc, self.word))
        index = FMIndex(seq, len(self.w.vocab))
        lo, hi = index.search(self.w.patterns, self.w.lengths)
        n = hi - lo
        if not n.sum():
            return spans, items
        pattern = np.repeat(np.arange(len(n)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        at = index.locate(row)
        cover = np.zeros(len(seq) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.w.lengths[pattern], -1)
        inside = np.r_[False, np.cumsum(cover)[:-1] > 0, False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            spans.setdefault(int(doc[a]), []).append((int(word[a]), int(word[b - 1]) + 1))
        for d, p in np.unique(np.stack([doc[at], pattern], axis=1), axis=0).tolist():
            items.setdefault(d, set()).update(self.w.items[p])
        return spans, items


_OUT = "struct<n_words:bigint,spans:array<struct<first:int,end:int>>,items:array<string>>"


_KIND = pa.struct([("n_words", pa.int64()),
                   ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                   ("items", pa.list_(pa.string()))])


def _pass(windows: Windows):
    """mapInArrow function: the spans and items of one benchmark block beside each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(windows)
        held: list[tuple[pa.RecordBatch, list[int]]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            spans, items = shard.hits()
            first = 0
            for rb, counts in held:
                out = [{"n_words": n, "spans": [{"first": a, "end": b} for a, b in spans.get(first + i, [])],
                        "items": sorted(items.get(first + i, ()))} for i, n in enumerate(counts)]
                first += len(counts)
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(out, _KIND)],
                                                 names=["_row", "_text", "_out"])
            held.clear()
            shard.clear()

        for rb in batches:
            done = 0
            counts: list[int] = []
            for text in rb.column(1).to_pylist():
                counts.append(shard.add(text or b""))
                if shard.full():
                    held.append((rb.slice(done, len(counts)), counts))
                    done, counts = done + len(counts), []
                    yield from flush()
            if counts:
                held.append((rb.slice(done), counts))
        yield from flush()

    return run


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns ``_row`` (the ``keep`` columns), ``_text`` and ``_out``: n_words, the
    merged removal spans in words [first, end), and the sorted matched item ids.

    ``benchmark`` has item_id and text.
    """
    spark = prepare(docs.sparkSession)
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.col("text").cast("binary").alias("text")).where("text is not null")
    # Repeats add no window, and would all fall into one block.
    bench = step(bench.distinct(), "benchmark")
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(f"`{text}`").cast("binary").alias("_text"))

    def block(b: int):
        """One block, about BLOCK_BYTES of benchmark text, as a broadcast."""
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        return spark.sparkContext.broadcast(vars(Windows([(r.item, bytes(r.text)) for r in rows], window)))

    schema = f"{{}}, _text binary, _out {_OUT}"
    row = f"_row {src.schema['_row'].dataType.simpleString()}"
    if blocks == 1:
        return src.mapInArrow(_lazy_pass(block(0)), schema.format(row))
    parts, hashed = [], src.select(F.sha2("_text", 256).alias("_row"), "_text")
    for b in range(blocks):
        sent = block(b)
        hit = hashed.mapInArrow(_lazy_pass(sent), schema.format("_row string")).where(F.size("_out.spans") > 0)
        parts.append(step(hit.groupBy("_row").agg(F.first("_out").alias("_out")), "hits"))  # equal texts have equal spans
        sent.destroy()
    hits = reduce(DataFrame.union, parts).groupBy(F.col("_row").alias("_sha")).agg(F.collect_list("_out").alias("_hits"))
    rows = src.withColumn("_sha", F.sha2("_text", 256)).join(hits, "_sha", "left").select("_row", "_text", "_hits")
    return rows.mapInArrow(_merge_blocks, schema.format(row))


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, _text, the hits of each block) -> the hits of all."""
    for rb in batches:
        out = []
        for text, hits in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
            spans = merge_spans([(x["first"], x["end"]) for h in hits or () for x in h["spans"]])
            out.append({"n_words": len(words_of(text)), "spans": [{"first": a, "end": b} for a, b in spans],
                        "items": sorted({i for h in hits or () for i in h["items"]})})
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(out, _KIND)], names=["_row", "_text", "_out"])


def _lazy_pass(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows([])
        vars(windows).update(sent.value)
        yield from _pass(windows)(batches)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = find(docs, benchmark, [id_col], window=window)
    hit = F.aggregate("_out.spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]))
    return out.select(
        F.col(f"_row.`{id_col}`").alias(id_col), F.col("_out.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("_out.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_out.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_out.spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    return find(docs, benchmark, docs.columns, text, window).where(F.size("_out.spans") == 0).select("_row.*")
