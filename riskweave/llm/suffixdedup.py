"""Operator 10, removal of repeated byte strings by depth-limited radix passes.

Every suffix of every text is ordered only through its first ``LENGTH`` bytes
(its window); equal windows are the repeats, and all but the first of each are
removed. The order is never built whole. Its passes, most significant digit
first, each drop what is alone in its group:

1. Digit of a content-chosen K-gram. Each window chooses its anchor, the K-gram
   of smallest hash in it (leftmost of ties). Neighbouring windows that choose
   the same anchor make a block. Equal windows choose alike, so a block whose
   anchor occurs nowhere else holds no repeat. This pass shuffles about one row
   per forty bytes of text, with no text in it.
2. Whole blocks. Blocks of different hashes differ. Those of equal hashes are
   taken to be repeats of the first of them and go no further; neighbouring ones
   with the same shift make one run, and every run is compared with the bytes of
   its earlier place, 8 bytes a digit, before a byte is removed. (Should two
   different blocks ever share both 64-bit hashes, the comparison fails and the
   job stops with an error; another ``seed`` gives other hashes.)
3. The windows of the blocks left, 8 bytes a pass, inside one anchor's group: 13
   passes reach the full depth, and groups that remain are equal windows.

So a hash only ever rules out: what is removed was equal by its digits.

A group with more than ``GROUP`` distinct blocks (one frequent line in many
places) is split by further digits before pass 3: halves of the anchor's
distance to the window start, each with the bytes all its windows have in common
as the new key, down to single windows if need be. So no task gets an unbounded
group, and nothing is left out.

"First" is the order (doc_id, then text hash where ids repeat, then start). Ids may
be of any type with an order. Rows that agree in doc_id and text are one document.
A null doc_id comes last. Null and empty texts have no windows; texts shorter than
a window keep all bytes; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import release

from .common import prepare, step, text_hash

LENGTH = 100        # bytes of a window: the depth of the order
GRAM = 20           # bytes of an anchor
GROUP = 512         # distinct blocks of one anchor that a task orders
_PIECE = 1 << 18    # bytes hashed at once (some 100 bytes of memory each)
_WINDOWS = 60_000   # windows ordered at once
_SPAN = LENGTH - GRAM + 1  # anchors a window chooses from
_POS = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_LAST_ID = (1 << 63) - 1
SEED = 10
_tables: dict[str, np.ndarray] = {}


def _powers(seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a random number for each byte value."""
    if _tables.get("seed") != seed:
        n = _PIECE + LENGTH + 2
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _tables[name] = np.cumprod(x)
        _tables["byte"] = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)
        _tables["seed"] = seed
    return _tables["up"], _tables["down"], _tables["byte"]


def _scramble(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def blocks_of(buf: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Blocks of the texts buf[first:end] (at most ``_PIECE`` + ``LENGTH`` bytes in all).

    Returns anchor hash, block hash, first window, anchor's distance from it, windows.
    """
    up, down, byte = _powers(seed)
    n = len(buf)
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    if n < LENGTH:
        return none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[buf] * up[:n], out=total[1:])
    h = total[GRAM:] - total[:-GRAM]
    h *= down[:len(h)]
    h = _scramble(h)
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= _SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    count = n - LENGTH + 1
    rest = _SPAN - width
    low = np.minimum(low[:count], low[rest:rest + count])
    change = np.zeros(n + 1, np.int64)
    long = end - first >= LENGTH
    np.add.at(change, first[long], 1)
    np.add.at(change, end[long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(change[:count]) > 0)
    if not len(window):
        return none
    anchor = (low[window] & _POS).astype(np.int64)
    text = np.searchsorted(first, window, "right")
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(window)] - 1
    a, z = window[new], window[last] + LENGTH
    body = _scramble((total[z] - total[a]) * down[a])
    return h[anchor[new]].view(np.int64), body.view(np.int64), a, anchor[new] - a, last - new + 1


def _pack(start, distance, windows):
    return start << 14 | distance << 7 | windows


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a:a + size] equals buf[b:b + size], for each pair: 8 bytes a digit
    (sizes are at least 8; the last digit ends where the bytes end)."""
    if not len(a):
        return np.zeros(0, bool)
    digit = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    count = -(-size // 8)
    row = np.repeat(np.arange(len(a)), count)
    at = np.minimum((np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * 8, (size - 8)[row])
    equal = digit[a[row] + at] == digit[b[row] + at]
    return np.logical_and.reduceat(equal, np.cumsum(count) - count)


def runs_of(doc: np.ndarray, start: np.ndarray, windows: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (ordered by document and start) joined where one goes on the other with
    the same further values: the first row of each run, and the windows of the run."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    goes_on = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + windows[:-1])
    for v in same:
        goes_on &= v[1:] == v[:-1]
    new = np.flatnonzero(np.r_[True, ~goes_on])
    return new, np.add.reduceat(windows, new)


_FOUND = "h bigint, b bigint, doc bigint, th bigint, pk bigint, len bigint"


def _find_blocks(seed: int):
    """(doc, th, text) -> a row per block (h, b, doc, th, pk), and rows with ``len``: runs of
    bytes (from ``pk`` on) that equal earlier ones of the same piece of work (a map-side combine)."""

    def emit(parts: list[tuple[int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(p[3]) for p in parts])
        end = np.cumsum(size)
        first = end - size
        buf = np.concatenate([p[3] for p in parts])
        h, b, a, distance, windows = blocks_of(buf, first, end, seed)
        if not len(h):
            return
        at = np.searchsorted(first, a, "right") - 1
        doc, th, offset = (np.array([p[i] for p in parts], np.int64) for i in range(3))
        start = a - first[at] + offset[at]
        pk = _pack(start, distance, windows)
        # Of equal blocks here all but the first are repeats, whatever else there is.
        order = np.lexsort((pk, th[at], doc[at], b, h))
        alike = order[1:][(h[order[1:]] == h[order[:-1]]) & (b[order[1:]] == b[order[:-1]])]
        before = order[:-1][(h[order[1:]] == h[order[:-1]]) & (b[order[1:]] == b[order[:-1]])]
        fits = windows[alike] == windows[before]
        alike, before = alike[fits], before[fits]
        equal = same_bytes(buf, a[alike], a[before], windows[alike] + LENGTH - 1)
        again = np.zeros(len(h), bool)
        again[alike[equal]] = True
        rep = np.flatnonzero(again)
        new, total = runs_of(at[rep], start[rep], windows[rep])
        rest, run = np.flatnonzero(~again), rep[new]
        zero = np.zeros(len(run), np.int64)
        cols = [np.concatenate([h[rest], zero]), np.concatenate([b[rest], zero]), np.concatenate([doc[at[rest]], doc[at[run]]]),
                np.concatenate([th[at[rest]], th[at[run]]]), np.concatenate([pk[rest], start[run]]),
                np.concatenate([np.zeros(len(rest), np.int64), total + LENGTH - 1])]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["h", "b", "doc", "th", "pk", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for rb in batches:
            for doc, th, text in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                data = np.frombuffer(text or b"", np.uint8)
                # Pieces of a long text overlap so that each window is in just one.
                for at in range(0, len(data) - LENGTH + 1, _PIECE - LENGTH):
                    piece = data[at:at + _PIECE - 1]
                    if held + len(piece) > _PIECE and parts:
                        yield from emit(parts)
                        parts, held = [], 0
                    parts.append((doc, th, at, piece))
                    held += len(piece)
        if parts:
            yield from emit(parts)

    return run


_RUN = "doc bigint, th bigint, start bigint, len bigint, doc0 bigint, th0 bigint, start0 bigint"


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, its blocks (pk, doc0, th0, pk0)) -> runs that repeat one earlier place."""
    for rb in batches:
        lists = rb.column(2)
        x = lists.flatten()
        owner = np.repeat(np.arange(rb.num_rows), np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64))
        pk, doc0, th0, pk0 = (x.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        order = np.lexsort((pk, owner))
        owner, pk, doc0, th0, pk0 = (v[order] for v in (owner, pk, doc0, th0, pk0))
        start, start0, windows = pk >> 14, pk0 >> 14, pk & 127
        new, total = runs_of(owner, start, windows, doc0, th0, start - start0)
        doc, th = (rb.column(i).to_numpy(zero_copy_only=False)[owner[new]] for i in range(2))
        cols = [doc, th, start[new], total + LENGTH - 1, doc0[new], th0[new], start0[new]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in _RUN.split(", ")])


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, text, list of (g, n, pk)) -> the bytes of each block."""
    for rb in batches:
        out: list[tuple] = []
        for doc, th, text, blocks in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            for x in blocks:
                start, distance, windows = x["pk"] >> 14, x["pk"] >> 7 & 127, x["pk"] & 127
                out.append((x["g"], x["n"], doc, th, start, distance, text[start:start + windows + LENGTH - 1]))
                if len(out) >= 10_000:
                    yield _block_batch(out)
                    out = []
        yield _block_batch(out)


_BLOCK = "g bigint, n bigint, doc bigint, th bigint, start bigint, distance bigint, bytes binary"
_NAMES = ["g", "n", "doc", "th", "start", "distance", "bytes"]


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_NAMES)


def radix_repeats(group: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, distance: np.ndarray,
                  texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of blocks (rows), compared inside a group: runs (row, first, windows).

    Most significant digit first, 8 bytes a digit, through ``length`` bytes.
    """
    size = np.array([len(t) for t in texts])
    count = size - length + 1
    row = np.repeat(np.arange(len(texts)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = np.repeat(np.cumsum(size) - size, count) + j
    digits = np.zeros((len(row), -(-length // 8) * 8), np.uint8)
    digits[:, :length] = np.lib.stride_tricks.sliding_window_view(buf, length)[at]
    digits = digits.view(">u8")
    # Windows can only be equal at the same distance from an anchor of the same group.
    key = np.unique(group, return_inverse=True)[1][row] * 256 + (distance[row] - j)
    alive = np.arange(len(row))
    for d in range(digits.shape[1] + 1):
        value = digits[alive, d - 1].astype(np.uint64) if d else key[alive].astype(np.uint64)
        order = np.lexsort((value, key[alive])) if d else np.argsort(value, kind="stable")
        alive, value = alive[order], value[order]
        same = np.r_[False, (key[alive[1:]] == key[alive[:-1]]) & (value[1:] == value[:-1])] if len(alive) else value > 0
        label = np.cumsum(~same)
        key[alive] = label
        together = same | np.r_[same[1:], False] if len(alive) else same
        alive = alive[together]
        if not len(alive):
            break
    if not len(alive):
        return (np.empty(0, np.int64),) * 3
    label = key[alive]
    place = np.empty(len(texts), np.int64)
    place[np.lexsort((start, th, doc))] = np.arange(len(texts))
    # Of equal windows the first by (doc, th, start) stays; starts of one document differ by j too.
    order = np.lexsort((start[row[alive]] + j[alive], th[row[alive]], doc[row[alive]], label))
    alive, label = alive[order], label[order]
    later = alive[np.r_[False, label[1:] == label[:-1]]]
    later.sort()
    new = np.flatnonzero(np.r_[True, (row[later[1:]] != row[later[:-1]]) | (j[later[1:]] != j[later[:-1]] + 1)])
    if not len(later):
        return (np.empty(0, np.int64),) * 3
    return row[later[new]], j[later[new]], np.r_[new[1:], len(later)] - new


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by g -> spans (doc, th, start, len) to remove. A group may span batches."""
    held: list[tuple] = []
    windows = 0

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            g, _, doc, th, start, distance, texts = zip(*rows, strict=True)
            doc, th, start = (np.array(x, np.int64) for x in (doc, th, start))
            row, first, count = radix_repeats(np.array(g), doc, th, start, np.array(distance), list(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (doc[row], th[row], start[row] + first, count + LENGTH - 1)],
                names=["doc", "th", "start", "len"])

    for rb in batches:
        for x in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if windows >= _WINDOWS and held[-1][0] != x[0]:
                yield from flush(held)
                held, windows = [], 0
            held.append(x)
            windows += len(x[6]) - LENGTH + 1
    yield from flush(held)


_SPANS = "doc bigint, th bigint, start bigint, len bigint"


def _solve_groups(blocks: DataFrame) -> DataFrame:
    """Spans of groups small enough for one task."""
    rows = blocks.select(*_NAMES).repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(_solve, _SPANS)


def _split(blocks: DataFrame, half: int) -> DataFrame:
    """Blocks of large groups, cut where an anchor's distance to the window start
    crosses a multiple of ``half``; the new key has the bytes all windows of a part share."""
    windows = F.length("bytes") - (LENGTH - 1)
    low = F.col("distance") - windows + 1  # distance of the last window
    part = F.explode(F.sequence(F.floor(low / half), F.floor(F.col("distance") / half))).alias("part")
    rows = blocks.withColumn("low", low).select("*", part)
    top = F.least(F.col("distance"), F.col("part") * half + half - 1)
    bottom = F.greatest(F.col("low"), F.col("part") * half)
    skip = (F.col("distance") - top).cast("int")
    rows = (rows.withColumn("skip", skip)
                .withColumn("cut", F.substring("bytes", F.col("skip") + 1, (top - bottom + LENGTH).cast("int"))))
    # Shared by all distances of the part, [part * half, part * half + half): from the anchor's
    # place less the least distance, to the end of the window at the largest.
    core = F.substring("bytes", (F.col("distance") - F.col("part") * half + 1).cast("int"), F.lit(LENGTH - half + 1))
    return rows.select(F.xxhash64("g", "part", core).alias("g"), "doc", "th", (F.col("start") + F.col("skip")).alias("start"),
                       top.cast("long").alias("distance"), F.col("cut").alias("bytes"))


def _merge_equal(rows: DataFrame, same: list[str], place: Column) -> tuple[DataFrame, DataFrame]:
    """(the written first row of each class of equal blocks, rows that repeat an earlier one).

    The classes are written before the join, so that both of its sides are plain
    shuffles and a frequent class is split by adaptive execution.
    """
    first = step(rows.groupBy(*same).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")), "first")
    repeats = rows.join(first.where("c > 1").drop("c"), same).where(place != F.col("first"))
    return first, repeats


def _with_count(first: DataFrame, key: str) -> DataFrame:
    """Rows of keys that have several, with their number ``n``."""
    many = step(first.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "many")
    return first.join(many, key)


def spans(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Spans (doc, th, start, len, want) of repeated bytes; they may overlap. ``want``
    has the bytes of the earlier place where they are still to be compared. ``docs``
    has doc, th, text."""
    none = F.lit(None).cast("binary").alias("want")
    texts = docs.select("doc", "th", "text")
    found_ = step(texts.mapInArrow(_find_blocks(seed), _FOUND), "anchors")
    found = [step(found_.where("len > 0").select("doc", "th", F.col("pk").alias("start"), "len"), "combined").withColumn("want", F.lit(None).cast("binary"))]
    blocks = found_.where("len = 0").drop("len")
    # Pass 1: blocks whose anchor occurs again.
    twice = step(blocks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    blocks = step(blocks.join(twice, "h", "left_semi"), "again")
    release(found_, twice)  # tables are deleted when what follows is written
    # Pass 2: equal blocks, in runs that repeat one earlier place.
    first, repeats = _merge_equal(blocks, ["h", "b"], F.struct("doc", "th", "pk"))
    of_doc = repeats.groupBy("doc", "th").agg(F.collect_list(F.struct("pk", "first.doc", "first.th", F.col("first.pk").alias("pk0"))).alias("l"))
    runs = step(of_doc.mapInArrow(_join_runs, _RUN), "runs")
    release(blocks)
    source = texts.select(F.col("doc").alias("doc0"), F.col("th").alias("th0"), "text")
    want = F.substring("text", (F.col("start0") + 1).cast("int"), F.col("len").cast("int"))
    found.append(runs.join(source, ["doc0", "th0"]).select("doc", "th", "start", "len", want.alias("want")))
    # Pass 3: different blocks of one anchor, by their bytes.
    open_ = _with_count(first, "h").select(F.col("h").alias("g"), "n", "first.*")
    of_doc = open_.groupBy("doc", "th").agg(F.collect_list(F.struct("g", "n", "pk")).alias("blocks"))
    # Rows that agree in id and text are one document: its bytes are cut once.
    with_text = texts.join(of_doc, ["doc", "th"]).select("doc", "th", "text", "blocks")
    bytes_ = step(with_text.mapInArrow(_cut_blocks, _BLOCK), "bytes")
    release(first)
    solved = [step(_solve_groups(bytes_.where(F.col("n") <= GROUP)), "repeats")]
    large, half = bytes_.where(F.col("n") > GROUP).drop("n"), 64
    while half and not large.isEmpty():
        parts = step(_split(large, half), "parts")
        release(bytes_)
        first, repeats = _merge_equal(parts, ["g", "distance", "bytes"], F.struct("doc", "th", "start"))
        solved.append(step(repeats.select("doc", "th", "start", F.length("bytes").cast("long").alias("len")), "equal"))
        left = step(_with_count(first, "g").select("g", "n", "first.*", "distance", "bytes"), "left")
        solved.append(step(_solve_groups(left.where(F.col("n") <= GROUP)), "repeats"))
        release(parts, first)
        bytes_ = left
        large, half = left.where(F.col("n") > GROUP).drop("n"), half // 2
    release(bytes_)
    return reduce(DataFrame.union, [*found, *(x.withColumn("want", none) for x in solved)])


_OUT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string{}>"


def _apply(with_text: bool):
    kind = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    kind = pa.struct(kind + [("kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for text, cut in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
                text, removed, n, kept, at = text or b"", 0, 0, [], 0
                for x in cut or ():
                    if x["want"] is not None and text[x["start"]:x["start"] + x["len"]] != x["want"]:
                        raise ValueError("different blocks have equal hashes: take another seed")
                for start, end in sorted((x["start"], x["start"] + x["len"]) for x in cut or ()):
                    if start > at or not n:
                        kept.append(text[at:start])
                        n += 1
                        at = start
                    removed += max(0, end - at)
                    at = max(at, end)
                kept.append(text[at:])
                rest = b"".join(kept)
                row = {"n_bytes": len(text), "n_removed": removed, "n_spans": n,
                       "kept_sha256": hashlib.sha256(rest).hexdigest()}
                out.append(row | {"kept": rest} if with_text else row)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, kind)], names=["_row", "_out"])

    return run


def _in_order(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with ``doc``, an integer in the order of the ids: integers as they are,
    others by their place in the sorted ids. A null id gets the last number."""
    kind = dict(docs.dtypes)[id_col]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn("doc", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)))
    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    ranked = step(ids.repartitionByRange("_id").sortWithinPartitions("_id").withColumn("doc", F.monotonically_increasing_id()), "ids")
    return docs.join(ranked, F.col(id_col) == F.col("_id"), "left").withColumn("doc", F.coalesce("doc", F.lit(_LAST_ID))).drop("_id")


def _single(src: DataFrame) -> DataFrame:
    """One row of each document: only rows whose id is that of others are compared."""
    many = step(src.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"), "repeated-ids")
    if many.isEmpty():
        return src
    return src.join(many, "doc", "left_anti").unionByName(src.join(many, "doc", "left_semi").dropDuplicates(["doc", "th"]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False,
                   seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and
    ``kept``, the remaining bytes, if ``with_text``)."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("_t"))
    # Rows of one id are told apart by their text; those without id come after any with one.
    th = F.shiftrightunsigned(text_hash(F.col("_t")), 2) + F.when(F.col("doc_id").isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    src = _in_order(own, "doc_id").select(F.struct("doc_id").alias("_row"), "doc", th.alias("th"), F.col("_t").cast("binary").alias("text"))
    cut = spans(_single(src), seed).groupBy("doc", "th").agg(
        F.collect_list(F.struct("start", "len", "want")).alias("cut"))
    rows = src.join(cut, ["doc", "th"], "left").select("_row", "text", "cut")
    out = _OUT.format(",kept:binary" if with_text else "")
    done = rows.mapInArrow(_apply(with_text), f"_row {src.schema['_row'].dataType.simpleString()}, _out {out}")
    return done.select("_row.*", "_out.*")
