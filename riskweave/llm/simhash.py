"""Operator 5, SimHash near-dedup by pigeonring filtering.

Fingerprints: 64-bit SimHash over word shingles (XXH64, seed 42). Two distinct
fingerprints within ``MAX_BITS`` differing bits are linked; components of links
are the near-duplicate classes.

Candidates: the 64 bits are a ring of five segments. If at most 4 bits differ,
some start i of the ring has a chain whose cumulative differences stay within
the proportional budget: segment i differs in 0 bits, i..i+1 in at most 1,
i..i+2 in at most 2, i..i+3 in at most 3. So segment i agrees whole and one half
of segment i+1 agrees whole: those bits are the ten join keys of a fingerprint. Of
the four halves of segments i+1 and i+2 two agree whole: beyond ``WIDE`` distinct
fingerprints these make 30 keys of 26 bits, so that pairs that only share a bucket
stay few. Inside a key's bucket the longer chains prune before the full Hamming check.

Exact copies are merged before anything is paired (one row per distinct
fingerprint), buckets larger than ``BLOCK`` are compared block by block in
separate tasks, and a task returns stars (at most one edge per member), never
all pairs.

Edge cases: null and wordless texts have fingerprint zero and link like any
other; fewer words than a shingle hash as one sequence; repeated rows share a
class; an empty table gives an empty result; a null doc_id is kept and never is
a component_id unless all ids of its class are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, map_texts, prepare, step, text_hash, texts_of
from .components import connected_components, local_stars

SHINGLE = 4   # words
MAX_BITS = 4  # differing bits that still link
SEED = 42
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit, bits)
WIDE = 1 << 22  # distinct fingerprints beyond which keys are wide
BLOCK = 2048  # members of a bucket compared in one task; larger buckets are split
_CHUNK = 200_000  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text: bit j is 1 if set in over half of the shingle hashes."""
    w = text.translate(LOWER_ASCII).split()
    if not w:
        return 0
    if len(w) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    else:
        joined = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
        h = np.fromiter(map(xxhash.xxh64_intdigest,
                            map(joined.__getitem__, map(slice, starts, ends[shingle - 1:].tolist())),
                            repeat(SEED)), np.uint64, len(starts))
    count = np.zeros(64, np.int64)
    for a in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[a:a + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns in ``_row`` and the fingerprint as a signed long in ``_out.fp``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for rb in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(rb)], np.uint64).view(np.int64)
            yield rb, pa.StructArray.from_arrays([pa.array(fp, pa.int64())], names=["fp"])

    return map_texts(docs, run, "struct<fp:bigint>", keep, text)


def _bits(fp: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND((1 << n) - 1)


def _keys(fp: Column, wide: bool) -> Column:
    """Join keys. Narrow: ring start and half, whole segment i, one half of segment i+1 (ten
    keys of about 19 bits). Wide: ring start and pair, whole segment i, two of the four
    halves of segments i+1 and i+2 (30 keys of about 26 bits)."""
    keys = []
    for i, (first, n) in enumerate(SEGMENTS):
        halves = []
        for f, m in (SEGMENTS[(i + 1) % 5], SEGMENTS[(i + 2) % 5])[:1 + wide]:
            halves += [(f, m // 2), (f + m // 2, m - m // 2)]
        for k, some in enumerate(combinations(halves, 1 + wide)):
            key = F.lit((8 * i + k) << 40).bitwiseOR(F.shiftleft(_bits(fp, first, n), 20))
            for j, (f, m) in enumerate(some):
                key = key.bitwiseOR(F.shiftleft(_bits(fp, f, m), 10 * j))
            keys.append(key)
    return F.array(*keys)


def _masks() -> np.ndarray:
    """masks[i, l]: bits of the l + 2 segments of the chain that starts at i (l = 0, 1, 2)."""
    seg = [((1 << n) - 1) << first for first, n in SEGMENTS]
    out = np.zeros((5, 3), np.uint64)
    for i in range(5):
        for length in range(3):
            out[i, length] = sum(seg[(i + j) % 5] for j in range(length + 2))
    return out


def _link(group: np.ndarray, start: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links inside each run of equal ``group`` (rows sorted by group)."""
    n, masks = len(fp), _masks()
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    left = np.repeat(first + size, size) - np.arange(n)  # rows of the group from this one on
    a, b, held = [], [], 0
    at = np.arange(n)
    for d in range(1, int(size.max(initial=0))):
        at = at[left[at] > d]
        x = fp[at] ^ fp[at + d]
        ok = at
        for length in range(3):  # chains of 2, 3, 4 segments within budgets 1, 2, 3
            good = np.bitwise_count(x & masks[start[ok], length]) <= length + 1
            ok, x = ok[good], x[good]
        ok = ok[np.bitwise_count(x) <= max_bits]
        a.append(fp[ok + d])
        b.append(fp[ok])
        held += len(ok)
        if held > 500_000:
            a, b = ([v] for v in local_stars(np.concatenate(a), np.concatenate(b)))
            held = len(a[0])
    return local_stars(np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]]))


def _link_batches(max_bits: int):
    """mapInArrow function over rows sorted by (key, lo, hi): a group may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                change = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
                u, v = _link(np.r_[0, np.cumsum(change)], rows[:, 0] >> 43,
                             np.ascontiguousarray(rows[:, 3]).view(np.uint64), max_bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
                                                     names=["u", "v"])

        for rb in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in rb.columns], axis=1)
            if held:
                rows = np.concatenate([*held, rows])
            if not len(rows):
                continue
            last = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            cut = len(rows) - int(last[::-1].argmin()) if not last.all() else 0
            yield from flush(rows[:cut])
            held = [rows[cut:]]
        if held:
            yield from flush(held[0])

    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, wide: bool = False) -> DataFrame:
    """(u, v): stars whose components are those of all pairs of distinct
    fingerprints (column ``fp``) within ``max_bits`` <= 4 differing bits. ``wide``
    keys bring fewer pairs together, for three times the rows; the links are the same."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the five-segment ring is exact up to {MAX_BITS} bits")
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"), wide)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    both = (keyed.join(counts, "key").withColumn("parts", parts).withColumn("mine", mine)
                 .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
                 .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp"))
    return (both.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
                .mapInArrow(_link_batches(max_bits), "u bigint, v bigint"))


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, rep): the class of every distinct fingerprint.

    ``prints`` has doc_id, th and fp, one row per document. component_id is the
    smallest doc_id of the class; rep the (doc_id, th) of the row that stays.
    """
    rep = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    nodes = step(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(rep).alias("rep")), "prints")
    wide = nodes.count() > WIDE  # from the footers of the written table
    roots = connected_components(links(nodes, max_bits, wide=wide)).withColumnRenamed("node", "fp")
    of = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = step(of, "roots")
    low = of.groupBy("root").agg(F.min("low").alias("component_id"), F.min("rep").alias("rep"))
    return of.select("fp", "root").join(low, "root").select("fp", "component_id", "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(F.col(f"`{text}`")).alias("th"),
                      F.col(f"`{text}`").alias("text"))
    prints = step(fingerprints(src, ["doc_id", "th"], shingle=shingle).select("_row.*", "_out.fp"), "simhash")
    out = prints.join(classes(prints, max_bits).drop("rep"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
           shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest doc_id."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(F.col(f"`{text}`")).alias("th"),
                      F.col(f"`{text}`").alias("text"))
    prints = step(fingerprints(src, ["doc_id", "th"], shingle=shingle).select("_row.*", "_out.fp"), "simhash")
    reps = step(classes(prints, max_bits).groupBy("component_id", "rep").agg(F.count(F.lit(1)).alias("n"))
                .select(F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th")), "reps")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(f"`{id_col}`").alias("_id"), text_hash(F.col(f"`{text}`")).alias("_th"))
    same = keyed["_id"].eqNullSafe(reps["_id"]) & (keyed["_th"] == reps["_th"])
    kept = keyed.join(reps, same, "left_semi")
    # Rows that agree in id and text are one document: one of them stays.
    return kept.dropDuplicates(["_id", "_th"]).select("_row.*")
