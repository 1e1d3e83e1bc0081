"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import cut_lineage, ensure_checkpoint_dir

# Words of the contracts: maximal runs without ASCII white space. The same class
# is what bytes.split() cuts at.
WHITE = r"[\x20\x09-\x0D]+"
# Rows of one Arrow batch. Spark also bounds a batch by bytes
# (spark.sql.execution.arrow.maxBytesPerBatch), so long texts make smaller batches.
BATCH_ROWS = 2000
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: a shared folder for lineage cuts,
    moderate Arrow batches, shuffle files dropped when the query that wrote
    them ends (a finished step is read from its table, never from its shuffle)."""
    # Functions of this subpackage travel to the executors with their code, so a
    # cluster needs no copy of the library on its workers.
    cloudpickle.register_pickle_by_value(sys.modules["riskweave.llm"])
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def step(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    return cut_lineage(df, f"llm-{name}")


def words(text: Column) -> Column:
    """Array of the words of a text (null text: no words), JVM side."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def held_out(doc_id: Column) -> Column:
    """True if crc32(doc_id as text) mod 5 is 0. A null id counts as the empty
    text, whose remainder is 0, so such rows are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_hash(text: Column) -> Column:
    """64-bit hash that tells apart rows of one doc_id (null text: the hash of no text)."""
    return F.xxhash64(text.isNull(), text)


def map_texts(docs: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, pa.Array]]],
              out_type: str, keep: list[str], text: str = "text") -> DataFrame:
    """Run ``fn`` over the whole texts as UTF-8 bytes, in Arrow batches.

    Returns two struct columns: ``_row`` with the ``keep`` columns untouched and
    ``_out`` (``out_type``) with what ``fn`` yields beside each batch, so
    columns of the input can't clash with new ones.
    """
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                      F.col(f"`{text}`").cast("binary").alias("_text"))
    schema = f"_row {src.schema['_row'].dataType.simpleString()}, _out {out_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, out in fn(batches):
            yield pa.RecordBatch.from_arrays([rb.column(0), out], names=["_row", "_out"])

    return src.mapInArrow(run, schema)


def texts_of(rb: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch as bytes; null is the empty text."""
    return [b"" if t is None else t for t in rb.column(1).to_pylist()]


class Lookup:
    """Places of 64-bit keys in an array of distinct keys, by a hash table in numpy: a
    key lies in its slot or, where that was taken, in the next free one."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = (1 << 64 - int(self.shift)) + 64
        self.key, self.place = np.zeros(size, np.uint64), np.full(size, -1)
        place = self.place.tolist()
        for i, at in enumerate(self._slot(keys.astype(np.uint64)).tolist()):
            while place[at] >= 0:
                at += 1
            place[at] = i
        if place[-1] >= 0:
            raise ValueError("the keys don't fit their table")
        self.place[:] = place
        self.key[self.place >= 0] = keys.astype(np.uint64)[self.place[self.place >= 0]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is none of the keys."""
        keys = keys.astype(np.uint64)
        at = self._slot(keys)
        out = self.place[at]
        open_ = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        out[open_] = -1
        while len(open_):  # slots taken by another key: look at the next one
            at[open_] += 1
            there = self.place[at[open_]]
            hit = (there >= 0) & (self.key[at[open_]] == keys[open_])
            out[open_[hit]] = there[hit]
            open_ = open_[(there >= 0) & ~hit]
        return out


@contextlib.contextmanager
def conf(spark: SparkSession, **pairs: str):
    """Session settings (dots written as __) for the time of one step."""
    old = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in pairs}
    for k, v in pairs.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
