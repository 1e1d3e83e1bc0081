"""Operator 6, sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size (an
offset and a stride drawn from its name). Shards take turns; the one whose turn
it is claims its next preferred slot that is free, until none is free. A
document goes to the shard of the slot that its id hashes to, so shards differ by
at most one slot, and adding or losing a shard moves few documents.

The table has ``SLOTS`` rows whatever the data, which bounds the broadcast;
placement is one hash and one lookup.

Edge cases: a null id is the empty text; equal ids share a shard (ids that are
numbers and their decimal text too); an empty table gives an empty result; columns
of the input named like the new ones, in any case, are replaced, and all others
(``_slot`` or ``_row`` too) are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

SLOTS = 65537   # prime; the broadcast table has so many rows
SHARDS = 256    # at most about a hundredth of SLOTS, for even shards


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the owner of each slot."""
    if not names or len(names) > slots:
        raise ValueError("need 1 to `slots` shards")
    if any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be prime, or a stride would miss some")
    orders = []
    for name in names:
        d = hashlib.md5(name.encode()).digest()
        orders.append([int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1])
    owner, free = [-1] * slots, slots
    while True:
        for shard, order in enumerate(orders):
            at, stride = order
            while owner[at] >= 0:
                at = (at + stride) % slots
            owner[at] = shard
            order[0] = (at + stride) % slots
            free -= 1
            if not free:
                return owner


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of all slots."""
    owner = fill(names, slots)
    return spark.createDataFrame([(s, names[o]) for s, o in enumerate(owner)], "_slot bigint, _shard string").coalesce(1)


def place(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, slot_col: str | None = None) -> DataFrame:
    """``docs`` with the column ``shard`` (shard-00000 ...) and, if named, the slot in ``slot_col``."""
    spark = prepare(docs.sparkSession)
    table = lookup_table(spark, [f"shard-{i:05d}" for i in range(shards)], slots)
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    new = {"shard", *([slot_col.lower()] if slot_col else [])}
    kept = [c for c in docs.columns if c.lower() not in new]
    # The row travels as one struct, so that its columns meet none of these names.
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None)
    keyed = docs.select(row.alias("_row"), F.pmod(F.xxhash64(key), F.lit(slots)).alias("_slot"))
    placed = keyed.join(F.broadcast(table), "_slot")
    return placed.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("_shard").alias("shard"),
                         *([F.col("_slot").alias(slot_col)] if slot_col else []))
