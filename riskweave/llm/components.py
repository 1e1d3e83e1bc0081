"""Connected components of an edge table, by alternating star contraction.

Every round is two group-by-min / join steps; the edge table is written to the
shared checkpoint folder after each, so a lost executor redoes one step only.
Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import step

MAX_ROUNDS = 60  # rounds grow with the logarithm of the longest path; beyond this something is wrong


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of one task as stars: (node, smallest node of its component), node > smallest."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[:len(a)], inv[len(a):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, lab[u], low)
        np.minimum.at(new, lab[v], low)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    far = lab != np.arange(len(nodes))
    return nodes[far], nodes[lab[far]]


def _lowest(e: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node's smaller neighbours. Written, so that the joins
    with it are between plain shuffles and adaptive execution splits a frequent node."""
    return step(e.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def _large_star(e: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour (or on the
    node itself, if all its neighbours are larger). Edges have u > v."""
    low = _lowest(e).select(F.col("u").alias("v"), "m")
    return e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    low = _lowest(e)
    moved = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and is not its own root.

    ``edges``: two columns of one integer type, any direction, repeats and
    self-edges allowed; null ends are ignored. ``root`` is the smallest node of
    the component. An empty edge table gives an empty result.
    """
    a, b = edges.columns
    e = (edges.where(F.col(a) != F.col(b))
              .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = step(e, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        e = step(_small_star(step(_large_star(e).distinct(), "large")).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                    F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
