"""Connected components of an edge table, and helpers for clustering in blocks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; component: its smallest node.

    Alternates large-star and small-star steps until the edges no longer
    change: every round is joins and aggregates over the edges, and is written
    to the shared folder. Rounds grow with the logarithm of a component's size;
    it is an error if ``rounds`` do not suffice.
    Loops, repeated edges and edges with a null end change nothing.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u") != F.col("v"))
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    now = state(e)
    for _ in range(rounds):
        if not now[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        e = materialise(moved.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, state(e)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def forest(n: int, neighbours: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest over 0..n-1; neighbours(i, others): mask of those among ``others`` linked with i."""
    left = np.arange(n)
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = deque([int(left[0])]), left[1:]
        while queue and len(left):
            i = queue.popleft()
            near = neighbours(i, left)
            found = left[near]
            left = left[~near]
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def in_units(members: DataFrame, group: str, key: str, block: int) -> DataFrame:
    """Deal the members of each group to work units of at most about two blocks.

    A group of up to ``block`` members is one unit. A larger one is cut into
    blocks by a checksum of ``key``, and each pair of blocks (and each block
    alone) is a unit, so every pair of members meets in exactly one unit whose
    ``bi`` and ``bj`` are the blocks; ``blk`` tells a member's block.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).select(group, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    dealt = members.join(sizes, group).withColumn("blk", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = dealt.withColumn("_o", other)
    return dealt.withColumn("bi", F.least("blk", "_o")).withColumn("bj", F.greatest("blk", "_o")).drop("_o", "_blocks")
