"""Consolidating pairwise matches into groups.

Union-find runs inside edge partitions and keeps only a spanning forest of each (an edge from every node to the least
node of its tree), so a partition never returns more edges than it has nodes. Forests are merged hierarchically: FAN_IN
partitions become one, again reduced to a forest, as long as a merged partition stays below BOUND edges. Where the
forests no longer fit into one bounded partition, the graph is contracted: nodes that a hash makes tails point to the
least neighbour that it makes a head, and only heads (and tails without one) stay, a quarter less in the mean, until
the rest fits; the pointers are then followed back. No step holds more than BOUND edges in a task.

Defined cases: null ids, null or false decisions and self pairs link nothing; either order and repeated pairs are one
link; a mention without a link has no group; empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakg.runtime import cut, drop, map_arrow, skew_join

#: Edges that one task may hold: 16 bytes each, some five times that while they are worked on.
BOUND = 4_000_000
FAN_IN = 8

_EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the edges: every node that isn't the least of its tree, with the least one.

    Union-find over arrays: the greater root of every edge is hooked to the lesser one, then all paths are compressed,
    until each edge lies in one tree.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        ru, rv = root[u], root[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _forests(bound: int):
    """The forest of a partition; whenever more than ``bound`` edges have gathered, they are reduced before more are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held > bound:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                if len(x) > bound // 2:  # hardly smaller: hand it on, so that memory stays bounded
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                    x, y = x[:0], y[:0]
                a, b, held = [x], [y], len(x)
        if held:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def links(pairs: DataFrame) -> DataFrame:
    """``a, b`` (a < b) of the positive decisions."""
    good = pairs.filter(F.col("is_match") & F.col("a_id").isNotNull() & F.col("b_id").isNotNull() & (F.col("a_id") != F.col("b_id")))
    return good.select(F.least("a_id", "b_id").cast("long").alias("a"), F.greatest("a_id", "b_id").cast("long").alias("b"))


def _merged(local: DataFrame, parts: int, fan_in: int, bound: int) -> DataFrame:
    """Forests of ``fan_in`` neighbouring partitions in one, as a forest again; every group has a partition of its own."""
    grouped = local.withColumn("p", F.floor(F.spark_partition_id() / fan_in).cast("int")).repartitionById(parts, "p").select("a", "b")
    return map_arrow(grouped, _forests(bound), _EDGES)


def _contract(local: DataFrame, turn: int, bound: int) -> tuple[DataFrame, DataFrame]:
    """Pointers ``node, up`` of the nodes that leave the graph, and the forest edges of what is left.

    By a hash every node is a head or a tail this turn; a tail points to its least head, and its edges move there.
    """
    head = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 1
    both = local.select("a", "b").unionByName(local.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = cut(both.filter(~head("a") & head("b")).groupBy("a").agg(F.min("b").alias("b")).toDF("node", "up"))
    moved, made = local, []
    for c in ("a", "b"):
        moved = cut(skew_join(moved, up.withColumnsRenamed({"node": c, "up": "up_"}), c, "left").withColumn(c, F.coalesce("up_", c)).drop("up_"))
        made.append(moved)
    kept = moved.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = cut(map_arrow(kept, _forests(bound), _EDGES))
    drop(*made)
    return up, out


def components(edges: DataFrame, bound: int = BOUND, fan_in: int = FAN_IN) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b``; root is the least node of its component."""
    local, pointers = cut(map_arrow(edges.select("a", "b"), _forests(bound), _EDGES)), []
    n, parts = local.count(), max(1, local.rdd.getNumPartitions())
    while n > bound:
        before, old = n, local
        if parts > 1 and n <= bound * -(-parts // fan_in):
            local = cut(_merged(local, -(-parts // fan_in), fan_in, bound))
            drop(old)
            n, parts, old = local.count(), max(1, local.rdd.getNumPartitions()), local
        if n > bound and n > 0.7 * before:
            up, local = _contract(local, len(pointers), bound)
            drop(old)
            pointers.append(up)
            n, parts = local.count(), max(1, local.rdd.getNumPartitions())
    while True:  # at least once, since a partition may have handed on several partial forests
        parts = -(-parts // fan_in)
        local = _merged(local, parts, fan_in, bound)
        if parts == 1:
            break
    last = cut(local).toDF("node", "root")
    top = last.unionByName(last.select(F.col("root").alias("node"), "root").distinct())
    for up in reversed(pointers):
        below = skew_join(up, top.toDF("up", "root"), "up", "left").select("node", F.coalesce("root", "up").alias("root"))
        ends = up.select(F.col("up").alias("node")).distinct().join(top, "node", "left_anti").withColumn("root", F.col("node"))
        top = cut(top.unionByName(below).unionByName(ends))
    if pointers:  # roots are then any nodes of their components
        least = cut(top.groupBy("root").agg(F.min("node").alias("least")))
        top = skew_join(top, least, "root").select("node", F.col("least").alias("root"))
    return top


def match_groups(pairs: DataFrame) -> DataFrame:
    """``mention_id, group_id`` of every mention with a link."""
    return components(links(pairs)).select(F.col("node").alias("mention_id"), F.col("root").alias("group_id"))
