"""Parent-child links to full hierarchies: paths, depths, roots, descendants and cycles.

Nodes whose hash falls into one class in SPLIT are splitters. Every inner node walks to its next splitter or root
(segments of bounded length, by doubling), the reduced pointer graph of splitters is solved the same way, and exact
paths are put together from both. Leaves, usually most of the nodes, only join their parent once.

Defined cases: null and empty ids are no nodes; a node without a parent is a root of depth 0; a node that is its own
parent is a cycle; of several parents the smallest id leads the path; copies of a link count once; empty tables give
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakg.runtime import cut, drop, skew_join

SPLIT = 8


def class_edges(records: DataFrame) -> DataFrame:
    """``child, parent`` by the P279 statements of each id's current record (highest lastrevid; then smallest line_no)."""
    statements = F.flatten(F.transform(F.filter(F.map_entries("claims"), lambda e: (e["key"] == "P279") & e["value"].isNotNull()), lambda e: e["value"]))
    wanted = F.filter(statements, lambda s: (s["mainsnak"]["snaktype"] == "value") & (s["mainsnak"]["datavalue"]["value"]["id"] != ""))
    parents = F.coalesce(F.transform(wanted, lambda s: s["mainsnak"]["datavalue"]["value"]["id"]), F.array().cast("array<string>"))
    current = records.filter(F.col("id") != "").groupBy("id").agg(F.max(F.struct(F.coalesce("lastrevid", F.lit(-1)).alias("rev"), (-F.coalesce("line_no", F.lit(0))).alias("line"), parents.alias("parents"))).alias("r"))
    return current.select(F.col("id").alias("child"), F.explode("r.parents").alias("parent")).distinct()


def _double(p: DataFrame) -> tuple[DataFrame, int]:
    """Pointers ``node, target, seg, done`` until every walk has ended or nothing moves any more; and how many are open.

    A round in which no walk ends proves that the open ones never will: the distances to an end have no gaps.
    """
    p = cut(p)
    left = p.filter(~F.col("done")).count()
    while left:
        hop = p.select(F.col("node").alias("target"), F.col("target").alias("next"), F.col("seg").alias("more"), F.col("done").alias("ends"))
        moved = skew_join(p.filter(~F.col("done")), hop, "target").select("node", F.col("next").alias("target"), F.concat("seg", "more").alias("seg"), F.col("ends").alias("done"))
        stepped = cut(p.filter("done").unionByName(moved))
        now = stepped.filter(~F.col("done")).count()
        if now == left:
            drop(stepped)
            return p, now
        drop(p)
        p, left = stepped, now
    return p, 0


def _cycles(base: DataFrame, n: int) -> DataFrame:
    """``node, root`` for pointers ``node, target, low`` that all lead into cycles; root is the least id of the cycle."""
    q, covered = cut(base), 1
    while covered < n:
        hop = q.select(F.col("node").alias("target"), F.col("target").alias("next"), F.col("low").alias("low_"))
        before, q = q, cut(skew_join(q, hop, "target").select("node", F.col("next").alias("target"), F.least("low", "low_").alias("low")))
        drop(before)
        covered *= 2
    on = q.select(F.col("target")).distinct().join(q.select(F.col("node").alias("target"), F.col("low").alias("root")), "target")
    return q.select("node", "target").join(on, "target").select("node", "root")


def hierarchy(edges: DataFrame, nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """``id, root_id, node_depth, path`` (path: array from the root; null in or below a cycle) of every node.

    edges: ``child, parent``; nodes: ``id``, further nodes that may have no link.
    """
    edges = cut(edges.filter((F.col("child") != "") & (F.col("parent") != "")))
    link = cut(edges.groupBy("child").agg(F.min("parent").alias("parent")))
    parents = cut(edges.select(F.col("parent").alias("id")).distinct())
    splitter = F.pmod(F.xxhash64("target"), F.lit(split)) == 0
    # inner nodes are parents themselves; with the parent's own parent it is known whether the walk ends there
    inner = link.join(parents, link["child"] == parents["id"], "left_semi")
    above = link.select(F.col("child").alias("target"), F.lit(True).alias("has_parent"))
    first = cut(skew_join(inner.select(F.col("child").alias("node"), F.col("parent").alias("target")), above, "target", "left").select("node", "target", F.array("node").alias("seg"), F.col("has_parent").isNull().alias("at_root"), (splitter | F.col("has_parent").isNull()).alias("done")))
    ends = first.select("target", "at_root").distinct()
    walked, open_ = _double(first.drop("at_root"))
    walked_done = walked.filter("done")
    if open_:
        lost = walked.filter(~F.col("done")).select("node")
        looped = _cycles(first.join(lost, "node", "left_semi").select("node", "target", F.col("node").alias("low")), open_)
    else:
        looped = walked.select("node", F.col("node").alias("root")).limit(0)
    # the reduced graph: a splitter points to the end of its own walk
    is_splitter = F.pmod(F.xxhash64("node"), F.lit(split)) == 0
    reduced = walked_done.filter(is_splitter).join(ends, "target").select("node", "target", "seg", F.col("at_root").alias("done"))
    if open_:  # a splitter below a splitterless cycle ends a walk as well
        reduced = reduced.join(looped.select(F.col("node").alias("target"), F.lit(True).alias("in_loop")), "target", "left").select("node", "target", "seg", (F.col("done") | F.coalesce("in_loop", F.lit(False))).alias("done"))
    reduced = cut(reduced)
    solved, open_ = _double(reduced)
    if open_:
        lost = solved.filter(~F.col("done")).select("node")
        base = reduced.join(lost, "node", "left_semi").select("node", "target", F.array_min("seg").alias("low"))
        rings = _cycles(base, open_)
    else:
        rings = solved.select("node", F.col("node").alias("root")).limit(0)
    roots = parents.join(link, parents["id"] == link["child"], "left_anti")
    no_path = F.lit(None).cast("array<string>")
    hung_on = solved.filter("done").join(looped.select(F.col("node").alias("target"), F.col("root").alias("loop_root")), "target", "left")
    stops = (
        roots.select(F.col("id").alias("target"), F.col("id").alias("root_id"), F.array("id").alias("above_path"))
        .unionByName(hung_on.select(F.col("node").alias("target"), F.coalesce("loop_root", "target").alias("root_id"), F.when(F.col("loop_root").isNull(), F.concat(F.array("target"), F.reverse("seg"))).alias("above_path")))
        .unionByName(looped.select(F.col("node").alias("target"), F.col("root").alias("root_id"), no_path.alias("above_path")))
        .unionByName(rings.select(F.col("node").alias("target"), F.col("root").alias("root_id"), no_path.alias("above_path")))
    )
    placed = skew_join(walked_done, cut(stops), "target").select(F.col("node").alias("id"), "root_id", F.when(F.col("above_path").isNotNull(), F.concat("above_path", F.reverse("seg"))).alias("path"))
    inner_all = cut(
        placed.unionByName(looped.select(F.col("node").alias("id"), F.col("root").alias("root_id"), no_path.alias("path")))
        .unionByName(roots.select("id", F.col("id").alias("root_id"), F.array("id").alias("path")))
    )
    leaves = link.join(parents, link["child"] == parents["id"], "left_anti").withColumnRenamed("parent", "key_")
    hung = skew_join(leaves, inner_all.withColumnRenamed("id", "key_"), "key_").select(F.col("child").alias("id"), "root_id", F.when(F.col("path").isNotNull(), F.concat("path", F.array("child"))).alias("path"))
    linked = inner_all.unionByName(hung)
    alone = nodes.filter(F.col("id") != "").select("id").distinct().join(linked, "id", "left_anti").select("id", F.col("id").alias("root_id"), F.array("id").alias("path"))
    return linked.unionByName(alone).select("id", "root_id", F.coalesce(F.size("path") - 1, F.lit(-1)).cast("int").alias("node_depth"), "path")


def descendants(paths: DataFrame) -> DataFrame:
    """``id, descendant_id, distance`` for every node and each node below it, from the paths; none in or below cycles."""
    up = F.explode(F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda a, i: F.struct(a.alias("id"), (F.size("path") - 1 - i).cast("int").alias("distance"))))
    return paths.filter(F.col("path").isNotNull()).select(F.col("id").alias("descendant_id"), up.alias("a")).select("a.id", "descendant_id", "a.distance")


def all_descendants(edges: DataFrame) -> DataFrame:
    """``id, descendant_id, distance`` over all links, those of further parents included, with the least number of links.

    Steps up are doubled until nothing is shorter any more; every member of a cycle is an ancestor of all other members and of
    all nodes below the cycle, once each; no node is its own descendant.
    """
    pairs = cut(edges.filter((F.col("child") != "") & (F.col("parent") != "")).select(F.col("parent").alias("id"), F.col("child").alias("descendant_id"), F.lit(1).alias("distance")).distinct())
    mark = None
    while True:
        upper = pairs.select(F.col("descendant_id").alias("mid"), "id", F.col("distance").alias("d1"))
        lower = pairs.select(F.col("id").alias("mid"), "descendant_id", F.col("distance").alias("d2"))
        further = upper.join(lower, "mid").select("id", "descendant_id", (F.col("d1") + F.col("d2")).alias("distance"))
        grown = cut(pairs.unionByName(further).groupBy("id", "descendant_id").agg(F.min("distance").alias("distance")))
        now = tuple(grown.agg(F.count("*"), F.sum(F.col("distance").cast("long"))).first())
        drop(pairs)
        pairs = grown
        if now == mark:
            return pairs.filter("id != descendant_id")
        mark = now
