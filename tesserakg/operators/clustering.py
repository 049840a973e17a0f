"""Similarity graphs and their clusterings.

Edges are ``a, b`` (and ``score``); nodes may be strings or numbers of one type. Defined cases: null ends make no edge; either
order and repeated edges are one (the highest score holds); self edges only name a node; thresholds are strict where stated;
ties go to the smaller id; empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserakg.functions import text as T
from tesserakg.runtime import cut, drop, each_group, map_arrow, ship, skew_join

#: Vectors sent to the tasks at a time, and rows compared at a time.
BLOCK, ROWS = 25_000, 400


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of every node's component, by alternating large and small stars.

    Every node's neighbours are linked to its least neighbour, first the larger ones, then the smaller ones, until all edges
    point to roots; rounds grow with the logarithm of the size. A hub's edges are met by a join split by weight.
    """
    good = edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = cut(good.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(skew_join(both, least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(e.filter("u = v")).distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = skew_join(large, small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = cut(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop(e, large)
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        e = now
        if mark == before:
            break
        before = mark
    # (root, root) rows are there for roots that some node points to; others are added
    up = e.filter("u != v").groupBy("u").agg(F.min("v").alias("v"))
    roots = e.select(F.col("v").alias("u")).distinct().join(up.select("u"), "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("root"))
    return up.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def strongest(pairs: DataFrame) -> DataFrame:
    """``a, b, score`` with a < b, once each with the highest score; null scores and self pairs are left out."""
    good = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("score").isNotNull() & (F.col("a") != F.col("b")))
    return good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def with_singles(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """All nodes with their root; nodes without an edge are their own."""
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def threshold_clusters(nodes: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """``node, root``: components of the pairs with a score of at least t."""
    return with_singles(components(strongest(pairs).filter(F.col("score") >= t)), nodes)


def document_pairs(m: DataFrame) -> DataFrame:
    """All pairs i <= j of mentions of one document, the diagonal included; documents are short."""
    left, right = m.select("docno", F.col("pos").alias("i"), F.col("mention").alias("mention_i")), m.select("docno", F.col("pos").alias("j"), F.col("mention").alias("mention_j"))
    return left.join(right, "docno").filter(F.col("i") <= F.col("j"))


def pair_scores(pairs: DataFrame, nodes: DataFrame, mode: str, prefilter: float | None = None) -> DataFrame:
    """``a, b, score`` of the pairs asked for; modes: cosine, distance (negated), edit, partial.

    ``nodes`` has ``node, mention, vec``. With a prefilter, pairs whose edit similarity is below it are dropped before.
    """
    ship(pairs.sparkSession)
    wide = pairs.select("a", "b").distinct()
    values = ["mention"] * (prefilter is not None or mode in ("edit", "partial")) + ["vec"] * (mode in ("cosine", "distance"))
    for side in ("a", "b"):  # hot ids are split by the adaptive skew join
        wide = wide.join(nodes.select(F.col("node").alias(side), *(F.col(v).alias(f"{v}_{side}") for v in values)), side)
    if prefilter is not None:
        wide = wide.filter(T.edit_similarity(F.col("mention_a"), F.col("mention_b")) >= prefilter)
    if mode in ("edit", "partial"):
        f = T.edit_similarity if mode == "edit" else T.partial_similarity
        return wide.select("a", "b", f(F.col("mention_a"), F.col("mention_b")).alias("score")).filter(F.col("score").isNotNull())
    same = F.size("vec_a") == F.size("vec_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(wide.filter(same & (F.size("vec_a") > 0)).select("a", "b", "vec_a", "vec_b"), _vector_scores(mode), f"a {kind}, b {kind}, score double")


def _vector_scores(mode: str):
    """Cosine or negated distance of vector columns; vectors of other lengths or with nulls among them fall out pairwise."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                part = batch.take(pa.array(at))
                x, y = (part.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n) for k in (2, 3))
                if mode == "distance":
                    score = -np.sqrt(((x - y) ** 2).sum(1))
                else:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                ok = np.flatnonzero(np.isfinite(score))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ok)), part.column(1).take(pa.array(ok)), pa.array(score[ok])], ["a", "b", "score"])

    return run


def _unit(batch, size: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    column = batch.column(1)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    return batch.column(0).to_numpy(), v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def range_neighbours(queries: DataFrame, rows: DataFrame, t: float, size: int, block: int = BLOCK) -> DataFrame:
    """``id, other, cosine`` of every query with all rows above the threshold (strictly), exactly; both have ``id, vec``.

    Queries go to the tasks in blocks of bounded size; the rows are scanned once per block and never shuffled. Vectors must
    have ``size`` finite values that are not all zero.
    """
    spark = queries.sparkSession

    def scan(shared):  # noqa: ANN001, ANN202
        def run(batches):  # noqa: ANN001, ANN202
            asked, vectors = shared.value
            for batch in batches:
                ids, own = _unit(batch, size)
                for c in range(0, len(ids), ROWS):
                    near = vectors @ own[c : c + ROWS].T
                    q, r = np.nonzero(near > t)
                    ok = asked[q] != ids[c + r]
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q[ok]]), pa.array(ids[c + r[ok]]), pa.array(near[q[ok], r[ok]])], ["id", "other", "cosine"])

        return run

    blocks = max(1, math.ceil(queries.count() / block))
    parts = []
    for k in range(blocks):
        asked = _unit(queries.select("id", "vec").filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow(), size)
        parts.append(map_arrow(rows.select("id", "vec"), scan(spark.sparkContext.broadcast(asked)), "id long, other long, cosine double"))
    return reduce(DataFrame.unionByName, parts)


def best_entities(links: DataFrame, t: float) -> DataFrame:
    """``node, entity, score``: of every mention the entity of the highest score above t (strictly)."""
    order = Window.partitionBy("node").orderBy(F.desc("score"), "entity")
    return links.filter(F.col("score") > t).withColumn("place", F.row_number().over(order)).filter("place = 1").select("node", "entity", "score")


def majority(members: DataFrame, share: float) -> DataFrame:
    """``root, entity``: the most frequent entity of a cluster if it has at least this share of all members.

    ``root, entity`` (null: none); ties go to the smaller entity. Counted per entity first, so large clusters shrink at once.
    """
    counts = members.groupBy("root", "entity").agg(F.count("*").alias("n"))
    total = counts.groupBy("root").agg(F.sum("n").alias("total"))
    best = counts.filter(F.col("entity").isNotNull()).groupBy("root").agg(F.max(F.col("n")).alias("top")).join(counts, "root").filter("n = top and entity is not null").groupBy("root").agg(F.min("entity").alias("entity"), F.first("top").alias("top"))
    return best.join(total, "root").filter(F.col("top") >= share * F.col("total")).select("root", "entity")


def majority_clusters(nodes: DataFrame, pairs: DataFrame, links: DataFrame, mm: float, me: float, share: float) -> DataFrame:
    """``node, root, entity``: components of mention pairs above mm, linked as a whole to their majority's entity, if any."""
    members = with_singles(components(strongest(pairs).filter(F.col("score") > mm)), nodes)
    own = cut(members.join(best_entities(links, me).select("node", "entity"), "node", "left"))
    return skew_join(own.select("node", "root"), majority(own, share), "root", "left").select("node", "root", "entity")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``a, b, score`` of the maximum spanning forest (ties: smaller a, then b), by contracting best edges per component.

    Each round every component takes its best outgoing edge, and the components they form are contracted; there are at
    most as many rounds as the logarithm of the nodes.
    """
    left = cut(strongest(edges).select("a", "b", "score", F.col("a").alias("x"), F.col("b").alias("y")))
    chosen: list[DataFrame] = []
    while left.limit(1).count():
        ends = left.unionByName(left.select("a", "b", "score", F.col("y").alias("x"), F.col("x").alias("y")))
        top = ends.groupBy("x").agg(F.max("score").alias("score"))
        best = ends.join(top, ["x", "score"]).groupBy("x").agg(F.min(F.struct("a", "b", "score", "y")).alias("e"))
        picked = cut(best.select("e.a", "e.b", "e.score", "x", "e.y").dropDuplicates(["a", "b"]))
        chosen.append(picked.select("a", "b", "score"))
        new = cut(components(picked.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        moved = left
        for c in ("x", "y"):
            moved = skew_join(moved, new.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        # of parallel edges only the best can ever be chosen
        rest = cut(moved.filter("x != y").withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")}).groupBy("x", "y").agg(F.min(F.struct((-F.col("score")).alias("s"), "a", "b")).alias("e")).select("e.a", "e.b", (-F.col("e.s")).alias("score"), "x", "y"))
        drop(left, new)
        left = rest
    return reduce(DataFrame.unionByName, chosen) if chosen else left.select("a", "b", "score")


def bottom_up_clusters(nodes: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``node, root``: edges in the order of their scores join clusters unless both already have an entity.

    That greedy rule is a maximum spanning forest in which all entities (``entity``) are tied together from the start: an edge
    that would join two clusters with entities closes a cycle there. Hence no edge list is ever held in one task.
    """
    one = entities.select("entity").distinct()
    hub = F.lit("￿#").cast("string")  # stands for all entities tied together
    tied = strongest(edges)
    for c in ("a", "b"):
        tied = tied.join(one.select(F.col("entity").alias(c), F.lit(True).alias(f"e_{c}")), c, "left")
    # the tie is a contraction: an edge remembers its own ends beside the contracted ones
    contracted = tied.select(F.col("a").alias("own_a"), F.col("b").alias("own_b"), F.when(F.col("e_a"), hub).otherwise(F.col("a")).alias("a"), F.when(F.col("e_b"), hub).otherwise(F.col("b")).alias("b"), "score").filter("a != b")
    # of one mention's edges to several entities only the best can be chosen
    best = cut(contracted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "own_a", "own_b").groupBy("a", "b").agg(F.min(F.struct((-F.col("score")).alias("s"), "own_a", "own_b")).alias("e")).select("a", "b", (-F.col("e.s")).alias("score"), "e.own_a", "e.own_b"))
    forest = spanning_forest(best.select("a", "b", "score"))
    kept = best.join(forest.select("a", "b"), ["a", "b"]).select(F.col("own_a").alias("a"), F.col("own_b").alias("b"))
    return with_singles(components(kept), nodes)


def path_clusters(nodes: DataFrame, edges: DataFrame, entities: DataFrame, path_t: float) -> DataFrame:
    """``node, root, entity``: mentions go to the entity with the largest product of scores on a path, if above path_t (strictly).

    Scores must lie in (0, 1]. Components with one entity or none stay whole. In others, nodes that no entity reaches form the
    components of what is left. Best products are relaxed edge by edge until nothing improves; ties go to the smaller entity.
    """
    e = cut(strongest(edges))
    comp = cut(with_singles(components(e), nodes.select("node").unionByName(entities.select(F.col("entity").alias("node")))))
    own = comp.join(entities.select(F.col("entity").alias("node")).distinct(), "node", "left_semi").groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("entity"))
    several = cut(comp.join(own.filter("n > 1"), "root").select("node"))
    both = cut(e.select(F.col("a").alias("node"), F.col("b").alias("to"), "score").unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("to"), "score")).join(several, "node", "left_semi"))
    best = cut(entities.select(F.col("entity").alias("node")).distinct().join(several, "node", "left_semi").select("node", F.col("node").alias("entity"), F.lit(1.0).alias("path")))
    mark = None
    while True:
        reached = skew_join(both, best, "node").select(F.col("to").alias("node"), "entity", (F.col("path") * F.col("score")).alias("path")).filter(F.col("path") > path_t)
        # an entity stays with itself
        pick = best.unionByName(reached).groupBy("node").agg(F.min(F.struct((-F.col("path")).alias("p"), "entity")).alias("x"))
        stepped = cut(pick.select("node", "x.entity", (-F.col("x.p")).alias("path")))
        now = tuple(stepped.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "entity", "path"))).first())
        drop(best)
        best = stepped
        if now == mark:
            break
        mark = now
    open_ = several.join(best.select("node"), "node", "left_anti")
    inner = e.join(open_.withColumnRenamed("node", "a"), "a", "left_semi").join(open_.withColumnRenamed("node", "b"), "b", "left_semi")
    loose = with_singles(components(inner), open_).select("node", F.concat(F.lit("left:"), "root").alias("root"), F.lit(None).cast("string").alias("entity"))
    taken = best.select("node", F.concat(F.lit("entity:"), "entity").alias("root"), "entity")
    whole = comp.join(several, "node", "left_anti").join(own.select("root", "entity"), "root", "left").select("node", F.coalesce(F.concat(F.lit("entity:"), "entity"), F.concat(F.lit("left:"), "root")).alias("root"), "entity")
    return whole.unionByName(taken).unionByName(loose).join(nodes.select("node").distinct(), "node", "left_semi")


def two_stage(decisions: DataFrame, clusters: DataFrame) -> DataFrame:
    """``node, link, cluster``: in-graph decisions stay, mentions outside get their cluster."""
    inside = decisions.filter(~F.col("pred_ookg")).select("node", "link", F.lit(None).cast("string").alias("cluster"))
    outside = decisions.filter("pred_ookg").select("node").join(clusters, "node", "left").select("node", F.lit(None).cast("string").alias("link"), F.coalesce(F.col("root"), F.col("node")).cast("string").alias("cluster"))
    return inside.unionByName(outside)


def leader_clusters(m: DataFrame, t: float, contained: bool = False) -> DataFrame:
    """``docno, pos, leader``: mentions of a document in order join the leader of the highest edit similarity above t, else lead.

    Order matters, hence one grouped function per document (its mentions only). With ``contained`` a mention that contains a
    leader, or lies in one, joins it as well. Null mentions lead themselves.
    """
    def run(docno, rows):  # noqa: ANN001, ANN202
        leaders: list[tuple[str, int]] = []
        out = []
        for _, pos, name in rows:
            best, at = t, None
            for other, p in leaders if name is not None else []:
                s = T.ratio(name, other)
                if contained and (name in other or other in name):
                    s = max(s, 1.0)
                if s > best:
                    best, at = s, p
            if at is None and name is not None:
                leaders.append((name, pos))
            out.append((docno, pos, pos if at is None else at))
        return out

    return each_group(m.select("docno", "pos", "mention"), "docno", ["pos"], run, "docno long, pos int, leader int")


def best_threshold(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """One row ``threshold, n``: mean over gold ids of the middle between their least positive and greatest negative score.

    ``a, b, score`` and ``node, gold``; a pair counts for the gold ids of both ends; ids that lack either side are left out.
    """
    wide = strongest(pairs)
    for c in ("a", "b"):
        wide = skew_join(wide, gold.select(F.col("node").alias(c), F.col("gold").alias(f"g_{c}")), c)
    same = F.col("g_a") == F.col("g_b")
    rows = wide.select(F.explode(F.array_distinct(F.array("g_a", "g_b"))).alias("gold"), "score", same.alias("same"))
    per = rows.groupBy("gold").agg(F.min(F.when(F.col("same"), F.col("score"))).alias("lo"), F.max(F.when(~F.col("same"), F.col("score"))).alias("hi")).filter("lo is not null and hi is not null")
    return per.agg(F.round(F.avg((F.col("lo") + F.col("hi")) / 2), 6).alias("threshold"), F.count("*").alias("n"))


def threshold_grid(nodes: DataFrame, pairs: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, node, root`` for a list of thresholds at once: one component search over copies of the graph.

    The metric of every threshold is then one grouped aggregate; ``gold`` is joined as ``gold``.
    """
    e = strongest(pairs)
    tag = lambda c: F.concat_ws("|", F.col("t").cast("string"), F.col(c).cast("string"))
    steps = F.explode(F.array(*map(F.lit, thresholds))).alias("t")
    found = components(e.select("a", "b", "score", steps).filter(F.col("score") >= F.col("t")).select(tag("a").alias("a"), tag("b").alias("b")))
    every = nodes.select("node", steps).select(tag("node").alias("node"), F.col("t").alias("threshold"), F.col("node").alias("id"))
    return every.join(found, "node", "left").select("threshold", F.col("id").alias("node"), F.coalesce("root", "node").alias("root")).join(gold, "node").select("threshold", "node", F.col("root").alias("pred"), "gold")


def top_members(members: DataFrame, n: int) -> DataFrame:
    """``root, nodes``: the n members of the highest score of every cluster (ties: smaller node), best first."""
    order = Window.partitionBy("root").orderBy(F.desc("score"), "node")
    kept = members.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return kept.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("nodes"))
