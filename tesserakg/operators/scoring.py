"""Scores of candidates and of mention pairs, links, the decision outside the graph, and evaluation losses.

Embeddings enter as columns. Defined cases: a missing feature counts as 0; a mention without candidates is outside the graph;
ties go to the first candidate of the list; null weights are not allowed; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakg.functions import vectors as V
from tesserakg.runtime import each_group


def pooled(tokens: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """``docno, pos, vec``: mean of the token vectors (``docno, tok, vec``) of each span (``docno, pos, first, last``)."""
    met = spans.join(tokens, "docno").filter(F.col("tok").between(F.col("first"), F.col("last")))
    return met.groupBy("docno", "pos").agg(V.mean_vector("vec", size).alias("vec"))


def linear(features: list[str], weights: list[float], bias: float) -> Column:
    """Weighted sum of features; a single similarity is its own score."""
    if features == ["similarity"]:
        return F.coalesce("similarity", F.lit(0.0))
    total = F.lit(float(bias))
    for name, w in zip(features, weights):
        total = total + F.lit(float(w)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return total


def type_predictions(rows: DataFrame, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """``probs`` for ``vec``: a sigmoid of one linear scorer per type."""
    each = [V.sigmoid(V.dot(F.col("vec"), F.array(*map(F.lit, w))) + F.lit(b)) for w, b in zip(weights, bias)]
    return rows.withColumn("probs", F.array(*each))


def type_distance(mention_types: Column, entity_types: Column) -> Column:
    return V.euclidean(mention_types, entity_types)


def candidate_similarity(kind: Column, cosine: Column, edit: Column, distance: Column) -> Column:
    """Similarity block: edit similarity only of mentions as candidates, type distance only of entities."""
    return F.struct(cosine.alias("similarity"), F.when(kind == "mention", edit).alias("edit"), F.when(kind == "entity", distance).alias("distance"))


def popularity_feature(kind: Column, degree: Column) -> Column:
    return F.when(kind == "entity", F.coalesce(degree, F.lit(0.0))).otherwise(0.0)


def links(scored: DataFrame, ookg_weights: tuple[float, float] | None = None) -> DataFrame:
    """``docno, pos, gold, ookg, link, pred_ookg, score``: the best candidate, or outside the graph.

    Outside are mentions without candidates, and those whose outside score (weight and bias on the best candidate's score) is
    higher than the best score. One aggregation, no sort.
    """
    key = ["docno", "pos", "gold", "ookg"]
    order = F.when(F.col("qid").isNotNull(), F.struct("score", (-F.col("rank")).alias("r")))
    best = scored.groupBy(*key).agg(F.max_by(F.struct("qid", "score"), order).alias("b")).select(*key, F.col("b.qid").alias("link"), F.col("b.score").alias("score"))
    outside = F.col("link").isNull()
    if ookg_weights is not None:
        outside = outside | (F.lit(ookg_weights[0]) * F.col("score") + F.lit(ookg_weights[1]) > F.col("score"))
    return best.withColumn("pred_ookg", outside).withColumn("link", F.when(~F.col("pred_ookg"), F.col("link")))


def type_context(linked: list[set], types: set) -> float:
    """Mean over linked entities of the share of their types that the candidate has; 1 for one without types."""
    return sum(len(a & types) / len(a) if a else 1.0 for a in linked) / len(linked) if linked else 0.0


def beam_links(scored: DataFrame, beams: int = 1, window: int = 5, context_weight: float = 0.0) -> DataFrame:
    """``docno, pos, link``: mentions of a document linked in order, each beam with its last ``window`` entities as context.

    ``docno, pos, rank, qid, score, types``. A beam expands by its best candidates; beams of the least cumulated cost stay, ties
    in the order of arrival; the best one wins. Without context weight this is the best candidate of each mention. Each link
    depends on the ones before it in the document, hence one grouped function per document (its candidates only).
    """

    def run(docno, rows):  # noqa: ANN001, ANN202
        import bisect
        from itertools import groupby

        held: list[tuple[float, list, list]] = [(0.0, [], [])]  # cost, links, types of the last ones
        places = []
        for pos, group in groupby(rows, key=lambda r: r[1]):
            places.append(pos)
            options = [(q, s, frozenset(t or ())) for _, _, _, q, s, t in group if q is not None]
            new: list[tuple[float, list, list]] = []
            costs: list[float] = []
            for cost, chosen, recent in held:
                scored_ = [(s + (context_weight * type_context(recent, t) if context_weight else 0.0), q, t) for q, s, t in options]
                for s, q, t in sorted(scored_, key=lambda x: -x[0])[:beams] or [(0.0, None, None)]:
                    at = bisect.bisect_right(costs, cost - s)
                    if at < beams:
                        costs.insert(at, cost - s)
                        new.insert(at, (cost - s, [*chosen, q], ([*recent, t] if t is not None else recent)[-window:] if window else []))
                        del costs[beams:], new[beams:]
            held = new
        return [(docno, p, q) for p, q in zip(places, held[0][1])]

    rows = scored.select("docno", "pos", "rank", "qid", "score", "types")
    return each_group(rows, "docno", ["pos", "rank"], run, "docno long, pos int, link string")


def context_mixed(rows: DataFrame) -> DataFrame:
    """``mixed`` for ``vec`` and ``context`` (vectors): the context's mean, weighted by a softmax of its products with ``vec``."""
    products = F.transform("context", lambda c: V.dot(F.col("vec"), c))
    weights = V.softmax(products)
    weighted = F.zip_with("context", weights, lambda c, w: F.transform(c, lambda x: x * w))
    zero = F.transform("vec", lambda x: F.lit(0.0))
    mixed = F.aggregate(weighted, zero, lambda s, c: F.zip_with(s, c, lambda x, y: x + y))
    return rows.withColumn("mixed", F.when(F.size("context") > 0, mixed).otherwise(zero))


def mean_products(left: DataFrame, right: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``a, b, mean_dot`` of two vector sets per pair: the product of the sets' means, so no cross product is made."""
    one = left.groupBy(F.col("id").alias("a")).agg(V.mean_vector("vec", size).alias("x"))
    two = right.groupBy(F.col("id").alias("b")).agg(V.mean_vector("vec", size).alias("y"))
    return pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", F.round(V.dot(F.col("x"), F.col("y")), 6).alias("mean_dot"))


def comparator(pairs: DataFrame, features: list[str], weights: list[float], bias: float) -> DataFrame:
    """``score`` of mention pairs from their features; a single cosine is its own score."""
    return pairs.withColumn("score", F.col("cosine") if features == ["cosine"] else linear(features, weights, bias))


def link_loss(scored: DataFrame, temperature: float = 0.05) -> DataFrame:
    """One row ``n, loss``: mean cross entropy of the gold candidate among a mention's candidates."""
    w = Window.partitionBy("docno", "pos")
    top = F.max(F.col("score") / temperature).over(w)
    rows = scored.filter(F.col("qid").isNotNull()).withColumn("top", top)
    per = rows.groupBy("docno", "pos").agg((F.first("top") + F.log(F.sum(F.exp(F.col("score") / temperature - F.col("top"))))).alias("all"), F.max(F.when(F.col("qid") == F.col("gold"), F.col("score") / temperature)).alias("own")).filter("own is not null")
    return per.agg(F.count("*").alias("n"), F.round(F.avg(F.col("all") - F.col("own")), 6).alias("loss"))


def pair_loss(pairs: DataFrame, margin: float = 1.0) -> DataFrame:
    """One row ``n, loss``: contrastive loss of ``distance, same``."""
    each = F.when(F.col("same"), F.pow("distance", F.lit(2))).otherwise(F.pow(F.greatest(F.lit(margin) - F.col("distance"), F.lit(0.0)), F.lit(2)))
    return pairs.filter("distance is not null and same is not null").agg(F.count("*").alias("n"), F.round(F.avg(each), 6).alias("loss"))
