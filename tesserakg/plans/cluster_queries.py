"""Queries on similarity graphs, clusterings and their quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserakg.functions import vectors as V
from tesserakg.operators import candidates as C
from tesserakg.operators import clustering as L
from tesserakg.operators import metrics as M
from tesserakg.operators import scoring as S
from tesserakg.plans import base as B
from tesserakg.plans.candidate_queries import _R, _SCORED, _ranks, _scored
from tesserakg.runtime import cut, table

SIZE = 300


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """``node, mention, vec`` of the mentions with a usable vector (copies once)."""
    v = F.col("mention_embedding")
    good = table(spark, d, "processed_mention").filter((F.size(v) == SIZE) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    return good.filter("mention_id is not null").dropDuplicates(["mention_id"]).select(F.col("mention_id").alias("node"), "mention", v.alias("vec"), "docno")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mention_pairs").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score")


def _all_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed_mention").filter("mention_id is not null").select(F.col("mention_id").alias("node"), "mention").distinct()


def document_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.document_pairs(B.mentions(spark, d))


def strongest_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.strongest(_pairs(spark, d))


def _scored_pairs(spark: SparkSession, d: str, mode: str, prefilter: float | None = None) -> DataFrame:
    pairs = L.strongest(_pairs(spark, d)).select("a", "b")
    return L.pair_scores(pairs, _nodes(spark, d), mode, prefilter).withColumn("score", F.round("score", 6))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored_pairs(spark, d, "cosine")


def distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored_pairs(spark, d, "distance")


def edit_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored_pairs(spark, d, "edit")


def prefiltered_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored_pairs(spark, d, "cosine", 0.75)


def range_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the mentions whose id is divisible by 50, against all."""
    rows = _nodes(spark, d).select(F.col("node").alias("id"), "vec")
    return L.range_neighbours(rows.filter("id % 50 = 0"), rows, 0.6, SIZE).select("id", "other", F.round("cosine", 6).alias("cosine"))


def components(spark: SparkSession, d: str) -> DataFrame:
    return L.components(L.strongest(_pairs(spark, d)).filter("score >= 0.8"))


def threshold_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.threshold_clusters(_all_nodes(spark, d), _pairs(spark, d), 0.9)


def _links(spark: SparkSession, d: str) -> DataFrame:
    """``node, entity, score``: mentions to entities, scored by their share among the pairs of the same surface and text."""
    m = B.mentions(spark, d)
    priors = C.mention_priors(m).select("mention", F.col("qid").alias("entity"), F.col("prior").alias("score"))
    nodes = _all_nodes(spark, d).filter("mention is not null").select("node", F.lower("mention").alias("mention"))
    return nodes.join(priors, "mention").select("node", "entity", "score")


def best_entities(spark: SparkSession, d: str) -> DataFrame:
    return L.best_entities(_links(spark, d), 0.3).select("node", "entity", F.round("score", 6).alias("score"))


def majority_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.majority_clusters(_all_nodes(spark, d), _pairs(spark, d), _links(spark, d), 0.8, 0.3, 0.5)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions and entities in one graph of string ids: mention pairs above 0.8 and links above 0.3."""
    text = lambda c: F.concat(F.lit("m"), F.col(c))
    links = cut(_links(spark, d).filter("score > 0.3").select(text("node").alias("a"), F.col("entity").alias("b"), "score"))
    pairs = L.strongest(_pairs(spark, d)).filter("score > 0.8").select(text("a").alias("a"), text("b").alias("b"), F.least("score", F.lit(0.999999)).alias("score"))
    return _all_nodes(spark, d).select(text("node").alias("node")).distinct(), cut(pairs.unionByName(links)), links.select(F.col("b").alias("entity")).distinct()


def path_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.path_clusters(*_graph(spark, d), 0.5)


def bottom_up_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.bottom_up_clusters(*_graph(spark, d))


def spanning_forest_weight(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the maximum spanning forest of pairs from 0.8 on."""
    return L.spanning_forest(L.strongest(_pairs(spark, d)).filter("score >= 0.8")).agg(F.count("*").alias("n_edges"), F.round(F.sum("score"), 6).alias("weight"))


def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.leader_clusters(B.mentions(spark, d), 0.6, True)


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    gold = _all_nodes(spark, d).filter("mention is not null").select("node", F.lower("mention").alias("gold"))
    return L.best_threshold(_pairs(spark, d), gold)


def top_members(spark: SparkSession, d: str) -> DataFrame:
    """Of every component the five members with the best pair."""
    pairs = L.strongest(_pairs(spark, d)).filter("score >= 0.8")
    own = pairs.select(F.col("a").alias("node"), "score").unionByName(pairs.select(F.col("b").alias("node"), "score")).groupBy("node").agg(F.max("score").alias("score"))
    return L.top_members(L.components(pairs).join(own, "node"), 5).select("root", F.array_join("nodes", ",").alias("nodes"))


def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """Clustering quality for thresholds from 0.75 to 0.95."""
    nodes = cut(_all_nodes(spark, d).filter("mention is not null"))
    grid = L.threshold_grid(nodes.select("node"), _pairs(spark, d), nodes.select("node", F.lower("mention").alias("gold")), [0.75, 0.8, 0.85, 0.9, 0.95])
    return M.cluster_metrics(cut(M.contingency(grid, ["threshold"])), ["threshold"])


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Links of the event mentions; mentions outside the graph are clustered by their surface."""
    links = S.links(_scored(spark, d), (0.0, 0.4))
    low = B.mentions(spark, d).select("docno", "pos", F.lower("mention").alias("cluster"))
    return links.join(low, ["docno", "pos"])


def two_stage_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_decisions(spark, d).select(F.concat_ws(":", "docno", "pos").alias("node"), "link", "pred_ookg", "cluster"))
    return L.two_stage(rows.select("node", "link", "pred_ookg"), rows.select("node", F.col("cluster").alias("root")))


def cluster_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.cluster_metrics(cut(M.contingency(M.populations(_decisions(spark, d)), ["population"])), ["population"])


def contingency(spark: SparkSession, d: str) -> DataFrame:
    return M.contingency(M.populations(_decisions(spark, d)), ["population"])


def ceaf(spark: SparkSession, d: str) -> DataFrame:
    return M.ceaf(cut(M.contingency(M.populations(_decisions(spark, d)).filter("population = 'all'"))), L.components)


def ookg_prf_assignment(spark: SparkSession, d: str) -> DataFrame:
    return M.ookg_prf(cut(_decisions(spark, d)), L.components)


def final_results(spark: SparkSession, d: str) -> DataFrame:
    """One row: in-graph F, outside F and their mean, beside the detection rates and the clusters' quality."""
    rows = cut(_decisions(spark, d))
    ranks = _ranks(spark, d).select("docno", "pos", "n_candidates", F.col("gold_rank").isNotNull().alias("in_candidates"))
    stats = M.linking_stats(rows.join(ranks, ["docno", "pos"])).select("count_all", "f1_in_kg", "in_kg_accuracy", "ookg_accuracy")
    outside = M.ookg_prf(rows, L.components).select(F.col("f1").alias("f1_ookg"))
    clusters = M.cluster_metrics(cut(M.contingency(M.populations(rows), ["population"])), ["population"]).filter("population = 'all'").select("ari", "nmi", "b3_f1")
    return stats.crossJoin(outside).crossJoin(clusters).withColumn("combined_f1", F.round((F.col("f1_in_kg") + F.col("f1_ookg")) / 2, 6))


def decision_records(spark: SparkSession, d: str) -> DataFrame:
    ranks = _ranks(spark, d).select("docno", "pos", "n_candidates", "gold_rank")
    return _decisions(spark, d).join(ranks, ["docno", "pos"]).select("docno", "pos", "gold", "ookg", "link", "pred_ookg", "n_candidates", "gold_rank")


def mean_products(spark: SparkSession, d: str) -> DataFrame:
    """Mean products of the vector sets of documents that follow one another."""
    rows = _nodes(spark, d).filter("docno is not null").select(F.col("docno").alias("id"), "vec")
    pairs = rows.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return S.mean_products(rows, rows, pairs, SIZE)


def comparator_score(spark: SparkSession, d: str) -> DataFrame:
    """Linear score of cosine and distance of the matched pairs."""
    pairs = table(spark, d, "mention_pairs").filter("is_match").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    nodes = cut(_nodes(spark, d))
    cos = L.pair_scores(pairs, nodes, "cosine").withColumnRenamed("score", "cosine")
    far = L.pair_scores(pairs, nodes, "distance").withColumnRenamed("score", "distance")
    return S.comparator(cos.join(far, ["a", "b"]), ["cosine", "distance"], [2.0, 0.5], -0.25).select("a", "b", F.round("score", 6).alias("score"))


def pair_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mention_pairs").select((1 - F.col("score")).alias("distance"), F.col("is_match").alias("same"))
    return S.pair_loss(rows)


def type_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distance of the one- and two-hop counts over three measures of each item."""
    kg = B.kg(spark, d)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("double")
    a, b = F.array(size("one_hop_types"), F.lit(1.0), F.coalesce("num_claims", F.lit(0)).cast("double")), F.array(size("two_hop_types"), F.lit(0.0), F.lit(0.0))
    return kg.filter("id is not null").select("id", F.round(S.type_distance(a, b), 6).alias("distance"))


def softmax_priors(spark: SparkSession, d: str) -> DataFrame:
    """Softmax, first place of the largest, sigmoid of the largest, and clamped weight of a mention's priors."""
    lists = B.dictionary(spark, d).groupBy("mention").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "prior"))), lambda x: x["prior"]).alias("p"))
    top = F.array_max("p")
    return lists.select("mention", F.round(F.array_max(V.softmax(F.col("p"))), 6).alias("top_softmax"), V.argmax(F.col("p")).alias("top_place"), F.round(V.sigmoid(top), 6).alias("top_sigmoid"), F.round(V.path_weight(V.clamped(top)), 6).alias("weight"), F.round(V.path_score(V.path_weight(V.clamped(top))), 6).alias("back"))


QUERIES = {f.__name__: f for f in (document_pairs, strongest_pairs, cosine_pairs, distance_pairs, edit_pairs, prefiltered_pairs, range_neighbours, components, threshold_clusters, best_entities, majority_clusters, path_clusters, bottom_up_clusters, spanning_forest_weight, leader_clusters, best_threshold, top_members, threshold_grid, two_stage_clusters, cluster_metrics, contingency, ceaf, ookg_prf_assignment, final_results, decision_records, mean_products, comparator_score, pair_loss, type_distances, softmax_priors)}

_GOOD = """v as (select mention_id as node, mention, docno, mention_embedding::double[] as vec from (select *, row_number() over (partition by mention_id order by mention_id) as rn from processed_mention
  where mention_id is not null and len(mention_embedding) = 300 and len(list_filter(mention_embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(mention_embedding, lambda x: x <> 0)) > 0) where rn = 1)"""
_STRONG = "sp as (select least(a_id, b_id) as a, greatest(a_id, b_id) as b, max(score) as score from mention_pairs where a_id is not null and b_id is not null and score is not null and a_id <> b_id group by 1, 2)"
_ALL = "nd as (select distinct mention_id as node, mention from processed_mention where mention_id is not null)"


def _comp(where: str) -> str:
    return f"ed as (select a, b from sp where {where} union select b, a from sp where {where}), rc as (select a as id, b as o from ed union select r.id, e.b from rc r join ed e on e.a = r.o), cp as (select id as node, least(id, min(o)) as root from rc group by id)"


_LINKS = "pri as (select lower(mention) as mention, qid as entity, count(*) / sum(count(*)) over (partition by lower(mention)) as score from m where mention is not null and qid is not null group by 1, 2), lk as (select node, entity, score from nd join pri on lower(nd.mention) = pri.mention)"
_BEST = "be as (select node, entity, score from (select *, row_number() over (partition by node order by score desc, entity) as rn from lk where score > 0.3) where rn = 1)"
_DECIDED = _SCORED + """, dc as (select b.docno, b.pos, b.gold, b.ookg, (b.link is null or 0.4 > b.score) as pred_ookg, case when not (b.link is null or 0.4 > b.score) then b.link end as link, lower(m.mention) as cluster from bst b join m using (docno, pos)),
pp as (select gold, case when pred_ookg then 'c:' || cluster else 'e:' || link end as pred, unnest(list_filter(['all', case when not ookg then 'inkg' end, case when ookg then 'ookg' end, case when pred_ookg then 'all_ookg_detected' end,
  case when pred_ookg and ookg then 'all_ookg_detected_only_ookg' end, case when pred_ookg and not ookg then 'all_ookg_detected_only_inkg' end], lambda x: x is not null)) as population from dc),
ct as (select population, gold, pred, count(*) as n from pp where gold is not null and pred is not null group by all)"""

ORACLE = {
    "document_pairs": "with " + B.SQL_MENTIONS + " select a.docno, a.pos as i, a.mention as mention_i, b.pos as j, b.mention as mention_j from m a join m b on a.docno = b.docno and a.pos <= b.pos",
    "strongest_pairs": "with " + _STRONG + " select a, b, score from sp",
    "cosine_pairs": "with " + _STRONG + ", " + _GOOD + " select a, b, round(list_cosine_similarity(x.vec, y.vec), 6) as score from sp join v x on x.node = a join v y on y.node = b",
    "distance_pairs": "with " + _STRONG + ", " + _GOOD + " select a, b, round(-list_distance(x.vec, y.vec), 6) as score from sp join v x on x.node = a join v y on y.node = b",
    "range_neighbours": "with " + _GOOD + ", s as (select x.node as id, y.node as other, list_cosine_similarity(x.vec, y.vec) as c from v x join v y on x.node <> y.node where x.node % 50 = 0) select id, other, round(c, 6) as cosine from s where c > 0.6",
    "components": "with recursive " + _STRONG + ", " + _comp("score >= 0.8") + " select node, root from cp",
    "threshold_clusters": "with recursive " + _STRONG + ", " + _ALL + ", " + _comp("score >= 0.9") + " select distinct nd.node, coalesce(cp.root, nd.node) as root from nd left join cp using (node)",
    "best_entities": "with " + B.SQL_MENTIONS + ", " + _ALL + ", " + _LINKS + ", " + _BEST + " select node, entity, round(score, 6) as score from be",
    "majority_clusters": "with recursive " + B.SQL_MENTIONS + ", " + _ALL + ", " + _STRONG + ", " + _comp("score > 0.8") + ", " + _LINKS + ", " + _BEST + """, mb as (select n.node, coalesce(cp.root, n.node) as root from (select distinct node from nd) n left join cp on cp.node = n.node),
cn as (select root, entity, count(*) as n, sum(count(*)) over (partition by root) as total from mb left join be using (node) group by root, entity), mj as (select root, entity from (select *, row_number() over (partition by root order by n desc, entity) as rn from cn where entity is not null) where rn = 1 and n >= 0.5 * total)
select mb.node, mb.root, mj.entity from mb left join mj using (root)
""",
    "best_threshold": "with " + _STRONG + ", " + _ALL + """, g as (select node, lower(mention) as gold from nd where mention is not null), p as (select sp.score, x.gold as ga, y.gold as gb from sp join g x on x.node = sp.a join g y on y.node = sp.b),
r as (select ga as gold, score, ga = gb as same from p union all select gb, score, false from p where ga <> gb), q as (select gold, min(score) filter (same) as lo, max(score) filter (not same) as hi from r group by gold)
select round(avg((lo + hi) / 2), 6) as threshold, count(*) as n from q where lo is not null and hi is not null
""",
    "top_members": "with recursive " + _STRONG + ", " + _comp("score >= 0.8") + """, ow as (select node, max(score) as score from (select a as node, score from sp where score >= 0.8 union all select b, score from sp where score >= 0.8) group by node),
pl as (select cp.root, ow.node, row_number() over (partition by cp.root order by ow.score desc, ow.node) as place from cp join ow using (node)) select root, string_agg(node::varchar, ',' order by place) as nodes from pl where place <= 5 group by root
""",
    "two_stage_clusters": _DECIDED + " select docno || ':' || pos as node, link, case when pred_ookg then cluster end as cluster from dc",
    "contingency": _DECIDED + " select population, gold, pred, n from ct",
    "cluster_metrics": _DECIDED + """, a as (select population, gold, sum(n)::double as a, count(*) as k from ct group by all), b as (select population, pred, sum(n)::double as b, count(*) as k from ct group by all), t as (select population, sum(n)::double as nn_ from ct group by all),
ga as (select a.population, sum(a * a) as aa, -sum(a / nn_ * ln(a / nn_)) as hg, sum(a - k) as mr, sum(a - 1) as mrd, count(*) as n_gold from a join t using (population) group by all), gb as (select b.population, sum(b * b) as bb, -sum(b / nn_ * ln(b / nn_)) as hp, sum(b - k) as mp, sum(b - 1) as mpd, count(*) as n_pred from b join t using (population) group by all),
ce as (select ct.population, any_value(nn_) as big, sum(n * n)::double as nn, sum(n / nn_ * ln(nn_ * n / (a.a * b.b))) as mi, sum(n * n / b.b) as p3, sum(n * n / a.a) as r3 from ct join a using (population, gold) join b using (population, pred) join t using (population) group by ct.population),
s as (select *, nn - big as tp, bb - nn as fp, aa - nn as fn, big * big - (bb - nn) - (aa - nn) - nn as tn from ce join ga using (population) join gb using (population)),
x as (select *, case when fn = 0 and fp = 0 then 1.0 else 2 * (tp * tn - fn * fp) / nullif((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), 0) end as ari, case when n_gold = 1 and n_pred = 1 then 1.0 else mi / nullif((hg + hp) / 2, 0) end as nmi,
  p3 / big as bp, r3 / big as br, coalesce(mp / nullif(mpd, 0), 0.0) as mup, coalesce(mr / nullif(mrd, 0), 0.0) as mur from s)
select population, big::bigint as n_rows, n_gold, n_pred, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(ari, 6) as ari, round(nmi, 6) as nmi, round(case when ari + nmi > 0 then 2 * ari * nmi / (ari + nmi) else 0.0 end, 6) as ari_nmi_f1,
  round(bp, 6) as b3_precision, round(br, 6) as b3_recall, round(2 * bp * br / (bp + br), 6) as b3_f1, round(mup, 6) as muc_precision, round(mur, 6) as muc_recall, round(coalesce(2 * mup * mur / nullif(mup + mur, 0), 0.0), 6) as muc_f1 from x
""",
    "decision_records": _DECIDED + _R[_R.index(", lst as"):] + " select d.docno, d.pos, d.gold, d.ookg, d.link, d.pred_ookg, r.n_candidates, r.gold_rank from dc d join rks r using (docno, pos)",
    "comparator_score": "with pr as (select distinct a_id as a, b_id as b from mention_pairs where is_match and a_id is not null and b_id is not null), " + _GOOD + " select a, b, round(2.0 * list_cosine_similarity(x.vec, y.vec) + 0.5 * -list_distance(x.vec, y.vec) - 0.25, 6) as score from pr join v x on x.node = a join v y on y.node = b",
    "pair_loss": "select count(*) as n, round(avg(case when is_match then pow(1 - score, 2) else pow(greatest(1.0 - (1 - score), 0), 2) end), 6) as loss from mention_pairs where score is not null and is_match is not null",
    "type_distances": "with " + B.SQL_KG + " select id, round(sqrt(pow(coalesce(cardinality(one_hop_types), 0)::double - coalesce(cardinality(two_hop_types), 0), 2) + 1 + pow(coalesce(num_claims, 0), 2)), 6) as distance from kg where id is not null",
    "softmax_priors": "with " + B.SQL_DICTIONARY + """, x as (select mention, max(prior) as t, list(prior order by rank) as p from dict group by mention), e as (select mention, t, p, (select sum(exp(q - t)) from (select unnest(p) as q)) as z from x)
select mention, round(1 / z, 6) as top_softmax, (list_position(p, t) - 1)::bigint as top_place, round(1 / (1 + exp(-t)), 6) as top_sigmoid, round(-log2(least(greatest(t, 1e-6), 1.0)), 6) as weight, round(least(greatest(t, 1e-6), 1.0), 6) as back from e
""",
}
