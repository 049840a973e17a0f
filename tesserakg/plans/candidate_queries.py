"""Queries on mention dictionaries, candidates and links, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserakg.operators import candidates as C
from tesserakg.operators import decisive as E
from tesserakg.operators import kg as K
from tesserakg.operators import metrics as M
from tesserakg.operators import scoring as S
from tesserakg.plans import base as B
from tesserakg.runtime import cut

#: Candidates per mention, as in the published settings; weights of the two features of the linear scorer.
TOP, PRIOR_WEIGHT, DEGREE_WEIGHT = 20, 1.0, 0.5


def mention_prior(spark: SparkSession, d: str) -> DataFrame:
    return C.mention_priors(B.mentions(spark, d)).select("mention", "qid", "n", F.round("prior", 6).alias("prior"))


def mention_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return B.dictionary(spark, d)


def mention_id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Number and first of the ids that a mention was seen with."""
    m = B.mentions(spark, d).filter("mention is not null and qid is not null")
    return m.groupBy("mention").agg(F.count_distinct("qid").alias("n_ids"), F.min("qid").alias("first_id"))


def prior_renormalise(spark: SparkSession, d: str) -> DataFrame:
    return C.renormalised(B.dictionary(spark, d)).withColumn("prior", F.round("prior", 6))


def candidate_lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Event mentions looked up among the mentions' own dictionary of priors, in any case."""
    m = B.mentions(spark, d)
    return C.lookup(m.withColumn("mention", F.when(F.col("pos") % 2 == 0, F.upper("mention")).otherwise(F.col("mention"))), C.ranked(C.mention_priors(m)))


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Mentions, and the dictionary of priors from the mentions up to 2010."""
    m = cut(B.mentions(spark, d))
    return m, cut(C.ranked(C.mention_priors(m.filter("day <= date'2010-12-31'"))))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    m, entries = _entries(spark, d)
    return C.mention_candidates(m, entries, TOP)


def candidate_topk(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).withColumn("prior", F.round("prior", 6))


def candidate_gold_insertion(spark: SparkSession, d: str) -> DataFrame:
    m, entries = _entries(spark, d)
    return C.with_gold(C.mention_candidates(m, entries, 2), 2).select("docno", "pos", "gold", "rank", "qid", F.round("prior", 6).alias("prior"))


def candidates_with_entities(spark: SparkSession, d: str) -> DataFrame:
    return C.with_entities(_candidates(spark, d), B.kg(spark, d)).select("docno", "pos", "rank", "qid", "label", "description")


def dictionary_first_writer(spark: SparkSession, d: str) -> DataFrame:
    m, entries = _entries(spark, d)
    return C.merged([entries.select("mention", "rank", "qid"), B.dictionary(spark, d).select("mention", "rank", "qid")])


def candidate_upfill(spark: SparkSession, d: str) -> DataFrame:
    """Priors' candidates filled up to 5 from the dictionary's."""
    m, entries = _entries(spark, d)
    rest = B.mentions(spark, d).filter("mention is not null and qid is not null").select(F.lower("mention").alias("mention"), "qid")
    return C.upfilled(entries, rest, 5)


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    m, entries = _entries(spark, d)
    return C.gold_ranks(m.withColumn("mention", F.lower("mention")), entries)


def gold_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d)


def candidate_quality(spark: SparkSession, d: str) -> DataFrame:
    return C.candidate_quality(_ranks(spark, d))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return C.recall_curve(_ranks(spark, d))


def gold_rank_without_outside(spark: SparkSession, d: str) -> DataFrame:
    """Ranks after all ids that are marked as outside the graph have been taken off the candidates."""
    m, entries = _entries(spark, d)
    return C.gold_ranks(m.withColumn("mention", F.lower("mention")), entries, m.filter("ookg and qid is not null"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d)
    degree = K.popularity(B.kg(spark, d)).select(F.col("id").alias("qid"), "degree")
    return rows.join(degree, "qid", "left").withColumn("score", S.linear(["prior", "degree"], [PRIOR_WEIGHT, DEGREE_WEIGHT], 0.0))


def linear_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("qid is not null").select("docno", "pos", "qid", F.round("score", 6).alias("score"))


def linear_score_argmax(spark: SparkSession, d: str) -> DataFrame:
    return S.links(_scored(spark, d)).withColumn("score", F.round("score", 6))


def ookg_score(spark: SparkSession, d: str) -> DataFrame:
    """Outside the graph where the outside score 0.4 is higher than the best candidate's."""
    return S.links(_scored(spark, d), (0.0, 0.4)).withColumn("score", F.round("score", 6))


def linking_stats(spark: SparkSession, d: str) -> DataFrame:
    ranks = _ranks(spark, d).select("docno", "pos", "n_candidates", F.col("gold_rank").isNotNull().alias("in_candidates"))
    return M.linking_stats(S.links(_scored(spark, d), (0.0, 0.4)).join(ranks, ["docno", "pos"]))


def precision_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = S.links(_scored(spark, d)).filter("link is not null").select(F.round("score", 6).alias("score"), (F.col("link") == F.col("gold")).alias("correct"))
    return M.sweep(rows)


def link_loss(spark: SparkSession, d: str) -> DataFrame:
    return S.link_loss(_scored(spark, d))


def beam_link(spark: SparkSession, d: str) -> DataFrame:
    types = B.kg(spark, d).select(F.col("id").alias("qid"), F.map_keys("one_hop_types").alias("types"))
    return S.beam_links(_scored(spark, d).join(types, "qid", "left"), 3, 5, 0.2)


def beam_without_context(spark: SparkSession, d: str) -> DataFrame:
    return S.beam_links(_scored(spark, d).withColumn("types", F.lit(None).cast("array<string>")), 1, 0, 0.0)


def _gold_types(spark: SparkSession, d: str) -> DataFrame:
    types = B.kg(spark, d).select("id", F.explode(F.map_keys("one_hop_types")).alias("type"))
    return E.decisive_types(_candidates(spark, d).filter(~F.col("ookg")), types)


def decisive_types(spark: SparkSession, d: str) -> DataFrame:
    return _gold_types(spark, d)


def top_decisive_types(spark: SparkSession, d: str) -> DataFrame:
    return E.top_types(_gold_types(spark, d), 71)


def fuzzy_candidates(spark: SparkSession, d: str) -> DataFrame:
    kg = B.kg(spark, d)
    names = kg.select("id", F.col("labels").alias("name")).unionByName(kg.select("id", F.explode("aliases").alias("name"))).filter("name <> ''")
    return C.fuzzy_candidates(B.mentions(spark, d), names, K.popularity(kg))


QUERIES = {f.__name__: f for f in (mention_prior, mention_dictionary, mention_id_sets, prior_renormalise, candidate_lookup_fallback, candidate_topk, candidate_gold_insertion, candidates_with_entities, dictionary_first_writer, candidate_upfill, gold_rank, candidate_quality, recall_at_k, gold_rank_without_outside, linear_score, linear_score_argmax, ookg_score, linking_stats, precision_sweep, link_loss, beam_link, beam_without_context, decisive_types, top_decisive_types, fuzzy_candidates)}

_PRIORS = """pri as (select lower(mention) as mention, qid, count(*) as n, count(*) / sum(count(*)) over (partition by lower(mention)) as prior from m where mention is not null and qid is not null {where} group by 1, 2),
ent as (select mention, (row_number() over (partition by mention order by prior desc, qid) - 1)::int as rank, qid, prior from pri)"""
_ENT = "with " + B.SQL_MENTIONS + ", " + _PRIORS.format(where="and day <= date '2010-12-31'")
_BASE = ", base as (select docno, pos, mention, qid as gold, ookg from m where mention is not null and qid is not null)"
# all keys of these entries are lower-case: an exact hit is a lower-case mention, and the folded level adds none
_TOP = _ENT + _BASE + """, cnd as (select b.docno, b.pos, b.mention, b.gold, b.ookg, e.rank, e.qid, e.prior from base b left join (select * from ent where rank < {k}) e on e.mention = lower(b.mention))"""
_RANK = _ENT + _BASE + """, lst as (select mention, count(*) as n from {ent} group by mention), rks as (select b.docno, b.pos, b.ookg, coalesce(l.n, 0)::int as n_candidates, (case when e.rank is not null then e.place end)::bigint as gold_rank
  from base b left join lst l on l.mention = lower(b.mention) left join {ent} e on e.mention = lower(b.mention) and e.qid = b.gold)"""
_PLACED = "(select *, row_number() over (partition by mention order by rank) as place from ent)"
_R = _RANK.format(ent=_PLACED)
_SCORED = _TOP.format(k=20) + ", " + B.SQL_KG + """, deg as (select id, coalesce(num_claims, 0) / nullif(max(coalesce(num_claims, 0)) over (), 0) as degree from kg where id is not null),
sc as (select c.*, coalesce(c.prior, 0.0) + 0.5 * coalesce(d.degree, 0.0) as score from cnd c left join deg d on d.id = c.qid),
bst as (select docno, pos, gold, ookg, qid as link, case when qid is not null then score end as score from (select *, row_number() over (partition by docno, pos order by (qid is null), score desc, rank) as rn from sc) where rn = 1)"""
_DEC = _TOP.format(k=20) + ", " + B.SQL_KG + """, ty as (select id, unnest(map_keys(one_hop_types)) as type from kg),
own as (select distinct c.docno, c.pos, t.type from cnd c join ty t on t.id = c.gold where not c.ookg), riv as (select distinct c.docno, c.pos, t.type from cnd c join ty t on t.id = c.qid where not c.ookg and c.qid <> c.gold),
dec_ as (select * from own except select * from riv)"""

ORACLE = {
    "mention_prior": "with " + B.SQL_MENTIONS + ", " + _PRIORS.format(where="") + " select mention, qid, n, round(prior, 6) as prior from pri",
    "mention_dictionary": "with " + B.SQL_DICTIONARY + " select mention, rank, qid, prior from dict",
    "mention_id_sets": "with " + B.SQL_MENTIONS + " select mention, count(distinct qid) as n_ids, min(qid) as first_id from m where mention is not null and qid is not null group by mention",
    "prior_renormalise": "with " + B.SQL_DICTIONARY + " select mention, rank, qid, round(case when sum(prior) over (partition by mention) > 1.0 then prior / sum(prior) over (partition by mention) else prior end, 6) as prior from dict",
    "candidate_lookup_fallback": "with " + B.SQL_MENTIONS + ", " + _PRIORS.format(where="") + """, k as (select distinct mention as key from ent),
w as (select distinct case when pos % 2 = 0 then upper(mention) else mention end as mention from m where mention is not null), f as (select lower(key) as low, min(key) as fkey from k group by 1)
select w.mention, case when a.key is not null then w.mention when b.key is not null then lower(w.mention) else f.fkey end as key,
  case when a.key is not null then 'exact' when b.key is not null then 'lower' when f.fkey is not null then 'folded' else 'none' end as level
from w left join k a on a.key = w.mention left join k b on b.key = lower(w.mention) left join f on f.low = lower(w.mention)
""",
    "candidate_topk": _TOP.format(k=20) + " select docno, pos, mention, gold, ookg, rank, qid, round(prior, 6) as prior from cnd",
    "candidate_gold_insertion": _TOP.format(k=2) + """, l as (select docno, pos, gold, ookg, list({'rank': rank, 'qid': qid, 'prior': prior} order by rank) filter (qid is not null) as c from cnd group by all),
l2 as (select docno, pos, gold, ookg, coalesce(c, []) as c from l),
n as (select docno, pos, gold, case when ookg then list_filter(c, lambda x: x.qid <> gold) when list_contains(list_transform(c, lambda x: x.qid), gold) then c
  else list_append(case when len(c) >= 2 then c[1:1] else c end, {'rank': 0, 'qid': gold, 'prior': 0.0}) end as c from l2)
select docno, pos, gold, (i - 1)::int as rank, x.qid as qid, round(x.prior, 6) as prior from (select docno, pos, gold, unnest(c) as x, generate_subscripts(c, 1) as i from n)
""",
    "candidates_with_entities": _TOP.format(k=20) + ", " + B.SQL_KG + " select docno, pos, rank, qid, kg.labels as label, coalesce(kg.descriptions, '') as description from cnd join kg on kg.id = cnd.qid",
    "dictionary_first_writer": _ENT + ", " + B.SQL_DICTIONARY + " select mention, rank, qid from ent union all select mention, rank, qid from dict where mention not in (select mention from ent)",
    "candidate_upfill": _ENT + """, more as (select distinct lower(mention) as mention, qid from m where mention is not null and qid is not null), fresh as (select * from more except select mention, qid from ent),
kn as (select mention, count(*) as n from ent group by mention), pl as (select f.*, row_number() over (partition by f.mention order by md5('7|' || qid), qid) as place, coalesce(k.n, 0) as n from fresh f left join kn k on k.mention = f.mention)
select mention, qid, 'known' as source from ent union all select mention, qid, 'added' from pl where place <= 5 - n
""",
    "gold_rank": _R + " select docno, pos, ookg, n_candidates, gold_rank from rks",
    "gold_rank_without_outside": (_RANK.replace(", lst as", ", kept as (select *, row_number() over (partition by mention order by rank) as place from ent where qid not in (select qid from m where ookg and qid is not null)), lst as")).format(ent="kept") + " select docno, pos, ookg, n_candidates, gold_rank from rks",
    "candidate_quality": _R + """, s as (select count(*) as n, count(*) filter (ookg) as n_ookg, count(*) filter (n_candidates = 0) as n_none, count(*) filter (gold_rank = 1 and not ookg) as correct, avg(gold_rank) as mr, avg(1 / gold_rank) as rr,
  count(*) filter (gold_rank is not null or ookg) as hits from rks), p as (select *, correct / nullif(n - n_none, 0) as p, correct / nullif(n - n_none - n_ookg, 0) as q from s)
select n, n_ookg, n_none, correct, round(mr, 6) as mean_rank, round(rr, 6) as mrr, round(p, 6) as precision, round(q, 6) as recall, round(2 * p * q / nullif(p + q, 0), 6) as f1, round(hits / nullif(n, 0), 6) as candidate_recall from p
""",
    "recall_at_k": _R + """, t as (select count(*) filter (not ookg) as total from rks), ks as (select unnest(range(1, 101)) as k)
select k::int as k, round(count(*) / nullif((select total from t), 0), 6) as recall from ks join rks on rks.gold_rank <= ks.k group by k
""",
    "linear_score": _SCORED + " select docno, pos, qid, round(score, 6) as score from sc where qid is not null",
    "linear_score_argmax": _SCORED + " select docno, pos, gold, ookg, link, link is null as pred_ookg, round(score, 6) as score from bst",
    "ookg_score": _SCORED + " select docno, pos, gold, ookg, case when not (link is null or 0.4 > score) then link end as link, (link is null or 0.4 > score) as pred_ookg, round(score, 6) as score from bst",
    "linking_stats": _SCORED + """, d as (select docno, pos, gold, ookg, (link is null or 0.4 > score) as po, case when not (link is null or 0.4 > score) then link end as link from bst),
lst as (select mention, count(*) as n from ent group by mention), rk as (select b.docno, b.pos, coalesce(l.n, 0) as nc, exists (select 1 from ent e where e.mention = lower(b.mention) and e.qid = b.gold) as ic from base b left join lst l on l.mention = lower(b.mention)),
s as (select count(*) as count_all, count(*) filter (not ookg) as count_in_kg, count(*) filter (ookg) as count_ookg, count(distinct gold) filter (not ookg) as count_unique_in_kg, count(distinct gold) filter (ookg) as count_unique_ookg,
  count(*) filter (ookg and po) as correct_ookg, count(*) filter (ookg and not po) as incorrect_ookg, count(*) filter (not ookg and not po) as correct_non_ookg, count(*) filter (not ookg and po) as incorrect_non_ookg, count(*) filter (not ookg and not po and link = gold) as linked,
  count(*) filter (nc = 0 and not ookg) as no_candidates_in_kg, count(*) filter (nc = 0 and ookg) as no_candidates_ookg, count(*) filter (ic) as in_candidate_set from d join rk using (docno, pos)),
p as (select *, coalesce(linked / nullif(correct_non_ookg + incorrect_ookg, 0), 0.0) as p, coalesce(linked / nullif(count_in_kg, 0), 0.0) as r, coalesce(correct_non_ookg / nullif(count_in_kg, 0), 0.0) as a, coalesce(correct_ookg / nullif(count_ookg, 0), 0.0) as b from s)
select * exclude (p, r, a, b), round(p, 6) as precision_in_kg, round(r, 6) as recall_in_kg, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) as f1_in_kg, round(a, 6) as in_kg_accuracy, round(b, 6) as ookg_accuracy,
  round(coalesce(correct_ookg / nullif(correct_ookg + count_in_kg - correct_non_ookg, 0), 0.0), 6) as ookg_precision, round(coalesce(2 * a * b / nullif(a + b, 0), 0.0), 6) as identification_f1,
  round(coalesce(in_candidate_set / nullif(count_in_kg, 0), 0.0), 6) as gold_recall, round(coalesce(in_candidate_set / nullif(count_all, 0), 0.0), 6) as gold_recall_all from p
""",
    "precision_sweep": _SCORED + """, x as (select round(score, 6) as score, link = gold as correct from bst where link is not null), g as (select score, count(*) as n, count(*) filter (correct) as good from x group by score),
r as (select score, coalesce(sum(n) over w, 0)::bigint as n_kept, coalesce(sum(good) over w, 0)::bigint as good, (select sum(n) from g)::bigint as total, (select sum(good) from g)::bigint as all_good from g window w as (order by score desc rows between unbounded preceding and 1 preceding))
select score, n_kept, round(good / nullif(n_kept, 0), 6) as precision, round((good + (total - n_kept) - (all_good - good)) / total, 6) as accuracy from r
""",
    "link_loss": _SCORED + """, e as (select docno, pos, gold, qid, score / 0.05 as s, max(score / 0.05) over (partition by docno, pos) as top from sc where qid is not null),
per as (select docno, pos, any_value(top) + ln(sum(exp(s - top))) as all_, max(s) filter (qid = gold) as own from e group by docno, pos) select count(*) as n, round(avg(all_ - own), 6) as loss from per where own is not null
""",
    "beam_without_context": _SCORED + " select docno, pos, link from bst",
    "decisive_types": _DEC + " select docno, pos, type from dec_",
    "top_decisive_types": _DEC + " select type, count(*) as n from dec_ group by type order by n desc, type limit 71",
}
