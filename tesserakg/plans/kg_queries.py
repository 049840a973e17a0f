"""Queries on the knowledge graph and its types, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserakg.operators import kg as K
from tesserakg.operators.hierarchy import class_edges
from tesserakg.plans import base as B
from tesserakg.runtime import cut, table


def kg_reduced(spark: SparkSession, d: str) -> DataFrame:
    r = B.reduced(spark, d)
    return r.select("id", "label", "description", F.array_join("aliases", "|").alias("aliases"), F.size("claims").alias("n_claims"))


def kg_claims(spark: SparkSession, d: str) -> DataFrame:
    return K.claim_rows(B.reduced(spark, d))


def kg_type_filter(spark: SparkSession, d: str) -> DataFrame:
    """Wanted types: all superclasses in the class graph."""
    r = cut(B.reduced(spark, d))
    return K.type_filter(r, K.claim_rows(r).filter(F.col("property") == "P279").select(F.col("object").alias("id")))


def kg_restrict_three_way(spark: SparkSession, d: str) -> DataFrame:
    p = B.parsed(spark, d)
    return K.restrict_three_way(K.pair_rows(p), p.filter(F.col("id").isNotNull()), B.dictionary(spark, d).select(F.col("qid").alias("id")))


def class_nodes(spark: SparkSession, d: str) -> DataFrame:
    return K.class_nodes(K.claim_rows(B.reduced(spark, d)))


def superclass_closure(spark: SparkSession, d: str) -> DataFrame:
    return K.closure(class_edges(table(spark, d, "parse_wikidata_dump")))


def superclass_counts(spark: SparkSession, d: str) -> DataFrame:
    return superclass_closure(spark, d).groupBy("node").agg(F.count("*").alias("n_ancestors"))


def _hops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    claims = cut(K.claim_rows(B.reduced(spark, d)))
    up = K.closure(claims.filter(F.col("property") == "P279").select(F.col("subject").alias("child"), F.col("object").alias("parent")))
    return claims, K.one_hop_types(claims, up)


def one_hop_types(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, d)[1]


def two_hop_types(spark: SparkSession, d: str) -> DataFrame:
    claims, one = _hops(spark, d)
    return K.two_hop_types(claims, cut(one))


def enriched_kg(spark: SparkSession, d: str) -> DataFrame:
    """Records with the sums of their one- and two-hop counts and the number of claims."""
    claims, one = _hops(spark, d)
    one = cut(one)
    a = K.type_maps(one, "one_hop").select("id", F.size("one_hop").alias("n_one"), F.aggregate(F.map_values("one_hop"), F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_one"))
    b = K.type_maps(K.two_hop_types(claims, one), "two_hop").select("id", F.size("two_hop").alias("n_two"), F.aggregate(F.map_values("two_hop"), F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_two"))
    n = claims.groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("num_claims"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return n.join(a, "id", "left").join(b, "id", "left").select("id", "num_claims", *map(zero, ("n_one", "sum_one", "n_two", "sum_two")))


def degree_popularity(spark: SparkSession, d: str) -> DataFrame:
    return K.popularity(B.kg(spark, d)).withColumn("degree", F.round("degree", 6))


def kg_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return K.point_lookup(B.kg(spark, d), B.mentions(spark, d).filter(F.col("qid").isNotNull()).select(F.col("qid").alias("id")))


def type_index_lists(spark: SparkSession, d: str) -> DataFrame:
    """Places of each item's one-hop types in the list of the 174 most frequent types."""
    types = B.kg(spark, d).select("id", F.explode(F.map_keys("one_hop_types")).alias("type")).filter(F.col("id").isNotNull())
    vocabulary = types.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(174).select("type")
    return K.type_indices(types, vocabulary).select("id", F.array_join("idx", ",").alias("idx"))


def merged_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Type counts of all items added up."""
    rows = B.kg(spark, d).select(F.explode("two_hop_types").alias("type", "n"))
    return rows.groupBy("type").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (kg_reduced, kg_claims, kg_type_filter, kg_restrict_three_way, class_nodes, superclass_closure, superclass_counts, one_hop_types, two_hop_types, enriched_kg, degree_popularity, kg_point_lookup, type_index_lists, merged_type_counts)}

_UP = """up as (select distinct subject as node, object as ancestor from claims_ where property = 'P279' union select u.node, c.object from up u join claims_ c on c.subject = u.ancestor and c.property = 'P279')"""
_HOPS = "with recursive " + B.SQL_CLAIMS + ", " + _UP + """,
typed as (select subject, object from claims_ where property in ('P31', 'P106', 'P641', 'P17')),
ext as (select subject, object as type from typed union all select t.subject, u.ancestor from typed t join up u on u.node = t.object and u.ancestor <> u.node),
one as (select subject as id, type, count(*) as n from ext group by all),
two as (select c.subject as id, o.type, sum(o.n)::bigint as n from (select distinct subject, object from claims_) c join one o on o.id = c.object group by all)
"""
_EDGES = """edges as (select distinct id as child, s.mainsnak.datavalue.value.id as parent from (select id, unnest(claims['P279']) as s from cur) where s.mainsnak.snaktype = 'value' and s.mainsnak.datavalue.value.id <> ''),
clo as (select child as node, parent as ancestor from edges union select c.node, e.parent from clo c join edges e on e.child = c.ancestor)"""

ORACLE = {
    "kg_reduced": "with " + B.SQL_CURRENT + """
select id, coalesce(labels['en'].value, list_filter(map_values(labels), lambda x: x.value is not null)[1].value, '') as label, coalesce(descriptions['en'].value, '') as description,
  coalesce(array_to_string(list_filter(list_transform(aliases['en'], lambda a: a.value), lambda a: a is not null), '|'), '') as aliases,
  coalesce(len(list_filter(flatten(list_filter(map_values(claims), lambda x: x is not null)), lambda s: s.mainsnak.snaktype = 'value' and s.mainsnak.datatype = 'wikibase-item' and s.mainsnak.datavalue.value.id <> '' and s.mainsnak.property is not null)), 0)::int as n_claims from cur
""",
    "kg_claims": "with " + B.SQL_CLAIMS + " select subject, property, object from claims_",
    "kg_type_filter": "with " + B.SQL_CLAIMS + """, wanted as (select distinct object from claims_ where property = 'P279'),
typed as (select distinct subject from claims_ where property = 'P31' and object in (select object from wanted))
select id, case when id like 'P%' or id in (select subject from typed) then 'full' else 'labels_only' end as kind from cur where id like 'P%' or id like 'Q%'
""",
    "kg_restrict_three_way": "with " + B.SQL_PD_CLAIMS + ", " + B.SQL_DICTIONARY + """, w as (select distinct qid as id from dict),
near as (select property as id from pc where subject in (select id from w) union select object from pc where subject in (select id from w)
  union select object from pc where subject not in (select id from w) and property in ('P31', 'P106', 'P641', 'P17')
  union select property from pc where subject not in (select id from w) and object in (select id from w) union select subject from pc where subject not in (select id from w) and object in (select id from w)),
kept as (select id, case when id in (select id from w) then 'full' else 'reduced' end as kind from pd where id in (select id from w) or id in (select id from near))
select k.id, k.kind, (select count(*) from pc where pc.subject = k.id and (k.kind = 'full' or pc.property in ('P31', 'P106', 'P641', 'P17'))) as n_claims from kept k
""",
    "class_nodes": "with " + B.SQL_CLAIMS + """ select id, count(distinct parent) as n_parents from (select subject as id, object as parent from claims_ where property = 'P279'
  union all select object, null from claims_ where property in ('P31', 'P279')) group by id""",
    "superclass_closure": "with recursive " + B.SQL_CURRENT + ", " + _EDGES + " select node, ancestor from clo",
    "superclass_counts": "with recursive " + B.SQL_CURRENT + ", " + _EDGES + " select node, count(*) as n_ancestors from clo group by node",
    "one_hop_types": _HOPS + "select id, type, n from one",
    "two_hop_types": _HOPS + "select id, type, n from two",
    "enriched_kg": _HOPS + """, a as (select id, count(*) as n_one, sum(n)::bigint as sum_one from one group by id), b as (select id, count(*) as n_two, sum(n)::bigint as sum_two from two group by id)
select c.id, c.num_claims, coalesce(n_one, 0)::bigint as n_one, coalesce(sum_one, 0)::bigint as sum_one, coalesce(n_two, 0)::bigint as n_two, coalesce(sum_two, 0)::bigint as sum_two
from (select subject as id, count(*) as num_claims from claims_ group by subject) c left join a on a.id = c.id left join b on b.id = c.id
""",
    "degree_popularity": "with " + B.SQL_KG + " select id, coalesce(num_claims, 0) as num_claims, coalesce(round(coalesce(num_claims, 0) / nullif(max(coalesce(num_claims, 0)) over (), 0), 6), 0.0) as degree from kg where id is not null",
    "kg_point_lookup": "with " + B.SQL_MENTIONS + ", " + B.SQL_KG + " select w.id, coalesce(kg.labels, w.id) as label from (select distinct qid as id from m where qid is not null) w left join kg on kg.id = w.id",
    "type_index_lists": "with " + B.SQL_KG + """, t as (select id, unnest(map_keys(one_hop_types)) as type from kg where id is not null),
top as (select type from t group by type order by count(*) desc, type limit 174), v as (select type, row_number() over (order by type) - 1 as idx from top)
select id, string_agg(idx::varchar, ',' order by idx) as idx from (select distinct id, idx from t join v using (type)) group by id
""",
    "merged_type_counts": "with " + B.SQL_KG + " select e.key as type, sum(e.value)::bigint as n from (select unnest(map_entries(two_hop_types)) as e from kg) group by e.key",
}
