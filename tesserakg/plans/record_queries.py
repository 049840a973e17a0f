"""Queries on nested records, dangling references and class hierarchies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserakg.operators import hierarchy as H
from tesserakg.operators import references as R
from tesserakg.operators import shredding as S
from tesserakg.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.record_children(table(spark, sf_dir, "parse_wikidata_dump"))


def p1_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity table of the statements: rank and main snak of every statement, whatever its kind."""
    nodes = S.shred(table(spark, sf_dir, "parse_wikidata_dump"), "line_no", ["claims"])
    found = S.elements(nodes, {"rank": "rank", "mainsnak.snaktype": "snaktype", "mainsnak.property": "property"})
    return found.filter(F.col("parent") == "claims").select(F.col("key").alias("line_no"), F.col("label").alias("claim_name"), F.col("ordinal").alias("pos"), "rank", "snaktype", "property").distinct()


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.record_facts([table(spark, sf_dir, "parse_wikidata_dump"), table(spark, sf_dir, "parsed_dump")], table(spark, sf_dir, "creation_dates"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphan_rows(R.mention_references(table(spark, sf_dir, "wikievents_train")), _facts(spark, sf_dir))


def p4_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphan_report(R.mention_references(table(spark, sf_dir, "wikievents_train")), _facts(spark, sf_dir), "wikievents_train")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "kg_connector").select(F.explode(F.map_keys("two_hop_types")).alias("id"))
    return H.hierarchy(H.class_edges(table(spark, sf_dir, "parse_wikidata_dump")), nodes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).select("id", "root_id", "node_depth", F.coalesce(F.array_join("path", "/"), F.lit("")).alias("full_path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(_classes(spark, sf_dir))


def p5_descendants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs over all links: further parents' ones, and those between classes in or below cycles, too."""
    return H.all_descendants(H.class_edges(table(spark, sf_dir, "parse_wikidata_dump")))


QUERIES = {f.__name__: f for f in (p1_found, p1_statements, p4_found, p4_by_period, p5_found, p5_descendants, p5_descendants_all)}

_P4 = """
with refs as (
  select distinct docno, (i - 1)::int as pos, 'Q' || (regexp_extract(e.qid, '[Qq]\\s*0*([0-9]+)\\s*$', 1)) as qid, event_date as day,
         coalesce(strftime(event_date, '%Y-%m'), 'none') as period_ym
  from (select docno, event_date, unnest(entities) as e, generate_subscripts(entities, 1) as i from wikievents_train)
  where e.qid is not null and not coalesce(e.out_of_kg, false) and regexp_matches(e.qid, '(?:^|[^A-Za-z0-9])[Qq]\\s*0*[0-9]+\\s*$')),
nk as (select id from parse_wikidata_dump union select id from parsed_dump),
known as (select distinct 'Q' || regexp_extract(id, '[Qq]\\s*0*([0-9]+)\\s*$', 1) as id from nk where regexp_matches(id, '(?:^|[^A-Za-z0-9])[Qq]\\s*0*[0-9]+\\s*$')),
nd as (select 'Q' || regexp_extract(qid, '[Qq]\\s*0*([0-9]+)\\s*$', 1) as qid, case when regexp_matches(created, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$') then try_cast(substr(created, 1, 10) as date) end as created,
  case when regexp_matches(deleted, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$') then try_cast(substr(deleted, 1, 10) as date) end as deleted from creation_dates where regexp_matches(qid, '(?:^|[^A-Za-z0-9])[Qq]\\s*0*[0-9]+\\s*$')),
days as (select qid, min(created) as created, min(deleted) as deleted from nd group by qid),
rows_ as (select r.*, case when k.id is null then 'missing' when d.deleted <= r.day then 'deleted' when d.created > r.day then 'later' end as orphan_kind
  from refs r left join known k on k.id = r.qid left join days d on d.qid = r.qid)
"""

_P5 = """
with recursive cur as (select id, claims from (select *, row_number() over (partition by id order by coalesce(lastrevid, -1) desc, line_no) as rn from parse_wikidata_dump where id <> '') where rn = 1),
edges as (select id as child, min(s.mainsnak.datavalue.value.id) as parent from (select id, unnest(claims['P279']) as s from cur)
  where s.mainsnak.snaktype = 'value' and s.mainsnak.datavalue.value.id <> '' group by id),
nodes as (select child as id from edges union select parent from edges union select unnest(map_keys(two_hop_types)) from kg_connector),
up as (select id, [id] as path from nodes where id not in (select child from edges)
  union all select e.child, list_append(u.path, e.child) from up u join edges e on e.parent = u.id),
reach as (select child as id, parent as anc from edges where child not in (select id from up)
  union select r.id, e.parent from reach r join edges e on e.child = r.anc),
ring as (select id from reach where id = anc),
ringroot as (select r.id, min(g.id) as root_id from reach r join ring g on g.id = r.anc group by r.id)
"""

ORACLE = {
    "p1_found": """
with le as (select line_no, unnest(map_entries(labels)) as e from parse_wikidata_dump),
ae as (select line_no, unnest(map_entries(aliases)) as e from parse_wikidata_dump),
ax as (select line_no, e.key as k, unnest(e.value) as v, generate_subscripts(e.value, 1) - 1 as i from ae),
ce as (select line_no, unnest(map_entries(claims)) as e from parse_wikidata_dump),
cs as (select line_no, e.key as k, unnest(e.value) as s, generate_subscripts(e.value, 1) - 1 as i from ce),
qs as (select line_no, k, i, unnest(s.qualifiers) as q, generate_subscripts(s.qualifiers, 1) - 1 as j from cs)
select line_no, 'label' as child_kind, e.key as child_name, 0::int as pos, -1::int as sub_pos, e.value.value as child_value from le where e.value.value <> ''
union select line_no, 'alias', k, i::int, -1::int, v.value from ax where v.value <> ''
union select line_no, 'claim', k, i::int, -1::int, s.mainsnak.datavalue.value.id from cs where s.mainsnak.snaktype = 'value' and s.mainsnak.datavalue.value.id <> ''
union select line_no, 'qualifier', k, i::int, j::int, q.datavalue.value.id from qs where q.snaktype = 'value' and q.datavalue.value.id <> ''
""",
    "p1_statements": """
with ce as (select line_no, unnest(map_entries(claims)) as e from parse_wikidata_dump),
cs as (select line_no, e.key as k, unnest(e.value) as s, generate_subscripts(e.value, 1) - 1 as i from ce)
select distinct line_no, k as claim_name, i::int as pos, s.rank as rank, s.mainsnak.snaktype as snaktype, s.mainsnak.property as property from cs where s is not null
""",
    "p4_found": _P4 + "select docno, pos, qid, orphan_kind, period_ym from rows_ where orphan_kind is not null",
    "p4_by_period": _P4 + "select 'wikievents_train' as table_name, period_ym, orphan_kind, count(*) as n_refs, count(distinct qid) as n_ids from rows_ where orphan_kind is not null group by period_ym, orphan_kind",
    "p5_found": _P5 + """
select id, path[1] as root_id, (len(path) - 1)::int as node_depth, array_to_string(path, '/') as full_path from up
union all select id, root_id, -1::int, '' from ringroot
""",
    "p5_descendants": _P5 + "select path[i] as id, id as descendant_id, (len(path) - i)::int as distance from (select id, path, unnest(range(1, len(path))) as i from up)",
    "p5_descendants_all": _P5 + """, links as (select distinct id as child, s.mainsnak.datavalue.value.id as parent from (select id, unnest(claims['P279']) as s from cur) where s.mainsnak.snaktype = 'value' and s.mainsnak.datavalue.value.id <> ''),
steps as (select child as id, parent as anc, 1 as distance from links union select s.id, e.parent, s.distance + 1 from steps s join links e on e.child = s.anc where s.distance <= (select count(distinct child) from links))
select anc as id, id as descendant_id, min(distance)::int as distance from steps where id <> anc group by anc, id
""",
}
