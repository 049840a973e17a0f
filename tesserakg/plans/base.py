"""The project's tables as the domain's views, as DataFrames and as SQL; copies count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserakg.operators import candidates as C
from tesserakg.operators import datasets as D
from tesserakg.operators import kg as K
from tesserakg.runtime import item_id, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docno, text, day, entities`` of the annotated texts."""
    return table(spark, sf_dir, "wikievents_train").select("docno", "text", F.col("event_date").alias("day"), "entities").distinct()


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docno, pos, mention, qid, ookg, day, start, len`` of the marked mentions."""
    return D.mentions(documents(spark, sf_dir)).withColumn("qid", item_id(F.col("qid")))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mention, rank, qid, prior`` of the mention dictionary; of a mention's entries the first one holds."""
    return C.dictionary(table(spark, sf_dir, "le_titov_mention_mapping"))


def kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kg_connector").dropDuplicates(["id"])


def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduced current records of the raw dump."""
    return K.reduce_records(K.current_records(table(spark, sf_dir, "parse_wikidata_dump")))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_dump").dropDuplicates(["id"])


SQL_EVENTS = "ev as (select distinct docno, text, event_date, entities from wikievents_train)"
SQL_MENTIONS = SQL_EVENTS + r""",
m as (select docno, (i - 1)::int as pos, e.mention as mention, case when regexp_matches(e.qid, '(?:^|[^A-Za-z0-9])[Qq]\s*0*[0-9]+\s*$') then 'Q' || regexp_extract(e.qid, '[Qq]\s*0*([0-9]+)\s*$', 1) end as qid,
  coalesce(e.out_of_kg, false) as ookg, event_date as day, e."offset" as start, e.length as len
  from (select docno, event_date, unnest(entities) as e, generate_subscripts(entities, 1) as i from ev) where e is not null)"""
SQL_DICTIONARY = """fe as (select mention, candidates from (select mention, candidates, row_number() over (partition by mention order by entry_id) as rn
  from (select distinct entry_id, mention, candidates from le_titov_mention_mapping where mention is not null)) where rn = 1),
dict as (select mention, (i - 1)::int as rank, c.qid as qid, coalesce(c.prior, 0.0) as prior
  from (select mention, unnest(candidates) as c, generate_subscripts(candidates, 1) as i from fe) where c.qid is not null)"""
SQL_KG = "kg as (select * from (select *, row_number() over (partition by id order by id) as rn from kg_connector) where rn = 1)"
SQL_PARSED = "pd as (select * from (select *, row_number() over (partition by id order by id) as rn from parsed_dump) where rn = 1 and id is not null)"
SQL_CURRENT = "cur as (select * from (select *, row_number() over (partition by id order by coalesce(lastrevid, -1) desc, line_no) as rn from parse_wikidata_dump where id <> '') where rn = 1)"
SQL_CLAIMS = SQL_CURRENT + """,
st as (select id, unnest(flatten(map_values(claims))) as s from cur),
claims_ as (select distinct id as subject, s.mainsnak.property as property, s.mainsnak.datavalue.value.id as object from st
  where s.mainsnak.snaktype = 'value' and s.mainsnak.datatype = 'wikibase-item' and s.mainsnak.datavalue.value.id <> '' and s.mainsnak.property is not null)"""
SQL_PD_CLAIMS = SQL_PARSED + ", pc as (select id as subject, c[1] as property, c[2] as object from (select id, unnest(claims) as c from pd) where c[1] is not null and c[2] is not null)"
