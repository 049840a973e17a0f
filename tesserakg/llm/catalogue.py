"""Queries on the texts, names and vectors of training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserakg.llm import components, encoding, leakage, mapping, similar, tokenize
from tesserakg.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.match_groups(table(spark, sf_dir, "mention_pairs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "le_titov_mention_mapping").select(F.col("entry_id").alias("key"), F.col("mention").alias("name"))
    listed = table(spark, sf_dir, "parsed_dump")
    names = listed.select("id", F.col("labels").alias("name")).unionByName(listed.select("id", F.explode("aliases").alias("name")))
    return mapping.mapped(entries, names).toDF("entry_id", "qid")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.neighbours(table(spark, sf_dir, "processed_mention"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.token_ids(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their chain and, where nothing was lost, the original text."""
    return encoding.restored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p6_found, p7_ids, p8_found, p9_found, p9_restored)}

ORACLE = {
    "p2_found": """
with recursive e as (select distinct least(a_id, b_id) as a, greatest(a_id, b_id) as b from mention_pairs where is_match and a_id <> b_id),
both_ as (select a, b from e union select b, a from e),
reach as (select a as id, b as other from both_ union select r.id, x.b from reach r join both_ x on x.a = r.other)
select id as mention_id, least(id, min(other)) as group_id from reach group by id
""",
    "p8_found": """
with dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where doc_id is not null),
iw as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items where item_id is not null),
dk as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from dw)),
ik as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as k from (select item_id, w, unnest(range(1, len(w) - 10)) as i from iw))
select distinct doc_id, item_id from dk join ik using (k)
""",
}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
