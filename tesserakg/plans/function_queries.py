"""Queries on functions, formats and training material, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserakg.functions import text as T
from tesserakg.operators import candidates as C
from tesserakg.operators import datasets as D
from tesserakg.operators import kg as K
from tesserakg.operators import metrics as M
from tesserakg.plans import base as B
from tesserakg.runtime import table
from tesserakg.sources import writers as W
from tesserakg.streaming import windows as S


def edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Mentions against their pages' titles."""
    rows = B.documents(spark, d).select("docno", F.posexplode("entities").alias("pos", "e")).filter("e.page_title is not null and e.mention is not null")
    title = F.translate("e.page_title", "_", " ")
    return rows.select("docno", "pos", F.round(T.edit_similarity(F.col("e.mention"), title), 6).alias("ratio"), F.round(T.partial_similarity(F.col("e.mention"), title), 6).alias("partial"))


def url_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = B.documents(spark, d).select("docno", F.posexplode("entities").alias("pos", "e")).filter("e.page_title is not null")
    return rows.select("docno", "pos", T.url_decoded(T.url_encoded(F.col("e.page_title"))).alias("title"))


def occurrence_counts(spark: SparkSession, d: str) -> DataFrame:
    text = B.documents(spark, d).select("docno", "text")
    rows = B.mentions(spark, d).filter("mention <> ''").join(text, "docno").filter("text is not null")
    return rows.select("docno", "pos", F.size(T.occurrences(F.col("text"), F.col("mention"))).alias("n"))


def day_pages(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of all days between the first and the last event."""
    ends = B.documents(spark, d).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("day")).select("day", T.page_url(F.col("day")).alias("url"))


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"))


def formatted_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("n_chars is not null").groupBy("lang").agg(F.sum("n_chars").alias("n"), F.count("*").alias("docs"))
    return rows.select("lang", T.thousands(F.col("n")).alias("chars"), T.percent(F.round(F.col("docs") / F.lit(1000.0), 6)).alias("share"))


def nif_export(spark: SparkSession, d: str) -> DataFrame:
    return W.nif_lines(B.mentions(spark, d).filter("start is not null and len is not null"))


def evaluator_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the evaluator's table for the mentions' ids in order."""
    m = B.mentions(spark, d).filter("qid is not null")
    return W.evaluator_rows(m.select((F.col("docno") * 1000 + F.col("pos")).alias("place"), F.col("qid").alias("label")))


def label_index(spark: SparkSession, d: str) -> DataFrame:
    """Inverted index over labels and aliases."""
    kg = B.kg(spark, d)
    names = kg.select("id", F.col("labels").alias("name")).unionByName(kg.select("id", F.explode("aliases").alias("name")))
    return C.token_index(names).distinct()


def type_vectors(spark: SparkSession, d: str) -> DataFrame:
    types = B.kg(spark, d).filter("id is not null").select("id", F.explode(F.map_keys("one_hop_types")).alias("type"))
    top = types.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(71)
    return K.multi_hot(types, top).select("id", F.array_join(F.transform("vec", lambda x: x.cast("string")), "").alias("bits"))


def sampled_negatives(spark: SparkSession, d: str) -> DataFrame:
    return D.sampled_negatives(B.mentions(spark, d), B.kg(spark, d).filter("id is not null"), 3)


def random_marks(spark: SparkSession, d: str) -> DataFrame:
    return D.random_marks(B.mentions(spark, d), 0.1).select("docno", "pos", "ookg")


def free_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return D.free_occurrences(B.documents(spark, d), B.mentions(spark, d))


def windowed_mentions(spark: SparkSession, d: str) -> DataFrame:
    return S.windowed_mentions(table(spark, d, "wikievents_train").distinct(), late="36500 days")


def connected_to(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the records that the events mention."""
    ids = B.mentions(spark, d).filter("qid is not null").select(F.col("qid").alias("id"))
    return K.connected(K.claim_rows(B.reduced(spark, d)), ids)


def service_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Links by gold ids against those of a lookup by the exact surface's most frequent id."""
    m = B.mentions(spark, d)
    best = m.filter("qid is not null").groupBy("mention").agg(F.min("qid").alias("link"))
    return M.position_agreement(m.filter("pos > 0").select("docno", "pos", F.col("qid").alias("link")), m.filter("pos < 4").join(best, "mention", "left").select("docno", "pos", "link"))


def chunk_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of matched pairs, over the blocks' means."""
    return M.mean_over_chunks(table(spark, d, "mention_pairs").filter("is_match"), "block_key", "score")


def cluster_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of equal surfaces (lower case) for the events' mentions."""
    members = table(spark, d, "processed_mention").select(F.lower("mention").alias("root"), "mention")
    return C.cluster_candidates(B.mentions(spark, d), members)


QUERIES = {f.__name__: f for f in (edit_similarity, url_round_trip, occurrence_counts, day_pages, json_fields, formatted_counts, nif_export, evaluator_table, label_index, type_vectors, sampled_negatives, random_marks, free_occurrences, windowed_mentions, connected_to, service_comparison, chunk_means, cluster_candidates)}

_M = "with " + B.SQL_MENTIONS
_E = "with " + B.SQL_EVENTS + ", e as (select docno, (i - 1)::int as pos, e.page_title as title, e.mention as mention from (select docno, unnest(entities) as e, generate_subscripts(entities, 1) as i from ev))"

ORACLE = {
    "url_round_trip": _E + " select docno, pos, title from e where title is not null",
    "occurrence_counts": _M + " select m.docno, m.pos, ((length(lower(ev.text)) - length(replace(lower(ev.text), lower(m.mention), ''))) // length(m.mention))::int as n from m join ev using (docno) where m.mention <> '' and ev.text is not null",
    "day_pages": "with x as (select unnest(generate_series(min(event_date), max(event_date), interval 1 day))::date as day from wikievents_train) select day, 'https://en.wikipedia.org/wiki/Portal:Current_events/' || strftime(day, '%Y_%B_%-d') as url from x",
    "json_fields": "select event_type, count(json_extract(props, '$.k')) as n, sum(json_extract(props, '$.k')::bigint)::bigint as total from events group by event_type",
    "formatted_counts": "select lang, format('{:,}', sum(n_chars)::bigint) as chars, printf('%.1f', 100 * round(count(*) / 1000.0, 6)) as share from documents where n_chars is not null group by lang",
    "nif_export": _M + r""" select docno, pos, '<http://example.org/doc' || docno || '#offset_' || start || '_' || (start + len) || '> a nif:Phrase ; nif:anchorOf "' || replace(replace(replace(coalesce(mention, ''), '\', '\\'), '"', '\"'), chr(10), '\n')
  || '" ; nif:beginIndex "' || start || '"^^xsd:nonNegativeInteger ; nif:endIndex "' || (start + len) || '"^^xsd:nonNegativeInteger ; itsrdf:taIdentRef <http://www.wikidata.org/entity/' || coalesce(qid, '') || '> ; itsrdf:taMsClassRef <' || case when ookg then 'OutOfKG' else 'InKG' end || '> .' as turtle
from m where start is not null and len is not null""",
    "evaluator_table": _M + " select 0 as doc, 2 * (docno * 1000 + pos) as start, 2 * (docno * 1000 + pos) + 1 as stop, qid as label, 1.0::double as score, 'MISC' as kind from m where qid is not null",
    "label_index": "with " + B.SQL_KG + r", n as (select id, labels as name from kg union all select id, unnest(aliases) from kg), w as (select id, name, list_filter(string_split_regex(lower(name), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from n where name is not null) select distinct id, name, len(w)::int as n_tokens, unnest(list_distinct(w)) as token from w where len(w) > 0",
    "type_vectors": "with " + B.SQL_KG + ", t as (select id, unnest(map_keys(one_hop_types)) as type from kg where id is not null), v as (select type from t group by type order by count(*) desc, type limit 71) select i.id, string_agg(case when t.id is null then '0' else '1' end, '' order by v.type) as bits from (select distinct id from t) i cross join v left join t on t.id = i.id and t.type = v.type group by i.id",
    "random_marks": _M + " select docno, pos, ookg or (('0x' || substr(md5('7|' || docno || ':' || pos), 1, 8))::bigint / 4294967296.0 < 0.1) as ookg from m",
    "windowed_mentions": "select date_trunc('day', ingested) as win_start, e.qid as qid, count(*) as n from (select ingested, unnest(entities) as e from (select distinct * from wikievents_train where ingested is not null)) where e.qid is not null group by all",
    "connected_to": _M + ", " + B.SQL_CLAIMS + " select subject as id, property, object as other from claims_ where subject in (select qid from m where qid is not null)",
    "service_comparison": _M + """, b as (select mention, min(qid) as link from m where qid is not null group by mention), x as (select docno, pos, qid as a from m where pos > 0), y as (select m.docno, m.pos, b.link as b from m left join b using (mention) where m.pos < 4),
j as (select a, b, x.docno is not null as ia, y.docno is not null as ib from x full join y using (docno, pos)), s as (select count(*) filter (ia and ib) as n_both, count(*) filter (not ib) as n_only_ours, count(*) filter (not ia) as n_only_theirs,
  count(*) filter (ia and ib and a is not distinct from b) as n_equal, count(*) filter (ia and ib and a is null and b is null) as n_both_outside from j) select *, round(coalesce(n_equal / nullif(n_both, 0), 0.0), 6) as agreement from s
""",
    "chunk_means": "select count(*) as n_chunks, round(avg(m), 6) as mean from (select avg(score) as m from mention_pairs where is_match and score is not null group by block_key)",
}
