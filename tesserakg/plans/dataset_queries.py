"""Queries on annotated data sets: marks, filters, splits, ordered context and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserakg.functions import text as T
from tesserakg.operators import datasets as D
from tesserakg.operators import metrics as M
from tesserakg.operators.references import record_facts
from tesserakg.plans import base as B
from tesserakg.runtime import cut, table

CUTOFF = "2012-06-30"


def _created(spark: SparkSession, d: str) -> DataFrame:
    return record_facts([table(spark, d, "parsed_dump")], table(spark, d, "creation_dates")).select("qid", "created")


def _ids(m: DataFrame) -> DataFrame:
    return m.filter(F.col("qid").isNotNull())


def mentions_flat(spark: SparkSession, d: str) -> DataFrame:
    return B.mentions(spark, d)


def in_graph_documents(spark: SparkSession, d: str) -> DataFrame:
    return D.in_graph_only(B.documents(spark, d)).select("docno", F.size("entities").alias("n"))


def existing_mentions(spark: SparkSession, d: str) -> DataFrame:
    return D.existing_only(B.mentions(spark, d), B.kg(spark, d)).select("docno", "pos", "qid")


def usable_mentions(spark: SparkSession, d: str) -> DataFrame:
    return D.usable_only(B.mentions(spark, d), B.kg(spark, d)).select("docno", "pos", "qid")


def artificial_sample(spark: SparkSession, d: str) -> DataFrame:
    return D.sampled_entities(B.mentions(spark, d), 0.1, "7")


def artificial_training(spark: SparkSession, d: str) -> DataFrame:
    m = cut(B.mentions(spark, d))
    return D.artificial_ookg(m, D.sampled_entities(m, 0.1, "7"))[0].select("docno", "pos", "qid", "ookg")


def artificial_test(spark: SparkSession, d: str) -> DataFrame:
    m = cut(B.mentions(spark, d))
    return D.artificial_ookg(m, D.sampled_entities(m, 0.1, "7"))[1].select("docno", "pos", "qid", "ookg")


def ookg_mark(spark: SparkSession, d: str) -> DataFrame:
    return D.ookg_by_creation(_ids(B.mentions(spark, d)), _created(spark, d), CUTOFF)


def ookg_mark_first_mention(spark: SparkSession, d: str) -> DataFrame:
    return D.ookg_by_first_mention(B.mentions(spark, d), _created(spark, d))


def cap_ratio_filter(spark: SparkSession, d: str) -> DataFrame:
    return D.capitalised_entities(B.mentions(spark, d)).select("qid", F.round("ratio", 6).alias("ratio"))


def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return D.temporal_split(B.documents(spark, d), CUTOFF, "7")


def provided_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks that are provided for the mentions at even places only."""
    m = cut(B.mentions(spark, d))
    marks = m.filter("pos % 2 = 0").select("docno", "start", F.col("qid").alias("mark_qid"), F.lit(True).alias("mark_ookg")).distinct()
    return D.annotated(m, marks)


def resolved_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page titles resolved by the ids of the mentions' own pages, else by the graph's labels."""
    docs = B.documents(spark, d).select("docno", F.posexplode("entities").alias("pos", "e")).select("docno", "pos", F.col("e.page_title").alias("page_id"), F.translate("e.page_title", "_", " ").alias("title"))
    pages = B.documents(spark, d).select(F.explode("entities").alias("e")).filter("e.out_of_kg").groupBy(F.col("e.page_title").alias("page_id")).agg(F.min("e.qid").alias("id_qid")).filter("page_id is not null")
    titles = B.kg(spark, d).filter("labels <> ''").groupBy(F.col("labels").alias("title")).agg(F.min("id").alias("title_qid"))
    return D.resolved(docs, pages, titles).select("docno", "pos", "qid")


def document_index(spark: SparkSession, d: str) -> DataFrame:
    return D.document_index(B.mentions(spark, d)).groupBy("qid").agg(F.sum("n").alias("n"), F.sum(F.size("docs")).alias("n_docs"))


def context_window_alternating(spark: SparkSession, d: str) -> DataFrame:
    return D.alternating_context(B.mentions(spark, d), 3)


def preceding_type_union(spark: SparkSession, d: str) -> DataFrame:
    types = B.kg(spark, d).select(F.col("id").alias("qid"), F.map_keys("one_hop_types").alias("types"))
    rows = B.mentions(spark, d).join(types, "qid", "left")
    return D.preceding_union(rows, 2).select("docno", "pos", F.array_join("types", ",").alias("types"))


def max_active_entities(spark: SparkSession, d: str) -> DataFrame:
    """Over all mentions in the order of documents and places."""
    return D.most_active(B.mentions(spark, d).select((F.col("docno") * 1000 + F.col("pos")).alias("at"), "qid"))


def mention_gaps(spark: SparkSession, d: str) -> DataFrame:
    return D.mention_gaps(B.mentions(spark, d).filter("ookg"))


def gap_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.gap_summary(D.mention_gaps(B.mentions(spark, d)))


def chunk_buckets(spark: SparkSession, d: str) -> DataFrame:
    return D.chunks(B.mentions(spark, d), 3, 2)


def mention_slices(spark: SparkSession, d: str) -> DataFrame:
    return D.slices(B.mentions(spark, d), "docno", "pos", 3).select("docno", "pos", "slice")


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.summary(B.documents(spark, d), B.mentions(spark, d))


def cluster_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return D.cluster_histogram(B.mentions(spark, d))


def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return D.ambiguity(B.mentions(spark, d))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = cut(B.mentions(spark, d))
    return m.filter(F.col("day") <= CUTOFF), m.filter(F.col("day") > CUTOFF)


def overlap_ids(spark: SparkSession, d: str) -> DataFrame:
    return D.overlap(*_split(spark, d), ["qid"])


def overlap_ookg_ids(spark: SparkSession, d: str) -> DataFrame:
    a, b = _split(spark, d)
    return D.overlap(a.filter("ookg"), b.filter("ookg"), ["qid"])


def overlap_mentions(spark: SparkSession, d: str) -> DataFrame:
    return D.overlap(*_split(spark, d), ["qid", "mention"])


def id_union(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the events, the dictionary and the graph."""
    return _ids(B.mentions(spark, d)).select(F.col("qid").alias("id")).union(B.dictionary(spark, d).select("qid")).union(B.kg(spark, d).select("id")).filter("id is not null").distinct()


def id_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _ids(B.mentions(spark, d)).select(F.col("qid").alias("id")).intersect(B.kg(spark, d).select("id"))


def mention_ids_without_record(spark: SparkSession, d: str) -> DataFrame:
    return _ids(B.mentions(spark, d)).select(F.col("qid").alias("id")).distinct().join(B.kg(spark, d).select("id"), "id", "left_anti")


def concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Both parts of the split after one another."""
    a, b = _split(spark, d)
    return a.select("docno", "pos", F.lit("early").alias("part")).unionByName(b.select("docno", "pos", F.lit("late").alias("part")))


def doc_segments(spark: SparkSession, d: str) -> DataFrame:
    """Words of each text as lines, every text preceded by a marker line; segments are counted back from the markers."""
    words = B.documents(spark, d).filter("text is not null").select(F.pmod("docno", F.lit(8)).alias("file"), "docno", F.posexplode(F.split("text", " ")).alias("i", "line"))
    lines = words.unionByName(words.groupBy("file", "docno").agg(F.lit(-1).alias("i"), F.lit("-DOCSTART-").alias("line")))
    numbered = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("docno", "i")))
    return D.segments(numbered, "-DOCSTART-").groupBy("file", "doc_no").agg(F.count("*").alias("n_lines"), F.min("docno").alias("docno"))


def iob_spans(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised words as marked tokens: the first of a run begins a span, the others extend it."""
    words = B.documents(spark, d).filter("text is not null").select(F.col("docno").alias("doc_no"), F.posexplode(F.split("text", " ")).alias("line_no", "token"))
    cap = F.col("token").rlike("^[A-Z]")
    w = Window.partitionBy("doc_no").orderBy("line_no")
    tagged = words.withColumn("tag", F.when(~cap, F.lit(None).cast("string")).when(F.coalesce(F.lag(cap).over(w), F.lit(False)), "I").otherwise("B"))
    return D.iob_spans(tagged)


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 20 words over the mentions."""
    text = B.documents(spark, d).select("docno", "text")
    at = lambda n: F.size(F.split(F.substring("text", F.lit(1), n), " "))
    rows = B.mentions(spark, d).join(text, "docno").filter("text is not null and start is not null and len is not null")
    return D.token_windows(rows.select("docno", "pos", (at(F.col("start")) - 1).alias("tok_start"), at(F.col("start") + F.col("len")).alias("tok_end")), 20)


def marked_texts(spark: SparkSession, d: str) -> DataFrame:
    spans = F.transform(F.filter("entities", lambda e: e["offset"].isNotNull() & e["length"].isNotNull()), lambda e: F.struct(e["offset"].alias("start"), e["length"].alias("len")))
    return B.documents(spark, d).filter("text is not null and size(entities) = 1").select("docno", T.marked(F.col("text"), spans).alias("marked"))


def mention_spans(spark: SparkSession, d: str) -> DataFrame:
    """Mentions as they stand in their texts, with the end of the span."""
    text = B.documents(spark, d).select("docno", "text")
    return B.mentions(spark, d).join(text, "docno").filter("text is not null").select("docno", "pos", "start", (F.col("start") + F.col("len")).alias("stop"), F.substring("text", F.col("start") + 1, F.col("len")).alias("surface"))


def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    return B.kg(spark, d).select("id", T.entity_text(F.col("labels"), F.col("descriptions")).alias("text"))


def entity_text_spans(spark: SparkSession, d: str) -> DataFrame:
    claims = F.transform("claims", lambda c: F.concat_ws(" ", F.get(c, 0), F.get(c, 1)))
    spans = T.entity_spans(F.col("labels"), F.col("aliases"), F.col("descriptions"), claims)
    return B.parsed(spark, d).select("id", F.posexplode(spans).alias("n", "s")).select("id", "n", "s.kind", "s.start", "s.stop")


def masked_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The mention's words masked as one, in texts with one mention."""
    tokens = F.split("mention", " ")
    return B.mentions(spark, d).filter("mention is not null").select("docno", "pos", F.array_join(T.masked(tokens, F.lit(1), F.size(tokens), collapse=True), " ").alias("collapsed"), F.array_join(T.masked(tokens, F.lit(0), F.lit(1)), " ").alias("first"))


def differing_keys(spark: SparkSession, d: str) -> DataFrame:
    """Mentions that stand for more than one id."""
    return M.differing(_ids(B.mentions(spark, d)).filter("mention is not null"), "mention", "qid")


def mean_std_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Mentions per document and kind: mean and deviation."""
    per = B.mentions(spark, d).groupBy("docno", F.when(F.col("ookg"), "outside").otherwise("inside").alias("kind")).agg(F.count("*").alias("n_mentions"))
    return M.mean_std(per, "kind", "n_mentions")


def two_best_candidates(spark: SparkSession, d: str) -> DataFrame:
    best = B.dictionary(spark, d).groupBy("mention", "qid").agg(F.max("prior").alias("prior"))
    return M.two_best(best, "mention", "qid", "prior")


def parsed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Labels, descriptions and claims apart."""
    p = B.parsed(spark, d)
    return p.select("id", F.lit("label").alias("part"), F.col("labels").alias("value")).unionByName(p.select("id", F.lit("description").alias("part"), F.col("descriptions").alias("value"))).filter("value is not null and value <> ''")


_FUNCTIONS = (mentions_flat, in_graph_documents, existing_mentions, usable_mentions, artificial_sample, artificial_training, artificial_test, ookg_mark, ookg_mark_first_mention, cap_ratio_filter, temporal_split, provided_marks, resolved_pages, document_index, context_window_alternating, preceding_type_union, max_active_entities, mention_gaps, gap_summary, chunk_buckets, mention_slices, dataset_summary, cluster_size_histogram, ambiguity, overlap_ids, overlap_ookg_ids, overlap_mentions, id_union, id_intersection, mention_ids_without_record, concatenated, doc_segments, iob_spans, token_windows, marked_texts, mention_spans, entity_texts, entity_text_spans, masked_mentions, differing_keys, mean_std_pivot, two_best_candidates, parsed_parts)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_M = "with " + B.SQL_MENTIONS
_SAMPLE = ", ids as (select qid, row_number() over (order by md5('7|' || qid), qid) as place, count(*) over () as n from (select distinct qid from m where qid is not null and not ookg)), smp as (select qid from ids where place <= floor(0.1 * n))"
_DAYS = r""", dts as (select case when regexp_matches(qid, '(?:^|[^A-Za-z0-9])[Qq]\s*0*[0-9]+\s*$') then 'Q' || regexp_extract(qid, '[Qq]\s*0*([0-9]+)\s*$', 1) end as qid,
  case when regexp_matches(created, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$') then try_cast(substr(created, 1, 10) as date) end as created from creation_dates), fst as (select qid, min(created) as created from dts where qid is not null group by qid)"""
_GAPS = """, dy as (select qid, day, count(*) as n from m where qid is not null and day is not null {w} group by all), gp as (select qid, n, coalesce(day - lag(day) over (partition by qid order by day), 0) as gap from dy),
gs as (select qid, sum(n)::bigint as n, round(sum(gap) / sum(n), 6) as mean_gap from gp group by qid)"""


def _overlap(keys: str, where: str = "true") -> str:
    return _M + f""", a as (select distinct {keys} from m where day <= date '{CUTOFF}' and {where}), b as (select distinct {keys} from m where day > date '{CUTOFF}' and {where}), i as (select * from a intersect select * from b),
c as (select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from i) as n_both) select *, round(n_both / nullif(n_a, 0), 6) as share_a, round(n_both / nullif(n_b, 0), 6) as share_b from c"""


ORACLE = {
    "mentions_flat": _M + " select docno, pos, mention, qid, ookg, day, start, len from m",
    "in_graph_documents": "with " + B.SQL_EVENTS + ", x as (select docno, len(list_filter(entities, lambda e: e is not null and not coalesce(e.out_of_kg, false)))::int as n from ev) select docno, n from x where n > 0",
    "existing_mentions": _M + " select docno, pos, qid from m where ookg or qid in (select id from kg_connector where id is not null)",
    "usable_mentions": _M + " select docno, pos, qid from m where len > 0 and qid in (select id from kg_connector where id is not null)",
    "artificial_sample": _M + _SAMPLE + " select qid from smp",
    "artificial_training": _M + _SAMPLE + " select docno, pos, qid, ookg from m where not (coalesce(qid in (select qid from smp), false) and not ookg)",
    "artificial_test": _M + _SAMPLE + " select docno, pos, qid, ookg or coalesce(qid in (select qid from smp), false) as ookg from m",
    "ookg_mark": _M + _DAYS + f" select w.qid, (f.created is null or f.created > date '{CUTOFF}') as ookg from (select distinct qid from m where qid is not null) w left join fst f using (qid)",
    "ookg_mark_first_mention": _M + _DAYS + " select w.qid, coalesce(f.created > w.first, false) as ookg from (select qid, min(day) as first from m where qid is not null group by qid) w left join fst f using (qid)",
    "cap_ratio_filter": _M + ", x as (select qid, avg(case when upper(mention[1]) = mention[1] and lower(mention[1]) <> mention[1] then 1 else 0 end) as r from m where qid is not null and mention <> '' group by qid) select qid, round(r, 6) as ratio from x where r > 0.5",
    "temporal_split": "with " + B.SQL_EVENTS + f" select docno, case when coalesce(event_date > date '{CUTOFF}', false) then case when md5('7|' || docno)[1] < '8' then 'dev' else 'test' end else 'train' end as part from ev where docno is not null",
    "provided_marks": _M + ", k as (select distinct docno, start, qid from m where pos % 2 = 0) select m.docno, m.pos, m.mention, k.qid, true as ookg from m join k using (docno, start)",
    "resolved_pages": "with " + B.SQL_EVENTS + ", " + B.SQL_KG + """, e as (select docno, (i - 1)::int as pos, e.page_title as t, e.qid as q, e.out_of_kg as o from (select docno, unnest(entities) as e, generate_subscripts(entities, 1) as i from ev)),
p as (select t, min(q) as q from e where o and t is not null group by t), l as (select labels as t, min(id) as q from kg where labels <> '' group by labels)
select docno, pos, coalesce(p.q, l.q) as qid from e left join p on p.t = e.t left join l on l.t = replace(e.t, '_', ' ') where coalesce(p.q, l.q) is not null
""",
    "document_index": _M + " select qid, count(*) as n, count(distinct docno) as n_docs from m where qid is not null group by qid",
    "context_window_alternating": _M + """, p as (select a.docno, a.pos, b.qid as other, case when b.pos < a.pos then 0 else 1 end as side, abs(b.pos - a.pos) as dist from m a join m b on a.docno = b.docno and a.pos <> b.pos where a.qid is not null and b.qid is not null and not b.ookg and a.qid <> b.qid),
t as (select *, row_number() over (partition by docno, pos, side order by dist) as turn from p), c as (select *, (select count(*) from t u where u.docno = t.docno and u.pos = t.pos and u.turn < t.turn) as before from t)
select docno, pos, row_number() over (partition by docno, pos order by turn, side)::int as place, other from c where before < 3
""",
    "preceding_type_union": _M + ", " + B.SQL_KG + """, r as (select m.docno, m.pos, map_keys(kg.one_hop_types) as types from m left join kg on kg.id = m.qid)
select a.docno, a.pos, coalesce((select string_agg(t, ',' order by t) from (select distinct unnest(b.types) as t from r b where b.docno = a.docno and b.pos in (select pos from (select pos from r c where c.docno = a.docno and c.pos < a.pos order by pos desc limit 2)))), '') as types from r a
""",
    "max_active_entities": _M + """, s as (select docno * 1000 + pos as p, qid from m where qid is not null), e as (select qid, min(p) as a, max(p) as b from s group by qid having min(p) < max(p)),
st as (select p, sum(x) as x from (select a as p, 1 as x from e union all select b, -1 from e) group by p) select coalesce(max(r), 0)::bigint as max_active from (select sum(x) over (order by p) as r from st)
""",
    "mention_gaps": _M + _GAPS.format(w="and ookg") + " select qid, n, mean_gap from gs",
    "gap_summary": _M + _GAPS.format(w="") + """ select count(*) filter (n = 1) as single, count(*) filter (n > 1) as multiple, round(avg(mean_gap) filter (n > 1), 6) as mean_gap, round(stddev_pop(mean_gap) filter (n > 1), 6) as std_gap,
  round(max(mean_gap) filter (n > 1), 6) as max_gap, round(median(mean_gap) filter (n > 1), 6) as median_gap from gs""",
    "chunk_buckets": _M + ", r as (select docno, pos, row_number() over (partition by docno order by pos) - 1 as p from m) select docno, pos, (case when p < 3 then 0 else 1 + (p - 3) // 2 end)::int as chunk from r",
    "mention_slices": _M + " select docno, pos, ((row_number() over (partition by docno order by pos) - 1) // 3)::int as slice from m",
    "dataset_summary": _M + ", s as (select count(*) as n_mentions, count(*) filter (ookg) as n_ookg, count(distinct qid) as n_unique, count(distinct qid) filter (ookg) as n_unique_ookg from m), e as (select count(*) as n_examples from ev) select *, round(n_mentions / nullif(n_examples, 0), 6) as mentions_per_example from e, s",
    "cluster_size_histogram": _M + ", z as (select count(*) as s from m where qid is not null group by qid), b as (select case when s <= 5 then s::varchar when s <= 10 then '6-10' when s <= 20 then '11-20' when s <= 50 then '21-50' else '51+' end as bucket, count(*) as n from z group by 1) select bucket, n, round(100 * n / (select sum(n) from b), 6) as percent from b",
    "ambiguity": _M + """, x as (select lower(mention) as s, qid, ookg from m where mention is not null and qid is not null), a as (select count(distinct qid) as n from x group by s), b as (select count(distinct s) as n from x group by qid), c as (select count(distinct qid) as n from x where ookg group by s)
select (select round(avg(n), 6) from a) as mean_ids_per_mention, (select median(n) from a)::double as median_ids_per_mention, (select round(avg(n), 6) from b) as mean_mentions_per_id, (select median(n) from b)::double as median_mentions_per_id,
  (select round(avg(n), 6) from c) as mean_ookg_ids_per_mention, (select median(n) from c)::double as median_ookg_ids_per_mention
""",
    "overlap_ids": _overlap("qid", "qid is not null"),
    "overlap_ookg_ids": _overlap("qid", "qid is not null and ookg"),
    "overlap_mentions": _overlap("qid, mention", "qid is not null and mention is not null"),
    "id_union": _M + ", " + B.SQL_DICTIONARY + " select qid as id from m where qid is not null union select qid from dict union select id from kg_connector where id is not null",
    "id_intersection": _M + " select qid as id from m where qid is not null intersect select id from kg_connector",
    "mention_ids_without_record": _M + " select qid as id from m where qid is not null except select id from kg_connector",
    "concatenated": _M + f" select docno, pos, case when day <= date '{CUTOFF}' then 'early' else 'late' end as part from m where day is not null",
    "doc_segments": "with " + B.SQL_EVENTS + ", x as (select ((docno % 8) + 8) % 8 as file, docno, len(string_split(text, ' ')) + 1 as n from ev where text is not null) select file, row_number() over (partition by file order by docno)::bigint as doc_no, n as n_lines, docno from x",
    "iob_spans": "with " + B.SQL_EVENTS + """, w as (select docno, unnest(string_split(text, ' ')) as t, generate_subscripts(string_split(text, ' '), 1) as i from ev where text is not null),
c as (select *, regexp_matches(t, '^[A-Z]') as cap, sum(length(t) + 1) over (partition by docno order by i) - length(t) - 1 as st from w), g as (select *, sum(case when cap then 0 else 1 end) over (partition by docno order by i) as grp from c)
select docno as doc_no, min(st)::bigint as start, (max(st + length(t)) - min(st))::bigint as len, string_agg(t, ' ' order by i) as mention from g where cap group by docno, grp
""",
    "marked_texts": "with " + B.SQL_EVENTS + """, x as (select docno, text, list_filter(entities, lambda e: e."offset" is not null and e.length is not null) as e from ev where text is not null and len(entities) = 1)
select docno, case when len(e) = 0 then text else text[1 : e[1]."offset" + e[1].length] || '[ENTITY_S]' || text[e[1]."offset" + 1 : e[1]."offset" + e[1].length] || '[ENTITY_E]' || text[e[1]."offset" + e[1].length + 1 :] end as marked from x
""",
    "mention_spans": _M + " select m.docno, m.pos, m.start, m.start + m.len as stop, substring(ev.text, m.start + 1, m.len) as surface from m join ev using (docno) where ev.text is not null",
    "entity_texts": "with " + B.SQL_KG + " select id, coalesce(labels, '') || ' </s></s> ' || coalesce(descriptions, '') as text from kg",
    "entity_text_spans": "with " + B.SQL_PARSED + """, p as (select id, list_concat(list_concat(
  list_transform(list_filter(list_concat([labels], coalesce(aliases, [])), lambda v: v <> ''), lambda v: {'kind': 0, 'piece': v}), list_transform(list_filter([descriptions], lambda v: v <> ''), lambda v: {'kind': 1, 'piece': v})),
  coalesce(list_transform(list_filter(list_transform(claims, lambda c: concat_ws(' ', c[1], c[2])), lambda v: v <> ''), lambda v: {'kind': 2, 'piece': v}), [])) as l from pd),
r as (select id, unnest(l) as x, generate_subscripts(l, 1) - 1 as n from p), s as (select id, n, x.kind as kind, length(x.piece) as z, sum(length(x.piece) + 1) over (partition by id order by n) as e from r)
select id, n::int as n, kind, (e - z - 1)::int as start, (e - 1)::int as stop from s
""",
    "masked_mentions": _M + """, t as (select docno, pos, string_split(mention, ' ') as t from m where mention is not null)
select docno, pos, case when len(t) > 1 then t[1] || ' <mask>' else t[1] end as collapsed, array_to_string(list_concat(['<mask>'], t[2:]), ' ') as first from t
""",
    "differing_keys": _M + " select mention, count(distinct qid) as n_values from m where qid is not null and mention is not null group by mention having count(distinct qid) > 1",
    "mean_std_pivot": _M + ", p as (select docno, case when ookg then 'outside' else 'inside' end as kind, count(*) as n_mentions from m group by all) select kind, count(*) as n, round(avg(n_mentions), 6) as mean, round(stddev_pop(n_mentions), 6) as std from p group by kind",
    "two_best_candidates": "with " + B.SQL_DICTIONARY + ", b as (select mention, qid, max(prior) as prior from dict group by all), r as (select *, row_number() over (partition by mention order by prior desc, qid) as p from b) select mention, max(qid) filter (p = 1) as best, max(qid) filter (p = 2) as second from r where p <= 2 group by mention",
    "parsed_parts": "with " + B.SQL_PARSED.replace(" and id is not null", "") + " select id, 'label' as part, labels as value from pd where labels <> '' union all select id, 'description', descriptions from pd where descriptions <> ''",
}
