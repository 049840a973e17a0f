"""References to records that do not exist: rows and counts per period.

Defined cases: a reference without a usable id is none; unknown dates decide nothing; a reference without a date has
the period ``none``; copies of a reference count once; of several creation (deletion) days of a record the earliest holds;
empty tables give empty results. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakg.runtime import cut, heavy_keys, iso_day, item_id, skew_join


def mention_references(events: DataFrame) -> DataFrame:
    """``docno, pos, qid, day, period_ym`` of every marked mention that claims a record: an id, and not marked as outside."""
    return (
        events.select("docno", F.col("event_date").alias("day"), F.posexplode("entities").alias("pos", "e"))
        .filter(F.col("e.qid").isNotNull() & ~F.coalesce(F.col("e.out_of_kg"), F.lit(False)))
        .select("docno", "pos", item_id(F.col("e.qid")).alias("qid"), "day", F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none")).alias("period_ym"))
        .filter(F.col("qid").isNotNull())
        .distinct()
    )


def record_facts(id_tables: list[DataFrame], dates: DataFrame) -> DataFrame:
    """One row per id: whether any table has it, and its first creation and deletion day."""
    ids = reduce(DataFrame.union, [t.select(item_id(F.col("id")).alias("qid")) for t in id_tables]).select("qid", F.lit(True).alias("known"), F.lit(None).cast("date").alias("created"), F.lit(None).cast("date").alias("deleted"))
    days = dates.select(item_id(F.col("qid")).alias("qid"), F.lit(False).alias("known"), iso_day(F.col("created")).alias("created"), iso_day(F.col("deleted")).alias("deleted"))
    return ids.union(days).filter(F.col("qid").isNotNull()).groupBy("qid").agg(F.max("known").alias("known"), F.min("created").alias("created"), F.min("deleted").alias("deleted"))


def _kind() -> F.Column:
    return (
        F.when(~F.coalesce(F.col("known"), F.lit(False)), "missing")
        .when(F.col("deleted") <= F.col("day"), "deleted")
        .when(F.col("created") > F.col("day"), "later")
    )


def orphan_keys(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """Orphaned ``qid, day`` with their kind and number of references.

    References are first counted per id and day, so a hot id is at most one row per day afterwards. Heavy ids (at most
    a fixed number, see ``heavy_keys``) are checked by broadcast; of all others the missing ones are what an anti-join with the
    known ids leaves, and the dated ones are held against their days; the parts are united.
    """
    counts = refs.groupBy("qid", "day", "period_ym").agg(F.count("*").alias("n_refs"))
    heavy = F.broadcast(heavy_keys(refs, "qid").withColumn("heavy", F.lit(True)))
    tagged = counts.join(heavy, "qid", "left")
    few = facts.join(heavy, "qid", "left_semi")
    hot = tagged.filter("heavy").join(F.broadcast(few), "qid", "left").withColumn("orphan_kind", _kind())
    rest = tagged.filter("heavy is null")
    missing = rest.join(facts.filter("known").select("qid"), "qid", "left_anti").withColumn("orphan_kind", F.lit("missing"))
    dated = rest.join(facts.filter("known and (created is not null or deleted is not null)"), "qid").withColumn("orphan_kind", _kind())
    out = ["qid", "day", "period_ym", "orphan_kind", "n_refs"]
    return hot.select(*out).unionByName(missing.select(*out)).unionByName(dated.select(*out)).filter(F.col("orphan_kind").isNotNull())


def orphan_rows(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """Every orphaned reference with its kind; the verdict is taken per id and day and handed back by a join split by weight."""
    refs, facts = cut(refs), cut(facts)
    key = F.concat_ws("|", "qid", "day")
    verdicts = orphan_keys(refs, facts).select(key.alias("key"), "orphan_kind")
    return skew_join(refs.withColumn("key", key), cut(verdicts), "key").select("docno", "pos", "qid", "orphan_kind", "period_ym")


def orphan_report(refs: DataFrame, facts: DataFrame, table_name: str) -> DataFrame:
    """Orphans per table, period and kind: references and distinct ids."""
    per_key = orphan_keys(cut(refs), cut(facts)).groupBy("period_ym", "orphan_kind", "qid").agg(F.sum("n_refs").alias("n"))
    return per_key.groupBy("period_ym", "orphan_kind").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_ids")).select(F.lit(table_name).alias("table_name"), "period_ym", "orphan_kind", "n_refs", "n_ids")
