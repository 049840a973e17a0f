"""Knowledge-graph preparation: reduced records, restrictions, class hierarchies and type neighbourhoods.

Defined cases: null records' parts count as empty; null ids, properties and objects make no claim; copies of a record count
once (the current revision holds); empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserakg.runtime import cut, drop

# The properties whose objects are types.
TYPE_PROPERTIES = ("P31", "P106", "P641", "P17")


def current_records(records: DataFrame) -> DataFrame:
    """Of each id the record with the highest revision (then the smallest line); one aggregation, no sort of all records."""
    rest = [c for c in records.columns if c != "id"]
    best = records.filter(F.col("id") != "").groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("lastrevid", F.lit(-1)), -F.coalesce("line_no", F.lit(0)))).alias("r"))
    return best.select("id", "r.*")


def _english(texts: str) -> Column:
    return F.col(texts)["en"]["value"]


def reduce_records(records: DataFrame, language: str = "en") -> DataFrame:
    """``id, label, description, aliases, claims``: one language, and claims as (property, object) pairs.

    The label falls back to the first other language that has one, then to the empty string; claims keep statements with
    an item as value only.
    """
    own = lambda c: F.col(c)[language]["value"]
    others = F.filter(F.map_values("labels"), lambda x: x["value"].isNotNull())
    statements = F.filter(F.flatten(F.filter(F.map_values("claims"), lambda x: x.isNotNull())), is_item_statement)
    return records.select(
        "id",
        F.coalesce(own("labels"), F.get(others, 0)["value"], F.lit("")).alias("label"),
        F.coalesce(own("descriptions"), F.lit("")).alias("description"),
        F.coalesce(F.filter(F.transform(F.col("aliases")[language], lambda a: a["value"]), lambda a: a.isNotNull()), F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(F.transform(statements, lambda s: F.struct(s["mainsnak"]["property"].alias("property"), s["mainsnak"]["datavalue"]["value"]["id"].alias("object"))), F.array().cast("array<struct<property:string,object:string>>")).alias("claims"),
    )


def is_item_statement(s: Column) -> Column:
    snak = s["mainsnak"]
    good = (snak["snaktype"] == "value") & (snak["datatype"] == "wikibase-item") & (snak["datavalue"]["value"]["id"] != "") & snak["property"].isNotNull()
    return F.coalesce(good, F.lit(False))


def claim_rows(reduced: DataFrame) -> DataFrame:
    """``subject, property, object`` of reduced records, once each."""
    return reduced.select(F.col("id").alias("subject"), F.explode("claims").alias("c")).select("subject", "c.property", "c.object").distinct()


def pair_rows(parsed: DataFrame) -> DataFrame:
    """``subject, property, object`` of records whose claims are [property, object] arrays."""
    pairs = parsed.select(F.col("id").alias("subject"), F.explode("claims").alias("c")).select("subject", F.get("c", 0).alias("property"), F.get("c", 1).alias("object"))
    return pairs.filter(F.col("subject").isNotNull() & F.col("property").isNotNull() & F.col("object").isNotNull())


def type_filter(reduced: DataFrame, types: DataFrame) -> DataFrame:
    """``id, kind``: ``full`` for properties and items that are an instance of a wanted type, ``labels_only`` for other items.

    ``types`` has ``id``; records that are neither item nor property are left out.
    """
    wanted = claim_rows(reduced).filter(F.col("property") == "P31").join(types.select(F.col("id").alias("object")).distinct(), "object", "left_semi").select(F.col("subject").alias("id")).distinct().withColumn("typed", F.lit(True))
    kind = F.when(F.col("id").startswith("P") | F.col("typed"), "full").otherwise("labels_only")
    return reduced.filter(F.col("id").rlike("^[PQ]")).select("id").join(wanted, "id", "left").select("id", kind.alias("kind"))


def restrict_three_way(claims: DataFrame, ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, kind, n_claims`` of the records that stay: ``full`` if wanted, ``reduced`` (type claims only) if they are connected.

    Connected are what wanted records refer to, types of all others, and records that refer to a wanted one.
    """
    wanted = wanted.select(F.col("id").alias("w")).distinct()
    of_wanted = claims.join(wanted, claims["subject"] == wanted["w"], "left_semi")
    of_others = claims.join(wanted, claims["subject"] == wanted["w"], "left_anti")
    into = of_others.join(wanted, of_others["object"] == wanted["w"], "left_semi")
    near = (
        of_wanted.select(F.col("property").alias("id")).unionByName(of_wanted.select(F.col("object").alias("id")))
        .unionByName(of_others.filter(F.col("property").isin(*TYPE_PROPERTIES)).select(F.col("object").alias("id")))
        .unionByName(into.select(F.col("property").alias("id"))).unionByName(into.select(F.col("subject").alias("id"))).distinct()
    )
    flags = ids.select("id").distinct().join(wanted.withColumn("full", F.lit(True)), F.col("id") == F.col("w"), "left").drop("w").join(near.withColumn("near", F.lit(True)), "id", "left")
    kept = flags.filter("full or near").select("id", F.when(F.col("full"), "full").otherwise("reduced").alias("kind"))
    counts = claims.groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("property").isin(*TYPE_PROPERTIES)).alias("n_types"))
    return kept.join(counts, "id", "left").select("id", "kind", F.coalesce(F.when(F.col("kind") == "full", F.col("n")).otherwise(F.col("n_types")), F.lit(0)).alias("n_claims"))


def class_nodes(claims: DataFrame) -> DataFrame:
    """``id, n_parents`` of all classes: subjects and objects of P279, and objects of P31 (leaves have no parents)."""
    up = claims.filter(F.col("property") == "P279")
    objects = claims.filter(F.col("property").isin("P31", "P279")).select(F.col("object").alias("id"), F.lit(None).cast("string").alias("parent"))
    return up.select(F.col("subject").alias("id"), F.col("object").alias("parent")).unionByName(objects).groupBy("id").agg(F.count_distinct("parent").alias("n_parents"))


def closure(edges: DataFrame) -> DataFrame:
    """``node, ancestor`` over all links ``child, parent``, each once, by doubling path lengths to a fixpoint.

    Cycles end: a pair is only ever added once; members of a cycle are their own ancestors. The number of rounds grows with
    the logarithm of the depth; each round joins the pairs with themselves on the middle node, cut to files.
    """
    pairs = cut(edges.filter((F.col("child") != "") & (F.col("parent") != "")).select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    n, before = pairs.count(), -1
    while n != before:
        more = pairs.join(pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further")), "ancestor").select("node", F.col("further").alias("ancestor"))
        grown = cut(pairs.unionByName(more).distinct())
        drop(pairs)
        pairs, before, n = grown, n, grown.count()
    return pairs


def extended_types(claims: DataFrame, superclasses: DataFrame) -> DataFrame:
    """``subject, type``: objects of the type properties and all their superclasses, once per claim."""
    typed = claims.filter(F.col("property").isin(*TYPE_PROPERTIES)).select("subject", "object")
    up = superclasses.select(F.col("node").alias("object"), F.col("ancestor").alias("type")).filter(F.col("object") != F.col("type"))
    return typed.select("subject", F.col("object").alias("type")).unionByName(typed.join(up, "object").select("subject", "type"))


def one_hop_types(claims: DataFrame, superclasses: DataFrame) -> DataFrame:
    """``id, type, n``: how often a record has a type, superclasses included."""
    return extended_types(claims, superclasses).groupBy(F.col("subject").alias("id"), "type").agg(F.count("*").alias("n"))


def two_hop_types(claims: DataFrame, one_hop: DataFrame) -> DataFrame:
    """``id, type, n``: the one-hop types of all records that a record's claims refer to, each record once."""
    near = claims.select(F.col("subject").alias("source"), F.col("object").alias("id")).distinct()
    return near.join(one_hop, "id").groupBy(F.col("source").alias("id"), "type").agg(F.sum("n").alias("n"))


def type_maps(hops: DataFrame, name: str) -> DataFrame:
    """One row per id with a map from type to count; a record's types are few, its map is bounded by them."""
    return hops.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias(name))


def popularity(kg: DataFrame, claims_column: str | None = None) -> DataFrame:
    """``id, num_claims, degree``: claims of a record, and their share of the largest number (0 if that is 0)."""
    n = F.coalesce("num_claims", F.lit(0))
    if claims_column:
        n = F.greatest(n, F.coalesce(F.size(claims_column), F.lit(0)))
    counts = kg.filter(F.col("id").isNotNull()).select("id", n.cast("long").alias("num_claims"))
    most = counts.agg(F.max("num_claims").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("id", "num_claims", F.when(F.col("most") > 0, F.col("num_claims") / F.col("most")).otherwise(0.0).alias("degree"))


def point_lookup(kg: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, label``: the record's label, or the id itself if there is none."""
    return wanted.select("id").distinct().join(kg.select("id", F.col("labels").alias("label")), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def type_indices(types: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``id, idx``: sorted, distinct positions (by type id, from 0) of a record's types in the vocabulary.

    The vocabulary is a fixed list of types (hundreds), held as one array that goes to all tasks.
    """
    order = vocabulary.agg(F.sort_array(F.collect_set("type")).alias("order"))
    at = types.select("id", "type").crossJoin(F.broadcast(order)).select("id", F.array_position("order", F.col("type")).alias("at")).filter("at > 0")
    return at.groupBy("id").agg(F.sort_array(F.collect_set(F.col("at") - 1)).alias("idx"))


def multi_hot(types: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``id, vec``: counts over the vocabulary's positions, clipped at 1, zeros included."""
    order = vocabulary.agg(F.sort_array(F.collect_set("type")).alias("order"))
    own = types.groupBy("id").agg(F.collect_set("type").alias("own"))
    return own.crossJoin(F.broadcast(order)).select("id", F.transform("order", lambda t: F.array_contains("own", t).cast("int")).alias("vec"))


def connected(claims: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, property, other``: the neighbours of wanted ids, in the direction of the claims."""
    return claims.join(wanted.select(F.col("id").alias("subject")).distinct(), "subject", "left_semi").select(F.col("subject").alias("id"), "property", F.col("object").alias("other"))
