"""Deeply nested records as an adjacency table of nodes, and entity tables pivoted from it.

Every repeated element (array element or map entry) becomes an object node; a struct inside an element is one to one
with it, so its scalars belong to the element under a dotted label. A node names its parent, so child tables keep their links.

Defined cases: null records, collections, elements and scalars yield no node; indexes count null elements; an empty
collection yields nothing; empty strings are scalars like others; repeated map keys are kept apart by their entry;
columns that are not asked for are ignored, whatever their names; a null key is a key of its own.
Rows that share a key are taken as copies of one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODE = "array<struct<node:string,parent:string,label:string,ordinal:int,scalar:string>>"


def _node(node: Column, parent: Column, label: Column, ordinal: Column, scalar: Column) -> Column:
    return F.struct(node.cast("string").alias("node"), parent.alias("parent"), label.cast("string").alias("label"), ordinal.cast("int").alias("ordinal"), scalar.cast("string").alias("scalar"))


def _none() -> Column:
    return F.array().cast(_NODE)


def _scalar(x: Column, owner: Column, label: Column) -> Column:
    return F.when(x.isNotNull(), F.array(_node(F.lit(None), owner, label, F.lit(0), x))).otherwise(_none())


def _element(x: Column, kind: T.DataType, path: Column, owner: Column, label: Column, ordinal: Column) -> Column:
    """An element of a collection: its own node, and what is below it."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        own = F.array(_node(path, owner, label, ordinal, F.lit(None)))
        return F.when(x.isNotNull(), F.concat(own, _below(x, kind, path, ""))).otherwise(_none())
    return F.when(x.isNotNull(), F.array(_node(path, owner, label, ordinal, x))).otherwise(_none())


def _collection(x: Column, kind: T.DataType, path: Column, owner: Column, label: Column) -> Column:
    """Elements of an array (ordinal = index) or entries of a map (label = key); arrays in a map are the key's elements."""
    at = lambda i: F.concat(path, F.lit("."), i.cast("string"))
    if isinstance(kind, T.ArrayType):
        parts = F.transform(x, lambda e, i: _element(e, kind.elementType, at(i), owner, label, i))
    else:

        def entry(e: Column, i: Column) -> Column:
            value, below = e["value"], kind.valueType
            if isinstance(below, T.ArrayType):
                return _collection(value, below, at(i), owner, e["key"])
            return _element(value, below, at(i), owner, e["key"], F.lit(0))

        parts = F.transform(F.map_entries(x), entry)
    return F.coalesce(F.flatten(parts), _none())


def _below(x: Column, kind: T.DataType, path: Column, prefix: str) -> Column:
    if not isinstance(kind, T.StructType):
        return _collection(x, kind, path, path, F.lit(prefix))
    parts = []
    for f in kind.fields:
        value, label = x[f.name], prefix + f.name
        if isinstance(f.dataType, T.StructType):
            parts.append(F.when(value.isNotNull(), _below(value, f.dataType, path, label + ".")).otherwise(_none()))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            parts.append(_collection(value, f.dataType, F.concat(path, F.lit("." + label)), path, F.lit(label)))
        else:
            parts.append(_scalar(value, path, F.lit(label)))
    return F.concat(*parts) if parts else _none()


def shred(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adjacency table ``key, node, parent, label, ordinal, scalar`` of the nested columns.

    An element's parent is the node that owns its collection; at the top that is the column's name. A scalar field has
    no node of its own (node is null). One pass over the rows without a shuffle.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in columns:
        kind, path = fields[c], F.lit(c)
        if isinstance(kind, (T.ArrayType, T.MapType)):
            parts.append(_collection(F.col(c), kind, path, path, path))
        elif isinstance(kind, T.StructType):
            parts.append(F.when(F.col(c).isNotNull(), _below(F.col(c), kind, path, "")).otherwise(_none()))
        else:
            parts.append(_scalar(F.col(c), F.lit(""), path))
    return df.select(F.col(key).alias("key"), F.explode(F.concat(*parts)).alias("n")).select("key", "n.*")


def elements(nodes: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Object nodes joined with their scalar children, pivoted: one row per element, a column per label asked for.

    An object node and its scalars share the key and the path of the element, so one grouping by both is the join and the
    pivot at once: a single pass over the adjacency table. Elements without any of the scalars keep a row of nulls.
    """
    own = F.col("node").isNotNull()
    wide = nodes.groupBy("key", F.coalesce("node", "parent").alias("node")).agg(
        F.max(F.when(own, F.struct("parent", "label", "ordinal"))).alias("object"),
        *(F.max(F.when(~own & (F.col("label") == label), F.col("scalar"))).alias(name) for label, name in labels.items()),
    )
    return wide.filter(F.col("object").isNotNull()).select("key", "node", "object.*", *labels.values())


def record_children(records: DataFrame, key: str = "line_no") -> DataFrame:
    """The children of knowledge-graph records: labels, aliases, claims and the qualifiers of claims.

    ``key, child_kind, child_name, pos, sub_pos, child_value``, distinct rows; see the module for nulls. The records are
    scanned once and shuffled once, whole, by their key: shredding, pivot, the way from a qualifier to its statement and the
    removal of copies then stay within the record's partition.
    """
    parts = ["labels", "aliases", "claims"]
    found = elements(
        shred(records.select(key, *parts).repartition(F.col(key)), key, parts),
        {"value": "text", "mainsnak.snaktype": "main_type", "mainsnak.datavalue.value.id": "main_id", "snaktype": "qual_type", "datavalue.value.id": "qual_id"},
    )
    # every element is one child at most; only qualifiers look beyond their own row
    is_text, is_claim, is_qual = F.col("parent").isin("labels", "aliases"), F.col("parent") == "claims", (F.col("label") == "qualifiers") & F.col("parent").startswith("claims.")
    group = Window.partitionBy("key", F.when(is_qual, F.col("parent")).otherwise(F.col("node")))
    owner = F.max(F.when(is_claim, F.struct("label", "ordinal"))).over(group)
    rows = found.filter(is_text | is_claim | is_qual).withColumn("owner", owner)
    item = lambda kind, value: (F.col(kind) == "value") & (F.col(value) != "")
    kind = F.when(is_text & (F.col("text") != ""), F.when(F.col("parent") == "labels", "label").otherwise("alias")).when(is_claim & item("main_type", "main_id"), "claim").when(is_qual & item("qual_type", "qual_id"), "qualifier")
    rows = rows.withColumn("child_kind", kind).filter(F.col("child_kind").isNotNull())
    at = lambda c: F.when(is_qual, F.col(f"owner.{c}")).otherwise(F.col(c))
    value = F.when(is_text, F.col("text")).when(is_claim, F.col("main_id")).otherwise(F.col("qual_id"))
    sub = F.when(is_qual, F.col("ordinal")).otherwise(F.lit(-1)).cast("int")
    return rows.select("key", "child_kind", at("label").alias("child_name"), at("ordinal").cast("int").alias("pos"), sub.alias("sub_pos"), value.alias("child_value")).distinct().withColumnRenamed("key", key)
