"""Readers. Lines that are not in the format are skipped where the reader says so; compression follows the file's ending.

Text files are read line by line as Spark splits them; readers that need an order number the lines within each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserakg.functions import text as X

VALUE = "struct<language:string,value:string>"
SNAK = "struct<snaktype:string,datatype:string,property:string,datavalue:struct<value:struct<id:string>>>"
#: Schema of one record of the raw dump; only the keys that are used.
RECORD = f"id string, labels map<string,{VALUE}>, descriptions map<string,{VALUE}>, aliases map<string,array<{VALUE}>>, claims map<string,array<struct<mainsnak:{SNAK},rank:string,qualifiers:array<{SNAK}>>>>, lastrevid long, modified string"
#: Schema of parsed records.
PARSED = "id string, labels string, descriptions string, aliases array<string>, claims array<array<string>>"


def dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Raw dump: a JSON array with one record per line, a comma at its end; other lines and malformed records are skipped.

    Compressed text can't be split, so ``partitions`` spreads the lines right after the scan.
    """
    lines = spark.read.text(path)
    if partitions:
        lines = lines.repartition(partitions)
    record = F.from_json(F.rtrim(F.regexp_replace("value", r",\s*$", "")), RECORD)
    return lines.filter(F.ltrim("value").startswith("{")).select(record.alias("r")).filter(F.col("r.id").isNotNull()).select("r.*")


def parsed(spark: SparkSession, path: str, schema: str = PARSED) -> DataFrame:
    """Parsed records, one JSON object per line."""
    return spark.read.schema(schema).json(path)


ENTITY = "array<struct<page_title:string,offset:int,length:int,mention:string,qid:string,out_of_kg:boolean>>"


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """Annotated texts in one JSON file: a list, a list of lists, or an object whose values are lists (``part`` names the key)."""
    row = f"struct<docid:string,text:string,date:string,entities:{ENTITY}>"
    whole = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", f"array<{row}>")
    nested = F.from_json("value", f"array<array<{row}>>")
    keyed = F.from_json("value", f"map<string,array<{row}>>")
    is_object, is_nested = F.ltrim("value").startswith("{"), F.col("value").rlike(r"^\s*\[\s*\[")
    parts = F.when(is_object, F.map_entries(keyed)).when(is_nested, F.array(F.struct(F.lit("").alias("key"), F.flatten(nested).alias("value")))).otherwise(F.array(F.struct(F.lit("").alias("key"), plain.alias("value"))))
    return whole.select(F.explode(parts).alias("p")).select(F.col("p.key").alias("part"), F.explode("p.value").alias("d")).select("part", "d.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line``: lines in order within each file (line breaks of all kinds); files are read whole."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return files.select("file", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line_no", "line"))


def token_table(spark: SparkSession, path: str, marker: str = "-DOCSTART-") -> DataFrame:
    """Token rows ``file, doc_no, line_no, token, tag, mention, title, url, page_id``; a blank line has null fields."""
    from tesserakg.operators.datasets import segments

    lines = segments(numbered_lines(spark, path), marker).filter(~F.col("line").startswith(marker))
    parts = F.split("line", "\t")
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return lines.select("file", "doc_no", "line_no", at(0).alias("token"), at(1).alias("tag"), at(2).alias("mention"), at(3).alias("title"), at(4).alias("url"), at(5).alias("page_id"))


def candidate_table(spark: SparkSession, path: str, empty: str = "EMPTYCAND") -> DataFrame:
    """``docid, mention, gold_index, candidates``: tab fields with ``GT:`` before the gold index, which is 1-based and -1 if there is none.

    A candidate is ``page id, prior, title``; the title may hold commas.
    """
    parts = F.split("value", "\t")
    gold = F.array_position("f", F.lit("GT:"))
    candidate = lambda c: F.struct(F.get(F.split(c, ",", 3), 0).alias("page_id"), F.get(F.split(c, ",", 3), 1).try_cast("double").alias("prior"), F.get(F.split(c, ",", 3), 2).alias("title"))
    rows = spark.read.text(path).select(parts.alias("f")).withColumn("g", gold).filter("g > 6")
    fields = F.filter(F.slice("f", F.lit(7), F.col("g") - 7), lambda c: (c != empty) & (c != "CANDIDATES") & (c != ""))
    index = F.get(F.split(F.get("f", F.col("g").cast("int")), ","), 0).try_cast("int")
    return rows.select(F.get("f", 0).alias("docid"), F.get("f", 2).alias("mention"), F.when(index >= 1, index - 1).alias("gold_index"), F.transform(fields, candidate).alias("candidates"))


def prior_table(spark: SparkSession, path: str) -> DataFrame:
    """``mention, total, page_id, prior, title`` of lines ``mention, total, id,prior,title ...``; what follows the last tab is no candidate."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(parts, 0).alias("mention"), F.get(parts, 1).try_cast("long").alias("total"), F.explode(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0)))).alias("c"))
    c = F.split("c", ",", 3)
    return rows.select("mention", "total", F.get(c, 0).alias("page_id"), F.get(c, 1).try_cast("double").alias("prior"), F.get(c, 2).alias("title"))


def means_table(spark: SparkSession, path: str) -> DataFrame:
    r"""``mention, names``: tab-separated pairs of a quoted mention and a name, ``\uXXXX`` read as characters."""
    pairs = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 2)
    clean = pairs.select(X.unicode_unescaped(F.regexp_replace(F.get("f", 0), '^"|"$', "")).alias("mention"), X.unicode_unescaped(F.get("f", 1)).alias("name"))
    return clean.groupBy("mention").agg(F.sort_array(F.collect_set("name")).alias("names"))


def triples(spark: SparkSession, path: str, predicate: str) -> DataFrame:
    """``subject, object`` of triple lines that name the predicate, angle brackets and the final dot taken off."""
    t = F.regexp_extract_all("value", F.lit(r"<[^>]*>|\"[^\"]*\"|[^\s<>\"]+"), F.lit(0))
    bare = lambda c: F.regexp_replace(c, r"^[<\"]|[>\"]$", "")
    rows = spark.read.text(path).filter(F.col("value").contains(predicate)).select(t.alias("t")).filter(F.size("t") >= 3)
    return rows.filter(F.get("t", 1).contains(predicate)).select(bare(F.get("t", 0)).alias("subject"), X.url_decoded(bare(F.get("t", 2))).alias("object"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Comma-separated values with a header."""
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def linked_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, section, text, offset, length, target``: pages with sections whose links lie in parallel arrays."""
    schema = "page_id long, sections array<struct<text:string,link_offsets:array<int>,link_lengths:array<int>,target_page_ids:array<long>>>"
    s = spark.read.schema(schema).json(path).select("page_id", F.posexplode("sections").alias("section", "s"))
    links = F.arrays_zip(F.col("s.link_offsets").alias("offset"), F.col("s.link_lengths").alias("length"), F.col("s.target_page_ids").alias("target"))
    return s.select("page_id", "section", F.col("s.text").alias("text"), F.explode(links).alias("l")).select("page_id", "section", "text", "l.offset", "l.length", "l.target")


def filtered_vectors(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Embedding rows (``qid, vec``) of wanted ids."""
    return vectors.join(wanted.select("qid").distinct(), "qid", "left_semi")


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, item, text, start, len, title, surface`` of the wiki links in the list items of HTML pages.

    An item's text is its own without nested lists; places count in that text. Null pages give nothing; broken HTML is read as
    far as it goes.
    """
    import pandas as pd
    from tesserakg.runtime import ship

    ship(pages.sparkSession)

    def run(frames):  # noqa: ANN001, ANN202
        from tesserakg.sources.html import item_links

        for pdf in frames:
            rows = [(p, *x) for p, h in zip(pdf["page_id"], pdf["html"]) if h for x in item_links(h)]
            yield pd.DataFrame(rows, columns=["page_id", "item", "text", "start", "len", "title", "surface"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, item int, text string, start int, len int, title string, surface string")


def mapped_titles(titles: DataFrame, normalised: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """``title, qid`` by the normalised title (``from_, to_``), then its redirect, then the page (``title, qid``)."""
    one = titles.join(normalised.select(F.col("from_").alias("title"), F.col("to_").alias("norm")), "title", "left").withColumn("norm", F.coalesce("norm", "title"))
    two = one.join(redirects.select(F.col("from_").alias("norm"), F.col("to_").alias("target")), "norm", "left").withColumn("target", F.coalesce("target", "norm"))
    return two.join(pages.select(F.col("title").alias("target"), "qid"), "target", "left").select("title", "qid")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Stored link results; an older name of the outside flag is read as well."""
    df = spark.read.json(path)
    if "_label_out_of_kg" in df.columns:
        df = df.withColumn("out_of_kg", F.coalesce(*([F.col("out_of_kg")] if "out_of_kg" in df.columns else []), F.col("_label_out_of_kg"))).drop("_label_out_of_kg")
    return df


def stream(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Annotated texts as a stream of JSON lines."""
    return spark.readStream.schema(schema).json(path)


def ordered(df: DataFrame, group: str, order: str) -> DataFrame:
    """Rows numbered from 0 within a group."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def parameters(spark: SparkSession, path: str) -> dict[str, float]:
    """A scorer's weights by name; as many rows as it has features."""
    return {r["name"]: r["weight"] for r in spark.read.schema("name string, weight double").json(path).collect()}
