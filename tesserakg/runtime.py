"""Reading tables, cutting lineage and skew-aware joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds more than one row in HEAVY_SHARE; hence at most HEAVY_SHARE keys are heavy, whatever the size.
HEAVY_SHARE = 1000


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that executors need no copy of it."""
    sc = spark.sparkContext
    if getattr(sc, "_tesserakg_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="package-")  # the driver serves the file from here to all executors
    atexit.register(shutil.rmtree, folder, True)
    name = str(Path(folder, "tesserakg_package.zip"))
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(name)
    sc._tesserakg_shipped = True


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> tuple[str, object]:
    """This session's own folder below the shared checkpoint folder, and its file system."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))
    folder = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir(), "written")
    return folder.toString(), folder.getFileSystem(sc._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet to the shared checkpoint folder and read from there.

    Later steps neither recompute them nor depend on executors, and their sizes come from the files, so that estimates
    don't grow from round to round. The folder is the cluster's ``spark.checkpoint.dir``; a private one is set only where
    none is on a single machine (tests). Files go with ``drop``, the rest when the driver ends.
    """
    spark = df.sparkSession
    folder, fs = _shared(spark)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs.deleteOnExit(jvm_path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the files behind frames made by ``cut`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def heavy_keys(df: DataFrame, key: str, share: int = HEAVY_SHARE) -> DataFrame:
    """Keys that hold more than 1/share of the rows: at most ``share`` rows, so always small enough to broadcast."""
    counts = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNotNull())
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.col("n") * share > F.col("total")).select(key)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = HEAVY_SHARE) -> DataFrame:
    """Equi-join of many rows with a table that has at most one row per key, split by the weight of the keys.

    Heavy keys of ``left`` (at most ``share``) meet their rows of ``right`` by broadcast and stay where they are;
    the remaining keys are shuffled, with no key above 1/share of the rows. ``how`` is inner or left.
    """
    heavy = heavy_keys(left, key, share)
    tagged = left.join(F.broadcast(heavy.withColumn("heavy_", F.lit(True))), key, "left")
    few = right.join(F.broadcast(heavy), key, "left_semi")
    hot = tagged.filter("heavy_").drop("heavy_").join(F.broadcast(few), key, how)
    rest = tagged.filter("heavy_ is null").drop("heavy_").join(right, key, how)
    return hot.unionByName(rest)


def item_id(col: Column) -> Column:
    """The letter Q and its number, however written (case, prefix, blanks, leading zeros); null if it is no such id."""
    number = F.regexp_extract(col, r"(?:^|[^A-Za-z0-9])[Qq]\s*0*([0-9]+)\s*$", 1)
    return F.when(number != "", F.concat(F.lit("Q"), number))


def iso_day(col: Column) -> Column:
    """The day of ``yyyy-MM-ddTHH:mm:ssZ``; null if it is none."""
    return F.when(col.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), F.substring(col, 1, 10).try_cast("date"))


def each_group(df: DataFrame, key: str, order: list[str], f: Callable, schema: str) -> DataFrame:
    """Rows of ``f(key, rows)`` for the ordered rows of every key, for steps that depend on the one before.

    Keys are shuffled once and come in order, so a task holds one group at a time and no frame is made per group. Groups must
    be small by their nature (the mentions of a document). ``rows`` are tuples in the order of the columns.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    at, arrow = df.columns.index(key), to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):  # noqa: ANN001, ANN202
        held, current, out = [], None, []

        def batch_of(rows):  # noqa: ANN001, ANN202
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x.type) for k, x in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[at] != current:
                    out += f(current, held)
                    held = []
                current = row[at]
                held.append(row)
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        if held:
            out += f(current, held)
        yield batch_of(out)

    return map_arrow(df.repartition(key).sortWithinPartitions(key, *order), run, schema)
