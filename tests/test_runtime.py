import os

import pytest
from pyspark.sql import functions as F

from tesserakg.runtime import cut, drop, heavy_keys, iso_day, item_id, skew_join


def test_size_estimates_stay_bounded(spark):
    """Sizes come from the files, however often a table is joined with itself and cut."""
    df = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    for _ in range(20):
        df = cut(df.join(df.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("a", F.coalesce("c", "b").alias("b")).distinct())
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**7
    assert df.count() == 50


def test_dropped_files_are_gone(spark):
    df = cut(spark.range(3))
    path = df._cut_path.removeprefix("file:")
    assert os.path.isdir(path)
    drop(df, spark.range(1))
    assert not os.path.exists(path)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_join(spark, how):
    left = spark.createDataFrame([(i % 7 if i % 3 else 99, i) for i in range(300)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in (0, 1, 2, 99, 100)], "k long, w string")
    key = lambda x: (x[0] is None, *map(str, x))
    got = sorted((tuple(x) for x in skew_join(left, right, "k", how, share=4).select("k", "v", "w").collect()), key=key)
    assert got == sorted((tuple(x) for x in left.join(right, "k", how).select("k", "v", "w").collect()), key=key)
    assert [x.k for x in heavy_keys(left, "k", 4).collect()] == [99]


def test_ids_and_days(spark):
    df = spark.createDataFrame([("Q1",), ("q 007",), ("http://x/Q12 ",), ("Q",), ("XQ1",), (None,), ("P3",)], "x string")
    assert [r[0] for r in df.select(item_id(F.col("x"))).collect()] == ["Q1", "Q7", "Q12", None, None, None, None]
    days = spark.createDataFrame([("2010-02-03T04:05:06Z",), ("2010-02-31T00:00:00Z",), ("2010-02-03",), (None,)], "x string")
    assert [str(r[0]) for r in days.select(iso_day(F.col("x"))).collect()] == ["2010-02-03", "None", "None", "None"]
