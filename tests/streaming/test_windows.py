import datetime as dt

from tesserakg.sources.readers import ENTITY, stream
from tesserakg.streaming.windows import started, windowed_mentions

SCHEMA = f"docno long, ingested timestamp, entities {ENTITY}"


def test_stream_gives_the_table_s_counts(spark, tmp_path):
    day = dt.datetime(2020, 1, 1, 12)
    rows = [(i, None if i == 9 else day + dt.timedelta(days=i), [(None, 0, 1, "m", "Q1", None), (None, 2, 1, "n", None if i % 2 else "Q2", None)]) for i in range(10)] + [(50, day, None), (51, day, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    wanted = sorted(map(tuple, windowed_mentions(df).collect()))
    query = started(windowed_mentions(stream(spark, str(tmp_path / "in"), SCHEMA)), "counts", str(tmp_path / "ck"), "complete")
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == wanted and len(wanted) == 14
