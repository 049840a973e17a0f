"""Runs queries and their SQL side by side: python tests/compare.py [--sf DIR] [NAME...]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings parse_wikidata_dump kg_connector creation_dates wikievents_train le_titov_mention_mapping parsed_dump processed_mention mention_pairs eval_items".split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    return x


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[str], list[tuple]]:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            c.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    return names, [str(d[1]) for d in cur.description], cur.fetchall()


def compare(spark, name: str, f, sql: str | None, sf_dir: str) -> str:
    """Empty if both agree, else what differs."""
    df = f(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return ""
    names, kinds, other = sql_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if any("HUGEINT" in k or "DECIMAL" in k for k in kinds):
        return f"kinds {kinds}"
    order = [df.columns.index(n) for n in names]
    a = sorted((repr(plain(tuple(r[i] for i in order))) for r in rows))
    b = sorted(repr(plain(r)) for r in other)
    if a != b:
        x, y = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"{len(a)} and {len(b)} rows; only Spark {len(x)}: {x[:3]}; only SQL {len(y)}: {y[:3]}"
    return ""


def main() -> None:
    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if a != "--sf"]
    spark, sqls = session(), e.oracle_sql()
    bad = 0
    for name, f in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            said = compare(spark, name, f, sqls.get(name), sf)
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(said)
        print(f"{'FAIL' if said else 'ok' if name in sqls else 'ran'} {name} {time.time() - t:.1f}s {said}", flush=True)
    print("failures:", bad)
    os._exit(bool(bad))


if __name__ == "__main__":
    main()
