"""Writers. Columns are made as expressions; files are written by the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, compressed, as many files as partitions."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def nif_lines(m: DataFrame, base: str = "http://example.org/doc") -> DataFrame:
    """``docno, pos, turtle``: a phrase of the interchange format for each mention (``docno, pos, start, len, mention, qid, ookg``)."""
    stop = F.col("start") + F.col("len")
    quoted = F.regexp_replace(F.regexp_replace(F.coalesce("mention", F.lit("")), r"(\\|\")", r"\\$1"), r"\n", r"\\n")
    return m.select("docno", "pos", F.concat(
        F.format_string(f"<{base}%d#offset_%d_%d> a nif:Phrase ; nif:anchorOf \"", "docno", "start", stop), quoted,
        F.format_string("\" ; nif:beginIndex \"%d\"^^xsd:nonNegativeInteger ; nif:endIndex \"%d\"^^xsd:nonNegativeInteger ; ", "start", stop),
        F.lit("itsrdf:taIdentRef <http://www.wikidata.org/entity/"), F.coalesce("qid", F.lit("")), F.lit("> ; itsrdf:taMsClassRef <"), F.when(F.col("ookg"), "OutOfKG").otherwise("InKG"), F.lit("> ."),
    ).alias("turtle"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def evaluator_rows(labels: DataFrame) -> DataFrame:
    """Rows of the cluster evaluator's table: 0, two running numbers, label, 1.0 and MISC, for ``place`` and ``label``."""
    return labels.select(F.lit(0).alias("doc"), (2 * F.col("place")).alias("start"), (2 * F.col("place") + 1).alias("stop"), F.col("label").cast("string").alias("label"), F.lit(1.0).alias("score"), F.lit("MISC").alias("kind"))


def tab_separated(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def number(c: Column, digits: int = 3) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", c), F.lit("-"))


def booktabs(small: DataFrame, best: bool = True) -> str:
    """A small result table for typesetting: the first column names the rows, the best value of each other column is bold.

    The table is a report and small by its use; it is formatted on the driver.
    """
    rows = [tuple(r) for r in small.collect()]
    top = [max((r[k] for r in rows if isinstance(r[k], (int, float))), default=None) for k in range(len(small.columns))]
    show = lambda x, k: "-" if x is None else (f"\\textbf{{{x:.3f}}}" if best and x == top[k] else f"{x:.3f}") if isinstance(x, float) else str(x)
    lines = [" & ".join(show(x, k) for k, x in enumerate(r)) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{l" + "r" * (len(small.columns) - 1) + "}", r"\toprule", " & ".join(small.columns) + r" \\", r"\midrule", *lines, r"\bottomrule", r"\end{tabular}"])


def parameters(df: DataFrame, path: str) -> None:
    """A scorer's weights (``name, weight``) as a small table, in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)
