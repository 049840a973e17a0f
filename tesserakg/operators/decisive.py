"""Types that tell the right entity from its rivals.

Defined cases: entities without types have none to tell; mentions without rivals keep all their gold types; ties in
frequency go to the smaller type; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decisive_types(candidates: DataFrame, types: DataFrame) -> DataFrame:
    """``docno, pos, type``: types of the gold entity that no other candidate has (``docno, pos, gold, qid``; ``id, type``)."""
    own = candidates.select("docno", "pos", "gold").distinct().join(types.select(F.col("id").alias("gold"), "type"), "gold").select("docno", "pos", "type").distinct()
    rivals = candidates.filter((F.col("qid") != F.col("gold")) & F.col("qid").isNotNull()).select("docno", "pos", "qid").distinct()
    theirs = rivals.join(types.select(F.col("id").alias("qid"), "type"), "qid").select("docno", "pos", "type").distinct()
    return own.join(theirs, ["docno", "pos", "type"], "left_anti")


def type_frequencies(decisive: DataFrame) -> DataFrame:
    return decisive.groupBy("type").agg(F.count("*").alias("n"))


def top_types(decisive: DataFrame, most: int, least: int = 1) -> DataFrame:
    """``type, n``: the most frequent decisive types with at least ``least`` mentions; a report of fixed length."""
    return type_frequencies(decisive).filter(F.col("n") >= least).orderBy(F.desc("n"), "type").limit(most)


def greedy_cover(decisive: DataFrame, most: int) -> list[tuple[str, int]]:
    """Types chosen one by one, each the one that decides most of the mentions not yet decided, with their gain.

    ``most`` rounds of one grouped count; only the chosen type reaches the driver in a round.
    """
    from tesserakg.runtime import cut, drop

    left, out = cut(decisive), []
    for _ in range(most):
        best = type_frequencies(left).orderBy(F.desc("n"), "type").limit(1).collect()
        if not best:
            break
        out.append((best[0]["type"], best[0]["n"]))
        done = left.filter(F.col("type") == best[0]["type"]).select("docno", "pos").distinct()
        rest = cut(left.join(done, ["docno", "pos"], "left_anti"))
        drop(left)
        left = rest
    return out
