"""Quality of links and clusters in closed form: everything is a few grouped counts and one small row.

Decisions have ``gold, ookg`` (gold side) and ``link, pred_ookg`` (predicted side). Defined cases: rows without gold id are
left out by the caller; divisions by zero give 0 where the formula says so and null otherwise; empty populations give nulls.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakg.runtime import map_arrow


def _r(c: Column) -> Column:
    return F.round(c, 6)


def f_measure(p: Column, r: Column) -> Column:
    """Harmonic mean, 0 where both are 0."""
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _share(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def linking_stats(decisions: DataFrame) -> DataFrame:
    """One row of detection and linking counts and rates; ``decisions`` also has ``n_candidates, in_candidates``."""
    ok = F.col("ookg") == F.col("pred_ookg")
    c = F.count_if
    s = decisions.agg(
        F.count("*").alias("count_all"), c(~F.col("ookg")).alias("count_in_kg"), c("ookg").alias("count_ookg"),
        F.count_distinct(F.when(~F.col("ookg"), F.col("gold"))).alias("count_unique_in_kg"), F.count_distinct(F.when(F.col("ookg"), F.col("gold"))).alias("count_unique_ookg"),
        c(ok & F.col("ookg")).alias("correct_ookg"), c(~ok & F.col("ookg")).alias("incorrect_ookg"), c(ok & ~F.col("ookg")).alias("correct_non_ookg"), c(~ok & ~F.col("ookg")).alias("incorrect_non_ookg"),
        c(ok & ~F.col("ookg") & (F.col("link") == F.col("gold"))).alias("linked"),
        c((F.col("n_candidates") == 0) & ~F.col("ookg")).alias("no_candidates_in_kg"), c((F.col("n_candidates") == 0) & F.col("ookg")).alias("no_candidates_ookg"), c("in_candidates").alias("in_candidate_set"),
    )
    col = F.col
    p, r = _share(col("linked"), col("correct_non_ookg") + col("incorrect_ookg")), _share(col("linked"), col("count_in_kg"))
    a, b = _share(col("correct_non_ookg"), col("count_in_kg")), _share(col("correct_ookg"), col("count_ookg"))
    return s.select(
        "*", _r(p).alias("precision_in_kg"), _r(r).alias("recall_in_kg"), _r(f_measure(p, r)).alias("f1_in_kg"), _r(a).alias("in_kg_accuracy"), _r(b).alias("ookg_accuracy"),
        _r(_share(col("correct_ookg"), col("correct_ookg") + col("count_in_kg") - col("correct_non_ookg"))).alias("ookg_precision"), _r(f_measure(a, b)).alias("identification_f1"),
        _r(_share(col("in_candidate_set"), col("count_in_kg"))).alias("gold_recall"), _r(_share(col("in_candidate_set"), col("count_all"))).alias("gold_recall_all"),
    )


def contingency(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``gold, pred, n`` (and ``by``): how often both labels meet; the only pass over the rows."""
    by = by or []
    return rows.filter(F.col("gold").isNotNull() & F.col("pred").isNotNull()).groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))


def cluster_metrics(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pair confusion, ARI, NMI (arithmetic), their harmonic mean, B-cubed and MUC of a contingency table, per ``by``."""
    by = by or ["population"]
    t = table if set(by) <= set(table.columns) else table.withColumn("population", F.lit("all"))
    d = lambda c: F.col(c).cast("double")
    a = t.groupBy(*by, "gold").agg(F.sum("n").alias("a"), F.count("*").alias("parts"))
    b = t.groupBy(*by, "pred").agg(F.sum("n").alias("b"), F.count("*").alias("parts"))
    total = t.groupBy(*by).agg(F.sum("n").alias("total"))
    gold = a.join(F.broadcast(total), by).groupBy(*by).agg(F.sum(d("a") * d("a")).alias("aa"), (-F.sum(d("a") / d("total") * F.log(d("a") / d("total")))).alias("h_gold"), F.sum(F.col("a") - F.col("parts")).alias("muc_r"), F.sum(F.col("a") - 1).alias("muc_rd"), F.count("*").alias("n_gold"))
    pred = b.join(F.broadcast(total), by).groupBy(*by).agg(F.sum(d("b") * d("b")).alias("bb"), (-F.sum(d("b") / d("total") * F.log(d("b") / d("total")))).alias("h_pred"), F.sum(F.col("b") - F.col("parts")).alias("muc_p"), F.sum(F.col("b") - 1).alias("muc_pd"), F.count("*").alias("n_pred"))
    cells = t.join(a.select(*by, "gold", "a"), [*by, "gold"]).join(b.select(*by, "pred", "b"), [*by, "pred"]).join(F.broadcast(total), by)
    inner = cells.groupBy(*by).agg(F.first("total").alias("total"), F.sum(d("n") * d("n")).alias("nn"), F.sum(d("n") / d("total") * F.log(d("total") * d("n") / (d("a") * d("b")))).alias("mi"), F.sum(d("n") * d("n") / d("b")).alias("b3p"), F.sum(d("n") * d("n") / d("a")).alias("b3r"))
    s = inner.join(gold, by).join(pred, by)
    col = F.col
    tp, fp, fn = col("nn") - col("total"), col("bb") - col("nn"), col("aa") - col("nn")
    tn = col("total") * col("total") - fp - fn - col("nn")
    s = s.withColumn("tp", tp).withColumn("fp", fp).withColumn("fn", fn).withColumn("tn", tn)
    bottom = (col("tp") + col("fn")) * (col("fn") + col("tn")) + (col("tp") + col("fp")) * (col("fp") + col("tn"))
    ari = F.when((col("fn") == 0) & (col("fp") == 0), 1.0).otherwise(2 * (col("tp") * col("tn") - col("fn") * col("fp")) / F.nullif(bottom, F.lit(0.0)))
    nmi = F.when((col("n_gold") == 1) & (col("n_pred") == 1), 1.0).otherwise(col("mi") / F.nullif((col("h_gold") + col("h_pred")) / 2, F.lit(0.0)))
    s = s.withColumn("ari", ari).withColumn("nmi", nmi)
    p3, r3 = col("b3p") / col("total"), col("b3r") / col("total")
    mp, mr = _share(col("muc_p"), col("muc_pd")), _share(col("muc_r"), col("muc_rd"))
    return s.select(
        *by, F.col("total").alias("n_rows"), "n_gold", "n_pred", *(col(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")), _r(col("ari")).alias("ari"), _r(col("nmi")).alias("nmi"),
        _r(F.when(col("ari") + col("nmi") > 0, 2 * col("ari") * col("nmi") / (col("ari") + col("nmi"))).otherwise(0.0)).alias("ari_nmi_f1"),
        _r(p3).alias("b3_precision"), _r(r3).alias("b3_recall"), _r(f_measure(p3, r3)).alias("b3_f1"), _r(mp).alias("muc_precision"), _r(mr).alias("muc_recall"), _r(f_measure(mp, mr)).alias("muc_f1"),
    )


def populations(decisions: DataFrame) -> DataFrame:
    """``population, gold, pred`` of six selections; predicted entities and clusters are kept apart by a prefix."""
    pred = F.when(F.col("pred_ookg"), F.concat(F.lit("c:"), F.col("cluster"))).otherwise(F.concat(F.lit("e:"), F.col("link")))
    names = F.array_compact(F.array(
        F.lit("all"), F.when(~F.col("ookg"), F.lit("inkg")), F.when(F.col("ookg"), F.lit("ookg")), F.when(F.col("pred_ookg"), F.lit("all_ookg_detected")),
        F.when(F.col("pred_ookg") & F.col("ookg"), F.lit("all_ookg_detected_only_ookg")), F.when(F.col("pred_ookg") & ~F.col("ookg"), F.lit("all_ookg_detected_only_inkg")),
    ))
    return decisions.select(F.explode(names).alias("population"), "gold", pred.alias("pred"))


def assign(weights: list[list[float]]) -> list[int]:
    """Row to column of the heaviest assignment (shortest augmenting paths with potentials); -1 for rows left over."""
    n, m = len(weights), len(weights[0]) if weights else 0
    if n > m:
        back = assign([list(c) for c in zip(*weights)])
        out = [-1] * n
        for column, row in enumerate(back):
            if row >= 0:
                out[row] = column
        return out
    top = max((x for row in weights for x in row), default=0.0)
    u, v, of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], at = i, 0
        best, came, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[at], row, delta, then = True, of[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    c = top - weights[row - 1][j - 1] - u[row] - v[j]
                    if c < best[j]:
                        best[j], came[j] = c, at
                    if best[j] < delta:
                        delta, then = best[j], j
            for j in range(m + 1):
                if done[j]:
                    u[of[j]] += delta
                    v[j] -= delta
                else:
                    best[j] -= delta
            at = then
            if of[at] == 0:
                break
        while at:
            of[at], at = of[came[at]], came[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if of[j]:
            out[of[j] - 1] = j - 1
    return out


def assign_cells(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Places of the cells of the heaviest one-to-one assignment; only pairs that meet have a cell, all weights are positive.

    As ``assign``, over cells instead of a matrix: memory follows the cells. Each row left over by a greedy start looks for the
    shortest path (Dijkstra) to a free column or to a row that had better stay without one; blocks may lie side by side.
    """
    if len(rows) == 0:
        return np.zeros(0, dtype=np.int64)
    if rows.max() > columns.max():
        rows, columns = columns, rows
    order = np.argsort(rows, kind="stable")
    n, m = int(rows.max()) + 1, int(columns.max()) + 1
    start = np.searchsorted(rows[order], np.arange(n + 1)).tolist()
    row_of, column_of, weight = rows[order].tolist(), columns[order].tolist(), weights[order].tolist()
    # prices with u + v >= weight, equal for chosen cells; free columns have v = 0, rows left over u = 0
    u = [max(weight[start[i] : start[i + 1]], default=0) for i in range(n)]
    v, by_row, by_column = [0] * m, [-1] * n, [-1] * m
    for i in range(n):
        for e in range(start[i], start[i + 1]):
            if weight[e] == u[i] and by_column[column_of[e]] < 0:
                by_row[i] = by_column[column_of[e]] = e
                break
    for i in range(n):
        if by_row[i] >= 0 or u[i] <= 0:
            continue
        best, end_row, end = u[i], i, -1
        far, came, done, heap, seen = {}, {}, {}, [], [(i, 0)]
        row, at = i, 0
        while True:
            for e in range(start[row], start[row + 1]):
                j = column_of[e]
                if j in done:
                    continue
                d = max(at, at + u[row] + v[j] - weight[e])
                if d < best and d < far.get(j, best):
                    far[j], came[j] = d, e
                    if by_column[j] < 0:
                        best, end_row, end = d, -1, j
                    else:
                        heapq.heappush(heap, (d, j))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            at, j = heapq.heappop(heap)
            done[j], row = at, row_of[by_column[j]]
            seen.append((row, at))
            if at + u[row] < best:
                best, end_row, end = at + u[row], row, j
        for k, d in seen:
            u[k] -= best - d
        for j, d in done.items():
            v[j] += best - d
        if end_row >= 0:
            u[end_row], by_row[end_row] = 0, -1
        while end >= 0:
            e = came[end]
            k, before = row_of[e], by_row[row_of[e]]
            by_row[k] = by_column[end] = e
            end = -1 if k == i else column_of[before]
    return np.sort(order[[e for e in by_row if e >= 0]])


def assignments(table: DataFrame, components, weight: Column | None = None) -> DataFrame:  # noqa: ANN001
    """``gold, pred, n, w`` of the heaviest one-to-one assignment of a contingency table; pairs that never meet are left out.

    The table is split into connected blocks first (``components`` of clustering). Blocks are dealt out to tasks, and each task
    solves its own at once; a block is never split, so a task holds the cells of the largest block, but no matrix.
    """
    cells = table.select("gold", "pred", "n", (F.col("n").cast("double") if weight is None else weight).alias("w"))
    edges = cells.select(F.concat(F.lit("g:"), "gold").alias("a"), F.concat(F.lit("p:"), "pred").alias("b"))
    block = components(edges).select(F.col("node").alias("g"), F.col("root").alias("block"))
    tagged = cells.withColumn("g", F.concat(F.lit("g:"), "gold")).join(block, "g").drop("g")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tesserakg.operators.metrics import assign_cells as best

        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            code = lambda c: rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
            yield from rows.take(pa.array(best(code("gold"), code("pred"), rows.column("w").to_numpy()))).to_batches()

    return map_arrow(tagged.repartition("block").select("gold", "pred", "n", "w"), solve, "gold string, pred string, n long, w double")


def ceaf(table: DataFrame, components) -> DataFrame:  # noqa: ANN001
    """One row: mention CEAF, and entity CEAF (weights 2n/(a+b); precision by predicted, recall by gold clusters)."""
    a, b = table.groupBy("gold").agg(F.sum("n").alias("a")), table.groupBy("pred").agg(F.sum("n").alias("b"))
    wide = table.join(a, "gold").join(b, "pred")
    m = assignments(table, components).agg(F.sum("n").alias("m"))
    e = assignments(wide, components, 2 * F.col("n") / (F.col("a") + F.col("b"))).agg(F.sum("w").alias("e"))
    s = table.agg(F.sum("n").alias("total"), F.count_distinct("gold").alias("n_gold"), F.count_distinct("pred").alias("n_pred")).crossJoin(m).crossJoin(e)
    p, r = F.try_divide("e", "n_pred"), F.try_divide("e", "n_gold")
    return s.select(_r(F.try_divide("m", "total")).alias("ceaf_m"), _r(p).alias("ceaf_e_precision"), _r(r).alias("ceaf_e_recall"), _r(f_measure(p, r)).alias("ceaf_e_f1"))


def ookg_prf(decisions: DataFrame, components) -> DataFrame:  # noqa: ANN001
    """One row: precision, recall and F of clusters outside the graph under the heaviest assignment of entities to clusters."""
    detected = decisions.filter("pred_ookg").select(F.col("cluster").alias("pred"), "gold", "ookg")
    table = detected.filter("ookg").groupBy("gold", "pred").agg(F.count("*").alias("n"))
    tp = assignments(table, components).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tp"))
    s = decisions.agg(F.count_if("pred_ookg").alias("n_detected"), F.count_if(F.col("ookg") & ~F.col("pred_ookg")).alias("fn")).crossJoin(tp)
    p, r = _share(F.col("tp"), F.col("n_detected")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("tp", (F.col("n_detected") - F.col("tp")).alias("fp"), "fn", _r(p).alias("precision"), _r(r).alias("recall"), _r(f_measure(p, r)).alias("f1"))


def sweep(rows: DataFrame) -> DataFrame:
    """``score, n_kept, precision, accuracy`` for every score as threshold: rows of a higher score are kept.

    ``score, correct``: counted per score first, so equal scores share a point and the running sums cover distinct scores.
    """
    points = rows.filter(F.col("score").isNotNull()).groupBy("score").agg(F.count("*").alias("n"), F.count_if("correct").alias("good"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    total = points.agg(F.sum("n").alias("total"), F.sum("good").alias("all_good"))
    run = points.select("score", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_kept"), F.coalesce(F.sum("good").over(w), F.lit(0)).alias("good"))
    # accuracy: kept ones that are right, and dropped ones that are wrong
    right = F.col("good") + (F.col("total") - F.col("n_kept")) - (F.col("all_good") - F.col("good"))
    return run.crossJoin(F.broadcast(total)).select("score", "n_kept", _r(F.try_divide("good", "n_kept")).alias("precision"), _r(right / F.col("total")).alias("accuracy"))


def mean_std(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``group, n, mean, std``: mean and population deviation."""
    return rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), _r(F.avg(value)).alias("mean"), _r(F.stddev_pop(value)).alias("std"))


def differing(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n_values`` of the keys that have more than one distinct value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter(F.col("n_values") > 1)


def two_best(rows: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """``group, best, second``: the names of the highest and second highest value (ties: smaller name)."""
    order = Window.partitionBy(group).orderBy(F.desc(value), name)
    placed = rows.filter(F.col(value).isNotNull()).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2)
    return placed.groupBy(group).agg(F.max(F.when(F.col("place") == 1, F.col(name))).alias("best"), F.max(F.when(F.col("place") == 2, F.col(name))).alias("second"))


def position_agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: how far the links of another service agree, compared by document and place (``docno, pos, link``).

    Places that only one side has count as missing on the other; null links count as outside the graph.
    """
    both = ours.select("docno", "pos", F.col("link").alias("a"), F.lit(True).alias("in_a")).join(theirs.select("docno", "pos", F.col("link").alias("b"), F.lit(True).alias("in_b")), ["docno", "pos"], "full")
    met = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    s = both.agg(F.count_if(met).alias("n_both"), F.count_if(F.col("in_b").isNull()).alias("n_only_ours"), F.count_if(F.col("in_a").isNull()).alias("n_only_theirs"), F.count_if(met & F.col("a").eqNullSafe(F.col("b"))).alias("n_equal"), F.count_if(met & F.col("a").isNull() & F.col("b").isNull()).alias("n_both_outside"))
    return s.select("*", _r(_share(F.col("n_equal"), F.col("n_both"))).alias("agreement"))


def mean_over_chunks(rows: DataFrame, chunk: str, value: str) -> DataFrame:
    """One row: mean of the chunks' means, so that chunks of any size count alike."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(chunk).agg(F.avg(value).alias("m"))
    return per.agg(F.count("*").alias("n_chunks"), _r(F.avg("m")).alias("mean"))
