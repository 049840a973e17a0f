import random
from itertools import permutations

import numpy as np
import pytest

from tesserakg.operators import metrics as M
from tesserakg.operators.clustering import components


def test_assignment_against_all_permutations():
    r = random.Random(1)
    for _ in range(60):
        n, m = r.randint(1, 5), r.randint(1, 5)
        w = [[r.randrange(6) for _ in range(m)] for _ in range(n)]
        match = M.assign(w)
        assert len({j for j in match if j >= 0}) == sum(j >= 0 for j in match) == min(n, m)
        got = sum(w[i][j] for i, j in enumerate(match) if j >= 0)
        wide = w if n <= m else [list(c) for c in zip(*w)]
        assert got == max(sum(wide[i][p[i]] for i in range(len(wide))) for p in permutations(range(len(wide[0])), len(wide)))
    assert M.assign([]) == []


def test_sparse_assignment_against_the_dense_one():
    r = random.Random(2)
    for k in range(300):
        n, m = r.randint(1, 9), r.randint(1, 9)
        cells = {(r.randrange(n), r.randrange(m)): r.choice([1, 2, 3, 7]) if k % 2 else r.uniform(0.1, 1) for _ in range(r.randint(1, 30))}
        rows, columns, w = (np.array(x) for x in zip(*((i, j, x) for (i, j), x in cells.items())))
        kept = M.assign_cells(rows, columns, w)
        assert len(set(rows[kept])) == len(set(columns[kept])) == len(kept)
        dense = [[cells.get((i, j), 0) for j in range(m)] for i in range(n)]
        assert w[kept].sum() == pytest.approx(sum(dense[i][j] for i, j in enumerate(M.assign(dense)) if j >= 0))


def test_a_block_is_no_matrix(spark):
    """One gold id that meets 6,000 clusters ties all of them to one block; its matrix would have 36 million places."""
    rows = [("all", f"p{i}", 1) for i in range(6000)] + [(f"g{i}", f"p{i}", 2) for i in range(1, 6000)]
    got = M.assignments(spark.createDataFrame(rows, "gold string, pred string, n long"), components).groupBy("n").count()
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 5999)]


LABELS = {"perfect": ("aabbc", "xxyyz"), "singles": ("aabbc", "12345"), "one": ("aabbc", "11111"), "mixed": ("aaabbbccd", "112223331")}


@pytest.mark.parametrize("name", LABELS)
def test_closed_forms_against_pairs(spark, name):
    gold, pred = LABELS[name]
    n = len(gold)
    rows = spark.createDataFrame(list(zip(gold, pred)), "gold string, pred string")
    got = M.cluster_metrics(M.contingency(rows)).first()
    same = [(gold[i] == gold[j], pred[i] == pred[j]) for i in range(n) for j in range(n) if i != j]
    assert (got.tp, got.fp, got.fn, got.tn) == tuple(sum(s == k for s in same) for k in [(True, True), (False, True), (True, False), (False, False)])
    b3 = [(sum(gold[i] == gold[j] and pred[i] == pred[j] for j in range(n)) / sum(x[i] == x[j] for j in range(n))) for x in (pred, gold) for i in range(n)]
    assert got.b3_precision == pytest.approx(sum(b3[:n]) / n, abs=1e-6) and got.b3_recall == pytest.approx(sum(b3[n:]) / n, abs=1e-6)
    if name == "perfect":
        assert (got.ari, got.nmi, got.muc_f1) == (1.0, 1.0, 1.0)
    if name == "singles":
        assert (got.ari, got.muc_recall, got.muc_f1) == (0.0, 0.0, 0.0)
    if name == "one":
        assert got.ari == 0.0 and got.nmi == 0.0 and got.muc_recall == 1.0


def test_ceaf_and_outside_scores(spark):
    rows = spark.createDataFrame(list(zip("aaabbbccd", "112223331")), "gold string, pred string")
    got = M.ceaf(M.contingency(rows), components).first()
    assert got.ceaf_m == pytest.approx(6 / 9, abs=1e-6)  # a-1, b-2, c-3: two each
    assert got.ceaf_e_precision == pytest.approx((2 * 2 / 6 + 2 * 2 / 6 + 2 * 2 / 5) / 3, abs=1e-6)
    decisions = [("e1", True, True, "x"), ("e1", True, True, "x"), ("e2", True, True, "x"), ("e2", True, True, "y"), ("k1", False, True, "z"), ("e3", True, False, None)]
    s = M.ookg_prf(spark.createDataFrame(decisions, "gold string, ookg boolean, pred_ookg boolean, cluster string"), components).first()
    assert (s.tp, s.fp, s.fn) == (3, 2, 1) and s.precision == 0.6 and s.recall == 0.75


def test_empty_population(spark):
    rows = spark.createDataFrame([], "gold string, pred string")
    assert M.cluster_metrics(M.contingency(rows)).collect() == []
    assert M.ceaf(M.contingency(rows), components).first().ceaf_m is None


def test_sweep_and_two_best(spark):
    rows = spark.createDataFrame([(0.9, True), (0.9, False), (0.5, True), (0.1, False), (None, True)], "score double, correct boolean")
    assert sorted(map(tuple, M.sweep(rows).collect())) == [(0.1, 3, 0.666667, 0.75), (0.5, 2, 0.5, 0.5), (0.9, 0, None, 0.5)]
    best = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0), ("g", "c", 0.5), ("h", "z", 0.1), ("h", "y", None)], "g string, name string, v double")
    assert sorted(map(tuple, M.two_best(best, "g", "name", "v").collect())) == [("g", "a", "b"), ("h", "z", None)]
