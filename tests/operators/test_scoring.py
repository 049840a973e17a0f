import math

import pytest

from tesserakg.operators import scoring as S

SCHEMA = "docno long, pos int, gold string, ookg boolean, rank int, qid string, score double, types array<string>"


def candidates(spark):
    rows = [(1, 0, "A", False, 0, "A", 0.9, ["x"]), (1, 0, "A", False, 1, "B", 0.8, ["y", "z"]), (1, 1, "C", False, 0, "D", 0.5, ["x"]), (1, 1, "C", False, 1, "C", 0.5, ["y"]), (1, 2, "E", True, None, None, None, None), (2, 0, "A", False, 0, "A", 0.1, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_best_candidate_and_outside(spark):
    got = {(r.docno, r.pos): (r.link, r.pred_ookg) for r in S.links(candidates(spark)).collect()}
    assert got == {(1, 0): ("A", False), (1, 1): ("D", False), (1, 2): (None, True), (2, 0): ("A", False)}
    got = {(r.docno, r.pos): r.link for r in S.links(candidates(spark), (0.0, 0.3)).collect()}
    assert got[2, 0] is None and got[1, 0] == "A"


def test_beam_without_context_is_the_best_candidate(spark):
    links = {(r.docno, r.pos): r.link for r in S.links(candidates(spark)).collect()}
    assert {(r.docno, r.pos): r.link for r in S.beam_links(candidates(spark)).collect()} == links
    assert {(r.docno, r.pos): r.link for r in S.beam_links(candidates(spark), 10).collect()} == links


def test_beam_with_context_against_all_ways(spark):
    """A wide beam finds the way of the highest sum, where context counts the types that linked entities share."""
    got = {r.pos: r.link for r in S.beam_links(candidates(spark), 10, 5, 1.0).collect() if r.docno == 1}
    options = {0: [("A", 0.9, {"x"}), ("B", 0.8, {"y", "z"})], 1: [("D", 0.5, {"x"}), ("C", 0.5, {"y"})]}
    best = max((a[1] + b[1] + len(a[2] & b[2]) / len(a[2]), a[0], b[0]) for a in options[0] for b in options[1])
    assert (got[0], got[1], got[2]) == (best[1], best[2], None)
    assert S.type_context([{"x"}, set()], {"x"}) == 1.0 and S.type_context([], {"x"}) == 0.0


def test_pooled_and_mixed_vectors(spark):
    tokens = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(5)], "docno long, tok int, vec array<double>")
    spans = spark.createDataFrame([(1, 0, 1, 3)], "docno long, pos int, first int, last int")
    assert S.pooled(tokens, spans, 2).first().vec == [2.0, 1.0]
    rows = spark.createDataFrame([([1.0, 0.0], [[0.0, 2.0], [0.0, 4.0]]), ([1.0, 0.0], [])], "vec array<double>, context array<array<double>>")
    assert [r.mixed for r in S.context_mixed(rows).collect()] == [[0.0, 3.0], [0.0, 0.0]]


def test_losses_and_scorers(spark):
    loss = S.link_loss(candidates(spark).drop("types"), 1.0).first()
    one = math.log(1 + math.exp(-0.1))
    assert loss.n == 3 and loss.loss == pytest.approx((one + math.log(2) + 0.0) / 3, abs=1e-6)
    pairs = spark.createDataFrame([(0.5, True), (0.5, False), (2.0, False), (None, True)], "distance double, same boolean")
    assert S.pair_loss(pairs).first().loss == pytest.approx(0.5 / 3, abs=1e-6)
    probs = S.type_predictions(spark.createDataFrame([([1.0, 2.0],)], "vec array<double>"), [[1.0, 0.0], [0.0, -1.0]], [0.0, 2.0]).first().probs
    assert probs == pytest.approx([1 / (1 + math.exp(-1)), 0.5])
    df = spark.createDataFrame([("mention", 0.3, 0.7, 2.0, 0.5), ("entity", 0.3, 0.7, 2.0, None)], "kind string, cos double, edit double, dist double, degree double")
    from pyspark.sql import functions as F

    got = df.select(S.candidate_similarity(F.col("kind"), F.col("cos"), F.col("edit"), F.col("dist")).alias("s"), S.popularity_feature(F.col("kind"), F.col("degree")).alias("p")).collect()
    assert [tuple(r.s) + (r.p,) for r in got] == [(0.3, 0.7, None, 0.0), (0.3, None, 2.0, 0.0)]
