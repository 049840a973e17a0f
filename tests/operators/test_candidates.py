import functools
import math
import random

from tesserakg.operators import candidates as C
from tesserakg.operators import decisive as E
from tesserakg.operators import kg as K


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_matches_are_all_within_the_edits(spark):
    words = ["to", "tea", "team", "teams", "treaty", "institute", "brøuja", "x"]
    tokens = [*words, "teat", "taem", "treatise", "treat", "treayt", "instit", "institutes", "broujae", "brouja", "to1", "xy", "inistitute"]
    got = {tuple(r) for r in C.word_matches(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    most = lambda w: 0 if len(w) < 3 else 1 if len(w) <= 5 else 2
    assert got == {(w, t) for w in words for t in tokens if levenshtein(w, t) <= most(w)}


def test_fuzzy_candidates(spark):
    names = [("Q1", "Treaty of Kolma"), ("Q1", "Kolma"), ("Q2", "Kolmaa City"), ("Q3", "Battle of Vrelt"), ("P4", "kolma"), ("Q5", None), (None, None)]
    degree = spark.createDataFrame([("Q1", 9), ("Q2", 0)], "id string, num_claims long")
    got = {(r.mention, r.qid): r.score for r in C.fuzzy_candidates(spark.createDataFrame([("treaty kolma",), ("Vrelt",), (None,), ("..",)], "mention string"), spark.createDataFrame(names, "id string, name string"), degree).collect()}
    assert set(got) == {("treaty kolma", "Q1"), ("treaty kolma", "Q2"), ("Vrelt", "Q3")}
    assert got["treaty kolma", "Q1"] > 1.2 and got["treaty kolma", "Q2"] == 0.5 and got["Vrelt", "Q3"] == 1.0


def test_lookup_precedence_and_cut_off(spark):
    rows = [("Paris", 0, "Q1", 0.9), ("paris", 0, "Q2", 0.5), ("paris", 1, "Q3", 0.7), ("ROME", 0, "Q4", 0.2)]
    d = spark.createDataFrame(rows, "mention string, rank int, qid string, prior double")
    asked = spark.createDataFrame([("Paris",), ("PARIS",), ("rome",), ("Oslo",), (None,)], "mention string")
    assert {(r.mention, r.key, r.level) for r in C.lookup(asked, d).collect()} == {("Paris", "Paris", "exact"), ("PARIS", "paris", "lower"), ("rome", "ROME", "folded"), ("Oslo", None, "none")}
    assert {(r.mention, r.qid, round(r.prior, 3)) for r in C.renormalised(d).collect()} == {("Paris", "Q1", 0.9), ("paris", "Q2", 0.417), ("paris", "Q3", 0.583), ("ROME", "Q4", 0.2)}
    keep = spark.createDataFrame([("Q3",)], "qid string")
    assert {r.qid for r in C.cut_off(d, 1).collect()} == {"Q1", "Q2", "Q4"} and {r.qid for r in C.cut_off(d, 1, keep).collect()} == {"Q1", "Q2", "Q3", "Q4"}
    assert C.cut_off(d, -1).count() == 4


def test_gold_is_inserted_or_removed(spark):
    rows = [(1, 0, "m", "G", False, 0, "A", 0.5), (1, 0, "m", "G", False, 1, "B", 0.4), (1, 1, "m", "A", False, 0, "A", 0.5), (1, 2, "m", "A", True, 0, "A", 0.5), (1, 3, "m", "G", False, None, None, None)]
    df = spark.createDataFrame(rows, "docno long, pos int, mention string, gold string, ookg boolean, rank int, qid string, prior double")
    got = sorted((r.pos, r.rank, r.qid, r.prior) for r in C.with_gold(df, 2).collect())
    assert got == [(0, 0, "A", 0.5), (0, 1, "G", 0.0), (1, 0, "A", 0.5), (3, 0, "G", 0.0)]


def test_graph_restrictions_and_closure(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("X", "Y"), ("Y", "X"), (None, "A")], "child string, parent string")
    got = {tuple(r) for r in K.closure(edges).collect()}
    assert got == {("A", "B"), ("A", "C"), ("A", "D"), ("B", "C"), ("B", "D"), ("C", "D"), ("X", "Y"), ("Y", "X"), ("X", "X"), ("Y", "Y")}
    claims = spark.createDataFrame([("E", "P31", "T1"), ("E", "P17", "T2"), ("T1", "P31", "U"), ("Z", "P1", "E"), ("W", "P1", "Z")], "subject string, property string, object string")
    up = spark.createDataFrame([("T2", "S")], "node string, ancestor string")
    one = K.one_hop_types(claims, up)
    assert {tuple(r) for r in one.filter("id = 'E'").collect()} == {("E", "T1", 1), ("E", "T2", 1), ("E", "S", 1)}
    assert {tuple(r) for r in K.two_hop_types(claims, one).filter("id = 'E'").collect()} == {("E", "U", 1)}
    ids = spark.createDataFrame([(x,) for x in ("E", "T1", "Z", "W", "U", "V")], "id string")
    got = {tuple(r) for r in K.restrict_three_way(claims, ids, spark.createDataFrame([("E",)], "id string")).collect()}
    assert got == {("E", "full", 2), ("T1", "reduced", 1), ("Z", "reduced", 0), ("U", "reduced", 0)}


def test_decisive_types(spark):
    cand = spark.createDataFrame([(1, 0, "A", "A"), (1, 0, "A", "B"), (1, 1, "C", None)], "docno long, pos int, gold string, qid string")
    types = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "y"), ("C", "y")], "id string, type string")
    d = E.decisive_types(cand, types)
    assert sorted(map(tuple, d.collect())) == [(1, 0, "x"), (1, 1, "y")]
    assert E.greedy_cover(d, 5) == [("x", 1), ("y", 1)] and [tuple(r) for r in E.top_types(d, 1).collect()] == [("x", 1)]


def test_clusters_by_their_members(spark):
    members = spark.createDataFrame([("c1", "Bank of Kolma"), ("c1", "Kolma"), ("c2", "Vrelt City"), ("c3", None)], "root string, mention string")
    got = {(r.mention, r.root): r.score for r in C.cluster_candidates(spark.createDataFrame([("the Bank of Kolma",), ("Vrelt Institute",), (None,)], "mention string"), members).collect()}
    assert got == {("the Bank of Kolma", "c1"): 1.0}


def most_rows(plan):
    """The largest number of rows that an operator of a finished plan put out."""
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    below = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().length())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])


def test_fuzzy_candidates_with_a_word_that_all_share(spark):
    """A word in every mention and name makes no row for each pair of them, and the best are those of all pairs."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcde") for _ in range(6))
    kinds = ["treaty", "treayt", "house"]
    names = sorted({(f"{'P' if i % 50 == 0 else 'Q'}{i % 700}", f"{r.choice(kinds)} of {word()}" if i % 3 else word()) for i in range(900)})
    asked = sorted({f"{r.choice(kinds)} of {word()}" if i % 3 else r.choice([f"of {word()}", f"{word()} house", "of"]) for i in range(600)})
    claims = {f"Q{i}": i % 7 for i in range(500)}
    out = C.fuzzy_candidates(spark.createDataFrame([(m,) for m in asked], "mention string"), spark.createDataFrame(names, "id string, name string"), spark.createDataFrame(sorted(claims.items()), "id string, num_claims long"), k=4)
    got = {(x.mention, x.qid): x.score for x in out.collect()}
    assert most_rows(out._jdf.queryExecution().executedPlan()) < len(asked) * len(names) / 10
    near = functools.cache(lambda a, b: levenshtein(a, b) <= (0 if len(a) < 3 else 1 if len(a) <= 5 else 2))
    for m in asked[::6]:
        w = sorted(set(m.split()))
        best = {}
        for q, name in names:
            hit = sum(any(near(x, t) for t in name.split()) for x in w)
            if q[0] != "P" and 2 * hit >= len(w):
                best[q] = max(best.get(q, 0.0), hit / len(w))
        wanted = sorted((-round(s + 0.1 * math.log1p(claims.get(q, 0)), 6), q) for q, s in best.items())[:4]
        assert sorted((-s, q) for (x, q), s in got.items() if x == m) == wanted
