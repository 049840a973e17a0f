import random

from tesserakg.operators import datasets as D


def rows(spark, *values):
    return spark.createDataFrame(list(values), "docno long, pos int, mention string, qid string, ookg boolean, day date, start int, len int")


def test_alternating_context(spark):
    """Before 1 2 3, after 4 5: the nearest of each side in turn; a pair is taken as a whole."""
    m = rows(spark, *[(1, p, "m", q, False, None, 0, 1) for p, q in enumerate(["Q1", "Q2", "Q3", "ME", "Q4", "Q5"])], (2, 0, "m", "ME", False, None, 0, 1), (1, 6, "m", "Q9", True, None, 0, 1), (1, 7, "m", None, False, None, 0, 1))
    context = lambda w: [x.other for x in D.alternating_context(m, w).filter("docno = 1 and pos = 3").orderBy("place").collect()]
    assert context(4) == ["Q3", "Q4", "Q2", "Q5"] and context(3) == ["Q3", "Q4", "Q2", "Q5"] and context(2) == ["Q3", "Q4"] and context(9) == ["Q3", "Q4", "Q2", "Q5", "Q1"]
    assert D.alternating_context(m, 4).filter("docno = 2").count() == 0


def test_most_active(spark):
    seq = lambda s: spark.createDataFrame([(i, q) for i, q in enumerate(s)], "at long, qid string")
    assert D.most_active(seq("abacb")).first()[0] == 2 and D.most_active(seq("abc")).first()[0] == 0
    r = random.Random(1)
    for _ in range(4):
        s = [r.choice("abcdefgh") for _ in range(r.randrange(2, 60))]
        wanted = max(len(set(s[: i + 1]) & set(s[i + 1 :])) for i in range(len(s)))
        assert D.most_active(seq(s)).first()[0] == wanted
    assert D.most_active(seq("").limit(0)).first()[0] == 0


def test_token_windows(spark):
    df = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 5), (1, 2, 8, 11), (1, 3, 10, 30), (2, 0, 4, 5)], "docno long, pos int, tok_start int, tok_end int")
    assert sorted(map(tuple, D.token_windows(df, 10).collect())) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 0, 0)]


def test_spans_of_marked_tokens(spark):
    df = spark.createDataFrame([(1, 0, "New", "B"), (1, 1, "York", "I"), (1, 2, None, None), (1, 3, "in", None), (1, 4, "Rome", "B"), (1, 5, "Oslo", "B")], "doc_no long, line_no int, token string, tag string")
    assert sorted(map(tuple, D.iob_spans(df).collect())) == [(1, 0, 8, "New York"), (1, 12, 4, "Rome"), (1, 17, 4, "Oslo")]


def test_sample_and_negatives(spark):
    m = rows(spark, *[(d, p, "m", f"Q{(d * 7 + p) % 40}", False, None, 0, 1) for d in range(40) for p in range(3)], (99, 0, "m", None, False, None, 0, 1))
    sample = {x.qid for x in D.sampled_entities(m, 0.25, "s").collect()}
    assert len(sample) == 10 and sample == {x.qid for x in D.sampled_entities(m.repartition(7), 0.25, "s").collect()}
    train, test = D.artificial_ookg(m, D.sampled_entities(m, 0.25, "s"))
    assert not {x.qid for x in train.collect()} & sample and {x.qid for x in test.filter("ookg").collect()} == sample
    pool = spark.createDataFrame([(f"Q{i}",) for i in range(3000)], "id string")
    got = D.sampled_negatives(m, pool, 3).collect()
    own = {}
    for x in m.collect():
        own.setdefault(x.docno, set()).add(x.qid)
    assert got and all(x.negative not in own[x.docno] for x in got) and max(x.place for x in got) <= 3


def test_free_occurrences(spark):
    docs = spark.createDataFrame([(1, "Kolma saw kolma and KOLMAR", None)], "docno long, text string, day date")
    got = sorted(map(tuple, D.free_occurrences(docs, rows(spark, (1, 0, "Kolma", "Q1", False, None, 0, 5), (1, 1, None, "Q2", False, None, None, 5))).collect()))
    assert got == [(1, "Kolma", 10), (1, "Kolma", 20)]


def test_index_of_a_hot_id(spark):
    m = rows(spark, *[(d, 0, "m", "HOT", False, None, 0, 1) for d in range(1500)], (1, 1, "m", "Q1", False, None, 0, 1))
    parts = D.document_index(m).filter("qid = 'HOT'").collect()
    assert len(parts) > 10 and sum(p.n for p in parts) == 1500 and sorted(d for p in parts for d in p.docs) == list(range(1500))
