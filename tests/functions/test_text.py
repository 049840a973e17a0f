import random

import pytest
from pyspark.sql import functions as F

from tesserakg.functions import text as T
from tesserakg.functions import vectors as V


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarities_against_plain_ones():
    assert T.lcs("lewenstein", "levenshtein") == 9 and T.ratio("lewenstein", "levenshtein") == 18 / 21
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcé") for _ in range(r.randrange(n)))
    for _ in range(300):
        a, b = word(80), word(80)
        assert T.lcs(a, b) == slow_lcs(a, b)
    assert T.ratio("", "") == 1.0 and T.ratio("", "a") == 0.0 and T.partial("kolma", "xx kolma yy") == 1.0 and T.partial("", "a") == 0.0
    for _ in range(60):
        a, b = word(6), word(12)
        short, long_ = sorted((a, b), key=len)
        ways = [long_[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long_))]
        if short:
            assert T.partial(a, b) == max([0.0] + [T.ratio(short, w) for w in ways])


def test_columns_of_similarities(spark):
    rows = spark.createDataFrame([("abc", "abd"), (None, "a"), ("", "")], "a string, b string").select(T.edit_similarity(F.col("a"), F.col("b")), T.partial_similarity(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx(2 / 3) and rows[1][0] is None and rows[2][0] == 1.0


def test_escapes(spark):
    df = spark.createDataFrame([("a+b%20c%C3%A9",), ("100%",), (None,), ("x*y z/é",)], "x string")
    assert [r[0] for r in df.select(T.url_decoded(F.col("x"))).collect()] == ["a+b cé", "100%", None, "x*y z/é"]
    assert [r[0] for r in df.select(T.url_decoded(T.url_encoded(F.col("x")))).collect()] == [r[0] for r in df.collect()]
    df = spark.createDataFrame([("caf\\u00e9 \\ud83d\\ude00 \\u12",), (None,)], "x string")
    assert [r[0] for r in df.select(T.unicode_unescaped(F.col("x"))).collect()] == ["café 😀 \\u12", None]


def test_marks_spans_and_masks(spark):
    df = spark.createDataFrame([("one two three", [(8, 5), (0, 3)]), ("abc", []), ("abc", [(2, 9)])], "t string, s array<struct<start:int,len:int>>")
    got = [r[0] for r in df.select(T.marked(F.col("t"), F.col("s"), "[", "]")).collect()]
    assert got == ["one[one] two three[three]", "abc", "abc[c]"]
    spans = spark.createDataFrame([("Ab", ["c", None, ""], "de", ["P Q"])], "l string, a array<string>, d string, c array<string>").select(T.entity_spans(F.col("l"), F.col("a"), F.col("d"), F.col("c")).alias("s")).first().s
    assert [tuple(x) for x in spans] == [(0, 0, 2), (0, 3, 4), (1, 5, 7), (2, 8, 11)]
    masks = spark.createDataFrame([(list("abcd"),)], "t array<string>").select(T.masked(F.col("t"), F.lit(1), F.lit(3), "_"), T.masked(F.col("t"), F.lit(1), F.lit(3), "_", True), T.masked(F.col("t"), F.lit(2), F.lit(2), "_", True)).first()
    assert [list(m) for m in masks] == [list("a__d"), list("a_d"), list("abcd")]
    assert spark.range(1).select(T.occurrences(F.lit("aXa xa"), F.lit("XA")), T.occurrences(F.lit("a.b"), F.lit("")), T.thousands(F.lit(1234567)), T.percent(F.lit(0.1234))).first()[:] == ([1, 4], [], "1,234,567", "12.3")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.euclidean(F.col("a"), F.col("b"))).collect()
    assert got[0][:] == (24.0, 0.96, pytest.approx(2**0.5)) and got[1][1] is None and got[2][0] is None
    s = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>").select(V.softmax(F.col("x")), V.argmax(F.col("x")), V.clamped(F.lit(7.0)), V.path_score(V.path_weight(F.lit(0.25))), V.harmonic(F.lit(0.0), F.lit(0.0))).first()
    assert sum(s[0]) == pytest.approx(1) and s[1:] == (1, 1.0, 0.25, 0.0)
    mean = df.filter("a is not null").groupBy().agg(V.mean_vector("b", 2)).first()[0]
    assert mean == [2.5, 2.0]


def test_xml(spark):
    assert T.xml_dict('<a x="1"><b>t</b><b/><c><d>e</d></c>tail</a>') == {"a": {"@x": "1", "b": ["t", None], "c": {"d": "e"}}}
    df = spark.createDataFrame([("<a>é</a>",), ("<broken",), (None,)], "x string")
    assert [r[0] for r in df.select(T.xml_json(F.col("x"))).collect()] == ['{"a": "é"}', None, None]
