import random

import pytest

from tesserakg.llm.mapping import LEAST, allowed, closeness, edits, form, mapped, similar_forms

NAMES = [("Q1", "Bank of Vrelthorp"), ("Q1", "BVRE"), ("Q2", "Vrelthorp"), ("Q3", "Saint Kolmaesk"), ("Q4", "Тремпукол"), ("Q5", "Quildax Menvory"), (None, "Nobody"), ("Q6", None), ("Q7", ""), ("Q9", "Twice"), ("Q8", "Twice")]


def test_forms():
    assert form("  The  BANK_of Vr\u00eblthorp’s! ") == form("Vrelthorp, Bank of") == "bank of vrelthorp"
    assert form("Ｓｔ. Ｋ0lmaesk") == "kolmaesk saint"
    assert form("Vrеlthоrp") == "vrelthorp"  # two Cyrillic look-alikes
    assert form("B.V.R.E.") == "bvre" and form(" - ") == ""
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 1) == 2


def test_typed_names_and_their_entities(spark):
    typed = [(1, "bank of vrelthrop", "Q1"), (2, "Vrelthorp", "Q2"), (3, "vRELTHORP, bANK OF", "Q1"), (4, "Tremрukol", "Q4"), (5, "BankOfVrelthorp", "Q1"), (6, "Battle of Vrelthorp", "NIL"), (7, "Monday", "NIL"), (8, "B.V.R.E.", "Q1"), (9, "Quildax Menvry", "Q5"), (10, "...", "NIL"), (11, "Twice", "Q8")]
    rows = [(k, m, "x") for k, m, _ in typed] + [(1, "bank of vrelthrop", "y"), (20, None, None), (21, "  ", None), (22, "\u00a0", None)] + [(100 + i, "Vrelthorp", None) for i in range(300)]
    entries = spark.createDataFrame(rows, "key long, name string, id string").repartition(4)
    got = mapped(entries, spark.createDataFrame(NAMES * 2, "id string, name string"))
    assert got.columns == ["key", "id"]
    assert sorted(map(tuple, got.collect())) == sorted([(k, q) for k, _, q in typed] + [(100 + i, "Q2") for i in range(300)])


def test_empty_tables(spark):
    entries, names = spark.createDataFrame([(1, "a b")], "key long, name string"), spark.createDataFrame([], "id string, name string")
    assert [tuple(r) for r in mapped(entries, names).collect()] == [(1, "NIL")]
    assert mapped(entries.limit(0), spark.createDataFrame(NAMES, "id string, name string")).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed):
    """Every similar pair is found, whatever the prefixes; half of the names share a word, so its tokens are salted."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abeikrst") for _ in range(r.randint(4, 9)))
    left = {form(word() + (" united" if r.random() < 0.5 else "")) for _ in range(60)}
    right = left | {form(x[:3] + r.choice("ab") + x[3:]) for x in left}
    wanted = {(a, b) for a in left for b in right if closeness(a, b)[0] >= LEAST and closeness(a, b)[1] <= allowed(a, b)}
    got = similar_forms(spark.createDataFrame([(x,) for x in left], "form string"), spark.createDataFrame([(x,) for x in right], "form string"))
    assert {(x.form, x.name) for x in got.collect()} == wanted
