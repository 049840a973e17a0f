import random

import pytest
from pyspark.sql import types as T

from tesserakg.llm.components import components, forest, match_groups

SCHEMA = "a_id long, b_id long, is_match boolean, root string"


def brute(pairs):
    group = {}
    for a, b in pairs:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        if group[a] is not group[b]:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    return {(x, min(g)) for x, g in group.items()}


def test_forest_keeps_components():
    import numpy as np

    r = random.Random(3)
    for _ in range(50):
        pairs = [(r.randrange(30), r.randrange(30)) for _ in range(r.randrange(40))]
        pairs = [(a, b) for a, b in pairs if a != b]
        x, y = forest(np.array([a for a, _ in pairs], dtype="int64"), np.array([b for _, b in pairs], dtype="int64"))
        assert {(int(n), int(t)) for n, t in zip(x, y)} == {(n, t) for n, t in brute(pairs) if n != t}


@pytest.mark.parametrize("bound,fan_in", [(4_000_000, 8), (40, 2), (7, 4)])
def test_components_with_bounded_merges(spark, bound, fan_in):
    """Chains, a star that holds a third of all links, and random links; small bounds force contraction."""
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(500, 500 + i) for i in range(1, 90)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(150)]
    pairs = [(a, b) for a, b in pairs if a != b]
    r.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    assert {tuple(x) for x in components(df, bound, fan_in).collect()} == brute(pairs)


def test_groups_of_dirty_pairs(spark):
    rows = [(2, 1, True, "x"), (2, 1, True, "x"), (1, 2, False, None), (3, 2, True, None), (4, 4, True, None), (None, 1, True, None), (5, None, True, None), (6, 7, None, None), (8, 9, False, None), (10, 11, True, None)]
    out = match_groups(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["mention_id", "group_id"]
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10)]


def test_no_pairs(spark):
    out = match_groups(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.schema["group_id"].dataType == T.LongType()
