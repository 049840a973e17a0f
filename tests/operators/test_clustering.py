import heapq
import random

import numpy as np
import pytest

from tesserakg.functions.text import ratio
from tesserakg.operators import clustering as L


def union(pairs, nodes=()):
    root = {n: n for n in nodes}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


def graph(seed, n=60, m=90):
    r = random.Random(seed)
    scores = r.sample(range(1, 999), m)
    return {tuple(sorted(r.sample([f"m{i:02}" for i in range(n)], 2))): s / 1000 for s in scores}


@pytest.mark.parametrize("seed", [1])
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(i, i + 1) for i in range(100, 150)] + [(500, 500 + i) for i in range(60)] + [(r.randrange(300), r.randrange(300)) for _ in range(90)]
    df = spark.createDataFrame(pairs + [(None, 1), (2, None)], "a long, b long").repartition(5)
    assert {x.node: x.root for x in L.components(df).collect()} == union(pairs)
    assert L.components(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [3])
def test_spanning_forest_and_bottom_up(spark, seed):
    """Against the greedy rules over the sorted edges."""
    edges = graph(seed)
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a string, b string, score double")
    order = sorted(edges, key=lambda e: (-edges[e], e))
    root, wanted = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in order:
        if find(a) != find(b):
            root[find(a)] = find(b)
            wanted.add((a, b))
    assert {(x.a, x.b) for x in L.spanning_forest(df).collect()} == wanted
    entities = ["m03", "m17", "m31", "m44", "e9"]
    nodes = sorted({n for e in edges for n in e})
    cluster = {n: {n} for n in {*nodes, *entities}}
    for a, b in order:
        if cluster[a] is not cluster[b] and not (set(entities) & cluster[a] and set(entities) & cluster[b]):
            both = cluster[a] | cluster[b]
            for x in both:
                cluster[x] = both
    got = L.bottom_up_clusters(spark.createDataFrame([(n,) for n in nodes], "node string"), df, spark.createDataFrame([(e,) for e in entities], "entity string"))
    assert {x.node: x.root for x in got.collect()} == {n: min(cluster[n]) for n in nodes}


@pytest.mark.parametrize("seed", [5])
def test_path_clusters(spark, seed):
    """Against a search from all entities at once in every component with several of them."""
    edges = graph(seed, 40, 50)
    entities = [f"m{i:02}" for i in range(0, 40, 6)]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    comp = union(edges, [*nodes, *entities])
    near = {}
    for (a, b), s in edges.items():
        near.setdefault(a, []).append((b, s))
        near.setdefault(b, []).append((a, s))
    wanted = {}
    members = {}
    for n, c in comp.items():
        members.setdefault(c, []).append(n)
    for c, ns in members.items():
        own = sorted(set(ns) & set(entities))
        if len(own) < 2:
            wanted |= {n: own[0] if own else None for n in ns}
            continue
        best, heap = {}, [(-1.0, e, e) for e in own]
        heapq.heapify(heap)
        while heap:
            p, e, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n] = e
            for m, s in near.get(n, []):
                if m not in best and -p * s > 0.1:
                    heapq.heappush(heap, (p * s, e, m))
        wanted |= {n: best.get(n) for n in ns}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a string, b string, score double")
    got = L.path_clusters(spark.createDataFrame([(n,) for n in nodes], "node string"), df, spark.createDataFrame([(e,) for e in entities], "entity string"), 0.1).collect()
    assert {x.node: x.entity for x in got} == {n: wanted[n] for n in nodes}


def test_leaders(spark):
    names = ["Kolma", "Kolmar", "Vrelt", "kolma", None, "Kolma", "Vrelthorp"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(names)] + [(2, 0, "Kolma")], "docno long, pos int, mention string")

    def brute(contained):
        leaders, out = [], []
        for i, x in enumerate(names):
            best, at = 0.8, i
            for y, p in leaders if x else []:
                s = max(ratio(x, y), 1.0 if contained and (x in y or y in x) else 0)
                if s > best:
                    best, at = s, p
            if x and at == i:
                leaders.append((x, i))
            out.append((1, i, at))
        return [*out, (2, 0, 0)]

    for contained in (False, True):
        assert sorted(map(tuple, L.leader_clusters(df, 0.8, contained).collect())) == brute(contained)


def test_range_neighbours_in_blocks(spark):
    r = np.random.RandomState(1)
    v = {i: r.randn(8) for i in range(60)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "id long, vec array<double>").repartition(3)
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    wanted = {(i, j) for i in v for j in v if i % 5 == 0 and i != j and cosine(v[i], v[j]) > 0.4}
    assert {(x.id, x.other) for x in L.range_neighbours(df.filter("id % 5 = 0"), df, 0.4, 8, block=3).collect()} == wanted
