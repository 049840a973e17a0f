import random

import pytest

from tesserakg.operators.hierarchy import all_descendants, descendants, hierarchy


def walk(up, node):
    """Path from the root, or None and the least id of the cycle."""
    path = [node]
    while path[-1] in up:
        if up[path[-1]] in path:
            ring = path[path.index(up[path[-1]]) :]
            return None, min(ring)
        path.append(up[path[-1]])
    return path[::-1], path[-1]


@pytest.mark.parametrize("split", [3, 8])
def test_hierarchy_against_walks(spark, split):
    """Trees, a chain of 60, a hub with a third of all nodes, a cycle of three, a self loop, a long cycle, and what hangs below."""
    r = random.Random(2)
    up = {"a": "b", "b": "c", "c": "a", "s": "s", "t1": "s", "t2": "t1", "x": "root", "y": "x"}
    up |= {f"k{i}": f"k{i - 1}" for i in range(1, 60)} | {f"h{i}": "hub" for i in range(90)} | {"hub": "root"}
    up |= {f"o{i}": f"o{(i + 1) % 25}" for i in range(25)}
    for i in range(80):
        up[f"n{i}"] = r.choice(["a", "b", "root", "k30", "o3", *(f"n{j}" for j in range(i))])
    rows = list(up.items())
    edges = spark.createDataFrame(rows + rows[:20] + [(None, "a"), ("z", None), ("", "a"), ("z", "")], "child string, parent string")
    got = {x.id: (tuple(x.path) if x.path else None, x.root_id, x.node_depth) for x in hierarchy(edges, spark.createDataFrame([("alone",), (None,), ("a",)], "id string"), split).collect()}
    wanted = {}
    for node in {*up, *up.values(), "alone"}:
        path, root = walk(up, node)
        wanted[node] = (tuple(path) if path else None, root, len(path) - 1 if path else -1)
    assert got == wanted


def test_descendants_of_paths(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], "child string, parent string")
    got = sorted(map(tuple, descendants(hierarchy(edges, spark.createDataFrame([], "id string"))).collect()))
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]


def test_descendants_over_all_parents(spark):
    """Several parents, cycles and what is below them, against searches."""
    r = random.Random(4)
    links = {("c", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")}
    links |= {(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 60)} | {(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 60, 3)} | {("n5", "n40")}
    up = {}
    for child, parent in links:
        up.setdefault(child, set()).add(parent)
    wanted = set()
    for node in up:
        seen, level, n = {}, {node}, 0
        while level:
            n += 1
            level = {p for x in level for p in up.get(x, ()) if p not in seen}
            seen |= {p: n for p in level}
        wanted |= {(p, node, n) for p, n in seen.items() if p != node}
    got = [tuple(x) for x in all_descendants(spark.createDataFrame(sorted(links), "child string, parent string")).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_no_links(spark):
    edges = spark.createDataFrame([], "child string, parent string")
    assert [tuple(x) for x in hierarchy(edges, spark.createDataFrame([("q",)], "id string")).collect()] == [("q", "q", 0, ["q"])]
    assert all_descendants(edges).collect() == []
