"""Bridges and spanning forests, spread over tasks, against removal of one edge after the other."""

import random

from kinloom.operators import graph


def parts(nodes, edges):
    label = {v: v for v in nodes}

    def find(v):
        while label[v] != v:
            label[v] = label[label[v]]
            v = label[v]
        return v

    for a, b in edges:
        label[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in nodes}


def some_graph():
    """Trees, rings, a chain of rings, a star with a few more edges, pairs, a loop and repeated edges."""
    draw = random.Random(3)
    edges = {(100 + i, 100 + i + 1) for i in range(30)} | {(100, 130)}  # a ring
    edges |= {(200 + i, 200 + i + 1) for i in range(40)}  # a path
    for r in range(5):  # rings on a chain
        edges |= {(300 + 10 * r + i, 300 + 10 * r + (i + 1) % 6) for i in range(6)} | ({(300 + 10 * r, 290 + 10 * r)} if r else set())
    edges |= {(400, 401 + i) for i in range(80)} | {(401, 402), (410, 420), (420, 430)}  # a star
    edges |= {(500 + draw.randrange(90), 500 + draw.randrange(90)) for _ in range(85)} | {(600, 601), (602, 602)}  # at random
    return sorted(edges), [*edges, *[(b, a) for a, b in list(edges)[:20]]]


def test_bridges_of_every_kind_of_class(spark):
    edges, given = some_graph()
    plain = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    label = parts({v for e in edges for v in e}, plain)
    without = {e: parts(label, [x for x in plain if x != e]) for e in plain}
    want = sorted((label[a], a, b) for a, b in plain if without[a, b][a] != without[a, b][b])
    labels = spark.createDataFrame(sorted(label.items()), "node int, class int")
    # The path, the star and the large random class are spread, the others are groups.
    got = sorted(map(tuple, graph.bridges(spark.createDataFrame(given, "a int, b int").repartition(3), labels, 36).select("class", "a", "b").collect()))
    assert got == want and 100 < len(got) < len(plain)


def test_a_spanning_forest_joins_all_and_closes_no_circle(spark):
    edges, _ = some_graph()
    plain = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    nodes = {v for e in plain for v in e}
    forest = [tuple(r) for r in graph.spanning_forest(spark.createDataFrame(plain, "a int, b int")).collect()]
    assert set(forest) <= set(plain) and len(forest) == len(set(forest))
    assert parts(nodes, forest) == parts(nodes, plain) and len(forest) == len(nodes) - len(set(parts(nodes, plain).values()))
    assert graph.spanning_forest(spark.createDataFrame([], "a string, b string")).collect() == []
