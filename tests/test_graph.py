"""Graph operators on small graphs, against plain Python."""

from __future__ import annotations

import itertools

import pytest

from factloom.operators import graph

SCHEMA = "subject string, predicate string, object string, confidence double"
EDGES = [("a", "IS_A", "b", 0.5), ("b", "IS_A", "c", 0.8), ("c", "IS_A", "a", 1.0), ("c", "USES", "d", 0.5), ("d", "USES", "d", 0.9), ("e", "USES", "d", 0.1), ("x", "USES", "y", 0.3)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def bfs(start, depth):
    near = {}
    for s, _, o, _ in EDGES:
        near.setdefault(s, set()).add(o)
        near.setdefault(o, set()).add(s)
    found, frontier = {start: 0}, {start}
    for d in range(1, depth + 1):
        frontier = {n for f in frontier for n in near.get(f, ())} - set(found)
        found |= {n: d for n in frontier}
    return {n: d for n, d in found.items() if d}


@pytest.mark.parametrize(("start", "depth"), [("a", 1), ("a", 2), ("a", 3), ("y", 2), ("none", 2), ("a", 0)])
def test_reached(edges, start, depth):
    assert {r["node"]: r["depth"] for r in graph.reached(edges, start, depth).collect()} == bfs(start, depth)


def test_simple_paths(edges):
    found = {tuple(r["path"]): r["confidence"] for r in graph.simple_paths(edges, "a", "d", 4).collect()}
    links = {(s, o): c for s, _, o, c in EDGES}
    wanted = {}
    for n in range(2, 6):
        for p in itertools.permutations("abcdexy", n):
            if p[0] == "a" and p[-1] == "d" and all(step in links for step in itertools.pairwise(p)):
                c = 1.0
                for step in itertools.pairwise(p):
                    c *= links[step]
                wanted[p] = c
    assert found == pytest.approx(wanted)


def test_composed_gives_one_step(spark):
    chain = spark.createDataFrame([(str(i), "IS_A", str(i + 1), 1.0) for i in range(9)], SCHEMA)
    assert {(r["subject"], r["object"]) for r in graph.composed(chain).collect()} == {(str(i), str(i + 2)) for i in range(8)}


def test_empty_graph(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert graph.reached(none, "a").count() == 0
    assert graph.simple_paths(none, "a", "b").count() == 0
    assert graph.composed(none).count() == 0
