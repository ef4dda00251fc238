"""Shortest paths against a plain breadth-first walk, and trees of any depth against plain recursion."""

from __future__ import annotations

import random
from collections import deque

import pytest

from factloom.operators import hierarchy, numbering, paths


def walk(edges, start, target):
    """Path and edges by a queue: outgoing edges first, then incoming ones, both by arrival."""
    if start == target:
        return [start], []
    out, queue, parent = {}, deque([start]), {start: None}
    for back in (0, 1):
        for a, b, k in sorted(edges, key=lambda e: e[2]):
            if a != b:
                out.setdefault((a, b)[back], []).append(((b, a)[back], k))
    while queue:
        node = queue.popleft()
        for other, k in out.get(node, []):
            if other not in parent:
                parent[other] = (node, k)
                queue.append(other)
                if other == target:
                    path, via = [other], []
                    while parent[path[-1]]:
                        before, k = parent[path[-1]]
                        path.append(before)
                        via.append(k)
                    return path[::-1], via[::-1]
    return None, None


def graph(spark, edges):
    return spark.createDataFrame(edges, "subject string, object string, ord long")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    nodes = [f"n{k}" for k in range(24)]
    edges = [(draw.choice(nodes), draw.choice(nodes), k) for k in range(30)]
    pairs = list({(draw.choice(nodes), draw.choice(nodes)) for _ in range(60)}) + [("n1", "nowhere"), ("n1", "n1")]
    found = {(r.start, r.target): (r.path, r.via) for r in paths.shortest(graph(spark, edges), spark.createDataFrame(pairs * 2, "start string, target string")).collect()}
    assert found == {p: walk(edges, *p) for p in pairs}


def test_ties_cycles_and_ends_that_are_missing(spark):
    edges = [("b", "a", 1), ("a", "c", 2), ("d", "c", 3), ("b", "d", 4), ("c", "a", 5), ("x", "y", 6), ("a", "a", 0)]
    pairs = [("a", "d"), ("a", "x"), (None, "a"), ("y", "y"), ("d", "a")]
    found = {(r.start, r.target): r.path for r in paths.shortest(graph(spark, edges), spark.createDataFrame(pairs, "start string, target string")).collect()}
    assert found == {("a", "d"): ["a", "c", "d"], ("a", "x"): None, (None, "a"): None, ("y", "y"): ["y"], ("d", "a"): ["d", "c", "a"]}
    assert paths.shortest(graph(spark, edges), spark.createDataFrame([("a", "c")], "start string, target string").limit(0)).count() == 0
    assert [r.path for r in paths.shortest(graph(spark, edges).limit(0), spark.createDataFrame([("a", "c")], "start string, target string")).collect()] == [None]


@pytest.fixture(scope="module")
def deep(spark):
    """A chain of 60 with a twig at every third node."""
    rows = [(f"c{k}", f"c{k - 1}", k) for k in range(1, 60)] + [(f"t{k}", f"c{k}", 1000 - k) for k in range(0, 60, 3)]
    return rows, spark.createDataFrame(rows + rows[:5], "child string, parent string, ord long")


def test_deep_trees(spark, deep):
    rows, links = deep
    parent, children = {c: p for c, p, _ in rows}, {}
    for c, p, k in rows:
        children.setdefault(p, []).append((k, c))
    up = {}
    for node in parent:
        at, depth = parent[node], 1
        while at:
            up[node, at] = depth
            at, depth = parent.get(at), depth + 1
    closure = hierarchy.ancestors(links)
    assert {(r.node, r.ancestor): r.depth for r in closure.collect()} == up and max(up.values()) >= 59

    def below(node):
        for _, c in sorted(children.get(node, [])):
            yield c
            yield from below(c)

    expected = {(n, d): k for n in children for k, d in enumerate(below(n), 1)}
    unique = links.distinct()
    assert {(r.node, r.descendant): r.place for r in hierarchy.descendants(unique, closure).collect()} == expected
    pairs = [("t30", "t12"), ("c5", "c40"), ("t3", "t3"), ("c0", "t0"), ("t9", "other"), (None, "c1")]
    found = {(r.a, r.b): r.ancestor for r in hierarchy.common_ancestors(spark.createDataFrame(pairs, "a string, b string"), closure).collect()}
    assert found == {("t30", "t12"): "c12", ("c5", "c40"): "c5", ("t3", "t3"): "t3", ("c0", "t0"): "c0", ("t9", "other"): None, (None, "c1"): None}


def test_cycles_end(spark):
    rows = [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 1), ("e", "e", 1), ("f", None, 1)]
    found = {(r.node, r.ancestor): r.depth for r in hierarchy.ancestors(spark.createDataFrame(rows, "child string, parent string, ord long")).collect()}
    assert found == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3}


def test_every_row_of_a_tree_is_made_once(spark, deep, monkeypatch):
    rows, made = [], hierarchy.written
    monkeypatch.setattr(hierarchy, "written", lambda df: rows.append((out := made(df)).count()) or out)
    assert hierarchy.ancestors(deep[1]).count() == sum(rows)


def test_several_parents_and_tails_of_cycles(spark):
    draw = random.Random(4)
    links = [(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}", k) for k in range(20)]
    expected = {}
    for start in {c for c, _, _ in links}:
        border, depth, seen = {start}, 0, {start}
        while border:
            border, depth = {p for c, p, _ in links if c in border} - seen, depth + 1
            seen |= border
            expected |= {(start, x): depth for x in border}
    assert {(r.node, r.ancestor): r.depth for r in hierarchy.ancestors(spark.createDataFrame(links, "child string, parent string, ord long")).collect()} == expected


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5_000).selectExpr("id", "id % 7 AS g").repartition(6)
    assert sorted((r.g, r.id, r.n) for r in numbering.numbered(rows, ["g", "id"], "n").collect()) == [(g, k, n) for n, (g, k) in enumerate(sorted((k % 7, k) for k in range(5_000)), 1)]
    assert numbering.numbered(rows.limit(0), ["id"], "n").count() == 0


def test_pairs_of_few_ends_with_many_edges_share_their_levels(spark, monkeypatch):
    """60 starts and 3 targets with 80 further neighbours each: written rows follow nodes and edges, not pairs times edges."""
    edges = [(f"s{k}", f"t{k % 3}", k) for k in range(60)] + [(f"x{k}", f"t{k % 3}", 100 + k) for k in range(240)] + [(f"t{k}", "root", 900 + k) for k in range(3)]
    pairs, rows = [(f"s{k}", f"t{j}") for k in range(60) for j in range(3)], []
    real = paths.written
    monkeypatch.setattr(paths, "written", lambda df: rows.append((out := real(df)).count()) or out)
    found = {(r.start, r.target): (r.path, r.via) for r in paths.shortest(graph(spark, edges), spark.createDataFrame(pairs, "start string, target string")).collect()}
    assert found == {p: walk(edges, *p) for p in pairs}
    assert max(rows) < 1_500
