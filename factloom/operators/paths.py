"""Shortest paths between many pairs of nodes of one graph, from both ends at once.

edges(subject, object, ord), pairs(start, target). Edges are walked both ways; ord is their order of arrival. Of several
shortest paths the one counts that a breadth-first walk from the start finds, which looks at a node's outgoing edges first and
then at incoming ones, both by arrival: the path with the least sequence of these places.

Both ends grow level by level. A start that many pairs have grows once for all of them, and so does a target; what grows next is
the side whose border has fewer edges to follow, so neither many pairs of few nodes nor nodes with very many edges multiply.
A pair is done when the levels of its two ends first touch: then its distance is the sum of both depths. On the target's side
each node keeps the first edge that leads to a nearer one, on the start's side all edges of shortest paths are kept; from where
a pair touches they are walked back to its start. Every level is a written table, so plans stay short and a lost executor
costs one level at most.

Defined cases: a start that is its target has a path of itself; pairs without a path have null for path and edges; nulls in a
pair give a null path; loops on a node are no step; repeated pairs count once; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import written

_SIDES = ("start", "target")


def _step(back: Column, ord_: Column, node: Column) -> Column:
    return F.struct(back.alias("back"), ord_.alias("ord"), node.alias("other"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _border(last: DataFrame, open_: DataFrame, side: str) -> DataFrame:
    """The last level of the ends that still have open pairs."""
    return last.join(open_.select(F.col(side).alias("root")).distinct(), "root", "left_semi")


def _cost(border: DataFrame, degrees: DataFrame) -> int:
    return border.join(degrees, "node").agg(F.sum("degree")).first()[0] or 0


def _grown(links: DataFrame, border: DataFrame, seen: DataFrame, side: int, depth: int) -> DataFrame:
    """root, node, depth, steps of the new nodes of a side: edges as they are walked, from `other` to node on the start's side (all), from node to `other` on the target's (the first)."""
    on = border.select("root", F.col("node").alias("from")).join(links.withColumnRenamed("node", "from"), "from")
    if side == 0:
        steps = F.collect_list(_step(F.col("back"), F.col("ord"), F.col("from")))
    else:
        steps = F.array(F.min(_step(1 - F.col("back"), F.col("ord"), F.col("from"))))
    fresh = on.withColumnRenamed("other", "node").join(seen.select("root", "node"), ["root", "node"], "left_anti")
    return written(fresh.groupBy("root", "node").agg(steps.alias("steps")).withColumn("depth", F.lit(depth)))


def _touching(last: list[DataFrame], open_: DataFrame) -> DataFrame:
    """start, target, node of the open pairs whose last levels share nodes, from the side on which the pairs have fewer of them."""
    rows = []
    for side, level in zip(_SIDES, last, strict=True):
        sizes = level.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", side)
        rows.append(open_.join(sizes, side).agg(F.sum("n")).first()[0] or 0)
    own, far = (0, 1) if rows[0] <= rows[1] else (1, 0)
    near = open_.join(last[own].select(F.col("root").alias(_SIDES[own]), "node"), _SIDES[own])
    return near.join(last[far].select(F.col("root").alias(_SIDES[far]), "node"), [_SIDES[far], "node"]).select("start", "target", "node")


def shortest(edges: DataFrame, pairs: DataFrame, most: int = 64) -> DataFrame:
    """start, target, path (nodes), via (ord of the edges) of every pair; paths longer than `most` edges are none."""
    out = edges.where("subject <> object").select(F.col("subject").alias("node"), F.col("object").alias("other"), F.lit(0).alias("back"), "ord")
    links = written(out.unionByName(out.select(F.col("other").alias("node"), F.col("node").alias("other"), F.lit(1).alias("back"), "ord")))
    degrees = links.groupBy("node").agg(F.count("*").alias("degree"))
    every = written(pairs.select("start", "target").distinct())
    open_ = every.where("start <> target")
    none = F.array().cast("array<struct<back:int,ord:long,other:string>>")
    levels = [[written(open_.select(F.col(c).alias("root")).distinct().select("root", F.col("root").alias("node"), none.alias("steps"), F.lit(0).alias("depth")))] for c in _SIDES]
    met, depth, border = [], [0, 0], [levels[0][0], levels[1][0]]
    costs = [_cost(x, degrees) for x in border]
    while all(costs) and sum(depth) < most:
        side = 0 if costs[0] < costs[1] else 1
        depth[side] += 1
        levels[side].append(_grown(links, border[side], _union(levels[side]), side, depth[side]))
        touched = written(_touching([levels[0][-1], levels[1][-1]], open_).withColumn("ahead", F.lit(depth[0])))
        if touched.limit(1).count():
            met.append(touched)
            open_ = written(open_.join(touched.select("start", "target").distinct(), ["start", "target"], "left_anti"))
        border = [_border(x[-1], open_, c) for x, c in zip(levels, _SIDES, strict=True)]
        costs = [_cost(x, degrees) for x in border]
    trivial = every.where("start = target").select("start", "target", F.array("start").alias("path"), F.array().cast("array<long>").alias("via"))
    missing = F.lit(None).cast("array<string>"), F.lit(None).cast("array<long>")
    rest = every.where("start is null or target is null or start <> target")
    if not met:
        return trivial.unionByName(rest.select("start", "target", missing[0].alias("path"), missing[1].alias("via")))
    touched = _union(met)
    found = written(_read(_forward(levels[0], touched), levels[1], touched, depth))
    unmet = rest.join(found.select("start", "target"), ["start", "target"], "left_anti")
    return trivial.unionByName(found).unionByName(unmet.select("start", "target", missing[0].alias("path"), missing[1].alias("via")))


_KEYS = ["start", "target", "node"]


def _forward(levels: list[DataFrame], met: DataFrame) -> list[DataFrame]:
    """start, target, node, next, ord of the nodes of each depth between the start and where the sides touch: the first edge that leads on."""
    held, steps = met.where(F.col("ahead") == len(levels) - 1).select(*_KEYS), []
    for level in range(len(levels) - 1, 0, -1):
        ways = levels[level].select(F.col("root").alias("start"), "node", F.explode("steps").alias("s"))
        on = held.join(ways, ["start", "node"]).select("start", "target", F.col("s.other").alias("other"), _step(F.col("s.back"), F.col("s.ord"), F.col("node")).alias("s"))
        found = written(on.groupBy("start", "target", F.col("other").alias("node")).agg(F.min("s").alias("f")).select(*_KEYS, F.col("f.other").alias("next"), F.col("f.ord").alias("ord")))
        steps.insert(0, found)
        held = met.where(F.col("ahead") == level - 1).select(*_KEYS).unionByName(found.select(*_KEYS))
    return steps


def _read(steps: list[DataFrame], behind: list[DataFrame], met: DataFrame, depth: list[int]) -> DataFrame:
    """The paths: from each start by the pair's own steps to where the sides touch, from there by those of the target."""
    walk = met.groupBy("start", "target").agg(F.max("ahead").alias("ahead")).select("start", "target", "ahead", F.col("start").alias("node"), F.array("start").alias("path"), F.array().cast("array<long>").alias("via"))

    def gone(on: DataFrame, going: Column) -> DataFrame:
        return on.select(
            "start", "target", "ahead", F.when(going, F.col("next")).otherwise(F.col("node")).alias("node"), F.when(going, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"),
            F.when(going, F.concat("via", F.array("ord"))).otherwise(F.col("via")).alias("via"),
        )

    for k, step in enumerate(steps):
        walk = gone(walk.join(step, _KEYS, "left"), (F.col("ahead") > k) & F.col("next").isNotNull())
        if k % 4 == 3:
            walk = written(walk)
    nearer = _union(behind[1:]).select(F.col("root").alias("target"), "node", F.col("steps")[0]["other"].alias("next"), F.col("steps")[0]["ord"].alias("ord")) if depth[1] else None
    for k in range(depth[1]):
        walk = gone(walk.join(nearer, ["target", "node"], "left"), (F.col("node") != F.col("target")) & F.col("next").isNotNull())
        if k % 4 == 3:
            walk = written(walk)
    return walk.select("start", "target", "path", "via")
