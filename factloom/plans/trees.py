"""Queries on paths and trees of the graph, each with SQL that must give the same rows.

Nulls: a null end has no path, a null parent is none. Ties end in the order of arrival. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import hierarchy, paths
from factloom.plans.catalog import query, view

# distances from every target, then the step with the first edge (outgoing ones first) to a node that is one nearer
_SHORTEST = """
WITH RECURSIVE adj AS (
  SELECT subject AS node, object AS other, 0 AS back, ord FROM edges WHERE subject <> object UNION ALL SELECT object, subject, 1, ord FROM edges WHERE subject <> object
), dist AS (
  SELECT DISTINCT target, target AS node, 0 AS d FROM trade UNION SELECT t.target, a.other, t.d + 1 FROM dist t JOIN adj a ON a.node = t.node WHERE t.d < 8
), near AS (
  SELECT target, node, min(d) AS d FROM dist GROUP BY ALL
), steps AS (
  SELECT n.target, n.node, arg_min(a.other, a.back * 1000000000 + a.ord) AS next, arg_min(a.ord, a.back * 1000000000 + a.ord) AS ord FROM near n JOIN adj a ON a.node = n.node JOIN near m ON m.target = n.target AND m.node = a.other AND m.d = n.d - 1 GROUP BY ALL
), walk AS (
  SELECT start, target, start AS node, start AS path, '' AS via FROM trade UNION ALL SELECT w.start, w.target, s.next, w.path || '>' || s.next, w.via || '/' || s.ord FROM walk w JOIN steps s ON s.target = w.target AND s.node = w.node
)
SELECT t.start, t.target, path, via, CAST(len(string_split(path, '>')) - 1 AS BIGINT) AS n_steps FROM trade t LEFT JOIN walk w ON w.start = t.start AND w.target = t.target AND w.node = t.target"""


@query("grf4_shortest", _SHORTEST)
def grf4(s, d):
    """The shortest path between every supplier and nation that trade."""
    found = paths.shortest(view(s, d, "edges"), view(s, d, "trade"))
    via = F.array_join(F.transform("via", lambda x: F.concat(F.lit("/"), x.cast("string"))), "")
    return found.select("start", "target", F.array_join("path", ">").alias("path"), via.alias("via"), (F.size("path") - 1).cast("long").alias("n_steps"))


_CLOSURE = """
WITH RECURSIVE up AS (
  SELECT child AS node, parent AS ancestor, 1 AS depth FROM taxonomy UNION ALL SELECT u.node, t.parent, u.depth + 1 FROM up u JOIN taxonomy t ON t.child = u.ancestor
)"""


@query("grf12_ancestors", f"{_CLOSURE} SELECT node, ancestor, depth FROM up")
def grf12_ancestors(s, d):
    """All ancestors of every node, however deep the tree is."""
    return hierarchy.ancestors(view(s, d, "taxonomy"))


_PREORDER = """
WITH RECURSIVE down AS (
  SELECT DISTINCT parent AS node, child AS descendant, 1 AS depth, lpad(CAST(ord AS VARCHAR), 9, '0') AS way FROM taxonomy
  UNION ALL SELECT o.node, t.child, o.depth + 1, o.way || '.' || lpad(CAST(t.ord AS VARCHAR), 9, '0') FROM down o JOIN taxonomy t ON t.parent = o.descendant
)"""


@query("grf12_descendants", f"{_PREORDER} SELECT node, descendant, depth, row_number() OVER (PARTITION BY node ORDER BY way) AS place FROM down")
def grf12_descendants(s, d):
    """All descendants of every node in pre-order."""
    links = view(s, d, "taxonomy")
    return hierarchy.descendants(links, hierarchy.ancestors(links))


@query("grf12_common", f"""{_CLOSURE}, pairs AS (SELECT a.child AS a, b.child AS b FROM taxonomy a JOIN taxonomy b ON b.ord = a.ord + 3), own AS (SELECT node, ancestor, depth FROM up UNION ALL SELECT child, child, 0 FROM taxonomy)
SELECT a, b, (SELECT arg_min(x.ancestor, x.depth) FROM own x JOIN own y ON y.ancestor = x.ancestor WHERE x.node = a AND y.node = b) AS ancestor FROM pairs""")  # fmt: skip
def grf12_common(s, d):
    """The lowest common ancestor of every node and the third one after it."""
    links = view(s, d, "taxonomy")
    pairs = links.select(F.col("child").alias("a"), "ord").join(links.select(F.col("child").alias("b"), (F.col("ord") - 3).alias("ord")), "ord")
    return hierarchy.common_ancestors(pairs, hierarchy.ancestors(links))


@query("grf11_implied", f"""{_CLOSURE}, e AS (SELECT child AS concept, 'E' || child AS id FROM taxonomy WHERE size >= 10)
SELECT a.id AS subject, b.id AS object FROM up JOIN e a ON a.concept = node JOIN e b ON b.concept = ancestor WHERE depth > 1""")
def grf11_implied(s, d):
    """IS_A of parts that are entities (size 10 or more) with all ancestors that are, beyond the parents that are known."""
    links = view(s, d, "taxonomy")
    entities = links.where("size >= 10").select(F.concat(F.lit("E"), "child").alias("id"), F.col("child").alias("concept"))
    known = links.select(F.concat(F.lit("E"), "child").alias("subject"), F.concat(F.lit("E"), "parent").alias("object"))
    return hierarchy.implied(entities, hierarchy.ancestors(links), known)
