"""Queries on the hybrid graph of entities and literal objects, each with SQL that must give the same rows.

Nulls: null confidences count as 0. Ties end in the numbers of statements. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import knowledge
from factloom.plans.catalog import query, view

_EDGES = r"""
said AS (
  SELECT f.rel_id, f.subject_id, f.predicate, f.object, n.entity_id AS object_id, f.confidence, f.source FROM literal_facts f LEFT JOIN registry n ON n.type = 'country' AND lower(n.name) = replace(f.object, '-', '_')
), e AS (
  SELECT subject_id AS source_node, lower(predicate) AS predicate, coalesce(object_id, 'OBJECT::' || regexp_replace(lower(trim(object)), '\s+', ' ', 'g')) AS target_node, object_id IS NULL AS is_literal, min(rel_id) AS edge, arg_min(object, (rel_id, object)) AS object,
         count(*) AS occurrences, avg(confidence) AS average, max(confidence) AS greatest, count(DISTINCT source) AS n_sources FROM said GROUP BY 1, 2, 3, 4
)"""


def _statements(s, d):
    known = view(s, d, "registry").where("type = 'country'").select(F.col("entity_id").alias("object_id"), F.lower("name").alias("key"))
    rows = view(s, d, "literal_facts").withColumn("key", F.replace("object", F.lit("-"), F.lit("_")))
    return rows.join(known, "key", "left").select("rel_id", "subject_id", "predicate", "object", "object_id", "confidence", "source")


@query("grf9_edges", f"WITH {_EDGES} SELECT edge, source_node, predicate, target_node, object, is_literal, occurrences, round(average, 6) AS average, greatest, n_sources FROM e")
def grf9_edges(s, d):
    """The edges of the graph, each with how often and how surely it is stated."""
    return knowledge.edges_of(_statements(s, d)).withColumn("average", F.round("average", 6))


@query("grf9_object_nodes", f"WITH {_EDGES} SELECT target_node AS node, arg_min(object, (edge, object)) AS value, count(*) AS n_edges FROM e WHERE is_literal GROUP BY 1")
def grf9_nodes(s, d):
    return knowledge.object_nodes(knowledge.edges_of(_statements(s, d)))


@query("grf9_snapshot", f"WITH {_EDGES} SELECT predicate, count(*) AS n_edges, count(*) FILTER (is_literal) AS n_literal, count(DISTINCT source_node) AS n_subjects, count(DISTINCT target_node) AS n_objects, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM e GROUP BY 1")
def grf9_snapshot(s, d):
    return knowledge.snapshot(knowledge.edges_of(_statements(s, d)))


@query("grf1_neighbours", f"""WITH {_EDGES}, a AS (SELECT source_node AS node, target_node AS other, edge, predicate, 'outgoing' AS direction FROM e WHERE NOT is_literal UNION ALL SELECT target_node, source_node, edge, predicate, 'incoming' FROM e WHERE NOT is_literal)
SELECT node, other, name, edge, predicate, direction FROM a LEFT JOIN registry ON entity_id = other""")  # fmt: skip
def grf1(s, d):
    """Neighbours of every entity, both ways, with their names."""
    return knowledge.neighbours(knowledge.edges_of(_statements(s, d)), view(s, d, "registry"))


@query("grf7_object_paths", f"WITH {_EDGES} SELECT source_node || '::' || edge AS path_id, source_node AS start, target_node AS \"end\", predicate, 1 AS depth, round(average, 6) AS confidence FROM e WHERE is_literal AND source_node IN (SELECT entity_id FROM registry)")
def grf7(s, d):
    """Paths from entities to literal objects."""
    return knowledge.one_hop(knowledge.edges_of(_statements(s, d)), view(s, d, "registry"), literal_only=True)


@query("grf8_evidence", f"WITH {_EDGES}, k AS (SELECT *, lower(predicate) AS p, coalesce(object_id, 'OBJECT::' || regexp_replace(lower(trim(object)), '\\s+', ' ', 'g')) AS t FROM said) SELECT source_node AS start, edge, e.predicate, e.object, round(average, 6) AS average, k.source, k.rel_id FROM e JOIN k ON k.subject_id = source_node AND k.p = e.predicate AND k.t = target_node")
def grf8(s, d):
    """Every statement behind every edge."""
    rows = _statements(s, d)
    return knowledge.evidence(knowledge.edges_of(rows), rows)


_WORDS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9%$€£.\- ]', ' ', 'g'), '\s+'), lambda x: length(x) > 1))"


@query("top6_relevant_facts", f"""WITH {_EDGES}, q AS (SELECT entity_id, name, CASE CAST(entity_id[2:] AS BIGINT) % 3 WHEN 0 THEN 'which energy programme supplies red gear' WHEN 1 THEN name || ' reports?' ELSE '' END AS question FROM registry), w AS (
  SELECT q.entity_id, edge, average, occurrences, n_sources, {_WORDS.format("question")} AS ws, {_WORDS.format("concat_ws(' ', name, predicate, object)")} AS ts FROM e JOIN q ON q.entity_id = source_node
), r AS (SELECT *, CASE WHEN len(ws) = 0 THEN 1E0 ELSE len(list_intersect(ws, ts)) / len(ws) END AS relevance FROM w), c AS (
  SELECT entity_id, edge, round(relevance, 6) AS relevance, round(least(1, average) * 0.45E0 + relevance * 0.35E0 + least(1, occurrences / 3) * 0.1E0 + least(1, n_sources / 2) * 0.1E0, 6) AS score FROM r)
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, edge) AS rank, edge, relevance, score FROM c QUALIFY rank <= 10""")  # fmt: skip
def top6(s, d):
    """The ten facts of every entity that answer a question about it best."""
    names = view(s, d, "registry").select("entity_id", "name", F.expr("cast(substring(entity_id, 2) as bigint) % 3").alias("k"))
    asked = names.withColumn("question", F.when(F.col("k") == 0, "which energy programme supplies red gear").when(F.col("k") == 1, F.concat("name", F.lit(" reports?"))).otherwise(""))
    return knowledge.relevant_facts(knowledge.edges_of(_statements(s, d), most_sources=False), asked, names)


@query("grf20_formatted_paths", """SELECT a.subject AS start, b.object AS target, x.name || chr(10) || '    │' || chr(10) || ' ' || a.predicate || chr(10) || '    │' || chr(10) || y.name || chr(10) || '    │' || chr(10) || ' ' || b.predicate || chr(10) || '    │' || chr(10) || z.name AS text
FROM edges a JOIN edges b ON b.subject = a.object JOIN entities x ON x.id = a.subject JOIN entities y ON y.id = a.object JOIN entities z ON z.id = b.object""")  # fmt: skip
def grf20(s, d):
    """Paths of two edges as text."""
    edges, names = view(s, d, "edges"), view(s, d, "entities")
    first, second = [edges.select(F.col("subject").alias(a), F.col("predicate").alias(p), F.col("object").alias(b)) for a, p, b in (("start", "p", "mid"), ("mid", "q", "target"))]
    rows = first.join(second, "mid")
    for c in ("start", "mid", "target"):
        rows = rows.join(names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")), c)
    return rows.select("start", "target", knowledge.formatted(F.array("start_name", "mid_name", "target_name"), F.array("p", "q")).alias("text"))
