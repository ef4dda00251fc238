"""Queries on the way from evidence streams to truth status, each with SQL that must give the same rows.

Nulls: a null confidence is its source's default, null names are empty. Ties end in stream and place. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import reasoning, text
from factloom.plans.catalog import _STREAM, query, view

_NEGATED = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reasoning.NEGATED.items()) + " END"
_RECORDS = rf"""
n0 AS (
  SELECT *, CASE stream WHEN 'retrieved_chunks' THEN 0 WHEN 'document_evidence' THEN 1 WHEN 'graph_evidence' THEN 2 WHEN 'inferred_relationships' THEN 3 WHEN 'inferred_evidence' THEN 4 ELSE 5 END AS k, regexp_replace(upper(trim(predicate)), '[\s-]+', '_', 'g') AS p,
         CASE WHEN upper(source_type) IN ('DOCUMENT', 'GRAPH', 'INFERENCE', 'ONTOLOGY') THEN upper(source_type) WHEN stream IN ('retrieved_chunks', 'document_evidence') THEN 'DOCUMENT' WHEN stream = 'graph_evidence' THEN 'GRAPH' WHEN stream = 'ontology_evidence' THEN 'ONTOLOGY' ELSE 'INFERENCE' END AS source FROM streams
), n1 AS (
  SELECT question_id, k, ord, source, trim(subject) AS subject, coalesce({_NEGATED}, p) AS predicate, p AS raw_predicate, trim(object) AS object,
         CASE WHEN upper(polarity) IN ('AFFIRMS', 'NEGATES') THEN upper(polarity) WHEN negated THEN 'NEGATES' WHEN {_NEGATED} IS NOT NULL THEN 'NEGATES' ELSE 'AFFIRMS' END AS polarity,
         least(1, greatest(0, coalesce(confidence, CASE source WHEN 'GRAPH' THEN 1.0 WHEN 'INFERENCE' THEN 0.98 WHEN 'ONTOLOGY' THEN 0.96 ELSE 0.5 END))) AS confidence, coalesce(CAST(document_id AS VARCHAR), '') AS document_id, coalesce(CAST(relationship_id AS VARCHAR), '') AS relationship_id, coalesce(rule, '') AS rule
  FROM n0
)"""
_STRATEGY = r"""plan AS (
  SELECT id AS question_id, CASE WHEN regexp_matches(q, 'compare|comparison|difference|versus| vs |vs\.') THEN 'COMPARISON' WHEN regexp_matches(q, 'type|category|classify|kind of|form of|\bis\b.+\ban?\b') THEN 'REASONING' WHEN regexp_matches(q, 'how|why|relationship|related|connected|connection|link') THEN 'GRAPH'
    WHEN regexp_matches(q, 'what is|what''s|define|definition|meaning of') THEN 'ONTOLOGY' WHEN regexp_matches(q, 'what|when|where|which|who') THEN 'SEMANTIC' ELSE 'HYBRID' END AS strategy FROM (SELECT *, lower(question) AS q FROM questions)
)"""
_COLLECTED = f"""{_RECORDS}, {_STRATEGY}, kept AS (
  SELECT n1.* FROM n1 LEFT JOIN plan USING (question_id) WHERE strategy IS NULL OR k < 2 OR (k = 2 AND strategy NOT IN ('SEMANTIC', 'ONTOLOGY')) OR (k IN (3, 4) AND strategy IN ('REASONING', 'HYBRID', 'COMPARISON')) OR (k = 5 AND strategy IN ('ONTOLOGY', 'REASONING', 'HYBRID', 'COMPARISON'))
), once AS (
  SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY question_id, lower(source), lower(subject), lower(predicate), lower(object), polarity, lower(document_id), lower(relationship_id), lower(rule) ORDER BY k, ord) = 1
), found AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, k, ord) AS rank FROM once
)"""
_CLASH = f"""{_COLLECTED}, side AS (
  SELECT question_id, subject, predicate, object, bool_or(polarity = 'AFFIRMS') AS yes, bool_or(polarity = 'NEGATES') AS no FROM found GROUP BY ALL
), polar AS (
  SELECT question_id, 'polarity' AS kind, subject, predicate, object FROM side WHERE yes AND no
), clash AS (
  SELECT * FROM polar UNION ALL SELECT question_id, 'object', subject, predicate, '' FROM side s WHERE yes AND predicate NOT IN ('IS_A', 'PART_OF', 'RELATED_TO', 'SUPPORTED_BY', 'REGULATED_BY', 'USES', 'PRODUCES')
  AND NOT EXISTS (SELECT 1 FROM polar WHERE polar.question_id = s.question_id AND polar.subject = s.subject AND polar.predicate = s.predicate) GROUP BY question_id, subject, predicate HAVING count(*) > 1
)"""


def _plans(s, d):
    return view(s, d, "questions").select(F.col("id").alias("question_id"), text.strategy(F.col("question")).alias("strategy"))


@query("fun11_evidence_records", f"WITH {_RECORDS} SELECT question_id, k AS stream, ord, source, subject, predicate, raw_predicate, object, polarity, round(confidence, 9) AS confidence, document_id, relationship_id, rule FROM n1")
def fun11(s, d):
    """Records of all six streams, brought into one form."""
    rows = reasoning.normalised(view(s, d, "streams"))
    return rows.select("question_id", "seq.stream", "seq.ord", *rows.columns[2:]).withColumn("confidence", F.round("confidence", 9))


@query("agg6_collected", f"WITH {_COLLECTED} SELECT question_id, rank, k AS stream, ord, source, predicate, polarity, round(confidence, 9) AS confidence FROM found")
def agg6_collected(s, d):
    """The evidence of every question that its plan wants, each once, ranked."""
    rows = reasoning.collected(reasoning.planned(reasoning.normalised(view(s, d, "streams")), _plans(s, d)))
    return rows.select("question_id", "rank", "seq.stream", "seq.ord", "source", "predicate", "polarity", F.round("confidence", 9).alias("confidence"))


@query("flt5_planned_streams", f"WITH {_COLLECTED} SELECT question_id, strategy, count(*) FILTER (k < 2) AS n_document, count(*) FILTER (k = 2) AS n_graph, count(*) FILTER (k IN (3, 4)) AS n_inference, count(*) FILTER (k = 5) AS n_ontology FROM kept JOIN plan USING (question_id) GROUP BY ALL")
def flt5_planned(s, d):
    """How many records of each stream a question's plan lets through."""
    kept, plans = reasoning.planned(reasoning.normalised(view(s, d, "streams")), _plans(s, d)), _plans(s, d)
    k = F.col("seq.stream")
    rows = kept.join(plans, "question_id").groupBy("question_id", "strategy")
    return rows.agg(F.count_if(k < 2).alias("n_document"), F.count_if(k == 2).alias("n_graph"), F.count_if(k.isin(3, 4)).alias("n_inference"), F.count_if(k == 5).alias("n_ontology"))


@query("orc2_reasoning", f"""WITH {_CLASH}, mean AS (SELECT question_id, sum(confidence * w) / sum(w) AS mean, count(*) AS n FROM (SELECT *, {_STREAM.replace("stream", "source")} AS w FROM found) GROUP BY 1), said AS (
  SELECT question_id, string_agg(source || ' ' || subject || ' ' || raw_predicate || ' ' || object || '.', '|' ORDER BY rank) AS lines FROM found WHERE rank <= 8 GROUP BY 1
), bad AS (SELECT question_id, count(*) AS bad, string_agg(x, '|' ORDER BY x) AS against FROM (SELECT question_id, 'Conflict: ' || subject || ' ' || predicate || ' ' || CASE WHEN object = '' THEN 'multiple objects' ELSE object END || '.' AS x FROM clash) GROUP BY 1), v AS (
  SELECT plan.question_id, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, round(coalesce(mean, 0) * CASE WHEN coalesce(bad, 0) > 0 THEN 0.45E0 ELSE 1E0 END, 9) AS c, concat_ws('|', lines, against) AS lines FROM plan LEFT JOIN mean USING (question_id) LEFT JOIN said USING (question_id) LEFT JOIN bad USING (question_id))
SELECT question_id, n AS n_evidence, bad AS n_conflicts, round(c, 6) AS confidence, CASE WHEN n = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN bad > 0 THEN 'CONFLICTING' WHEN c >= 0.75 THEN 'SUPPORTED' WHEN c >= 0.45 THEN 'PARTIALLY_SUPPORTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status,
CASE WHEN n = 0 THEN 'Insufficient evidence to support a confident statement.' WHEN bad > 0 THEN 'Contradictory evidence prevents a single confident conclusion.' WHEN c >= 0.75 THEN 'Evidence consistently supports the claim.' WHEN c >= 0.45 THEN 'Evidence partially supports the claim.'
ELSE 'Available evidence is weak or incomplete.' END AS summary, lines FROM v""")  # fmt: skip
def orc2(s, d):
    """The whole way for every question: plan, evidence, conflicts, confidence, status and explanation."""
    return reasoning.reasoned(view(s, d, "streams"), _plans(s, d)).withColumn("lines", F.array_join("lines", "|"))
