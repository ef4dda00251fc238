"""Queries that compare entities by topic, each with SQL that must give the same rows.

Nulls: null scores count as 0, a document without country has no facts. Ties end in documents and sentences. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import comparison
from factloom.plans.catalog import _topic_sql, query, view

# amounts stand in one form only in these texts, so a plain pattern does for them
_FACTS = rf"""
lines AS (
  SELECT country AS entity, doc_id, es, ss, k AS nth, trim(regexp_replace(regexp_replace(y, '^\s*[-•]\s*', ''), '\s+', ' ', 'g')) AS x
  FROM (SELECT country, doc_id, 0.4E0 + (doc_id % 6) / 10.0E0 AS es, (doc_id % 8) / 10.0E0 AS ss, unnest(parts) AS y, generate_subscripts(parts, 1) - 1 AS k FROM (SELECT *, string_split(regexp_replace(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM reports))
), f AS (
  SELECT entity, {_topic_sql("lower(x)")} AS topic, regexp_replace(regexp_replace(x, '\b([0-9]+(?:\.[0-9]+)?)\s*percent\b', '\1%', 'g'), 'USD ([0-9]+),500 million ?', 'USD \1500000000', 'g') AS statement, es, ss, doc_id, nth FROM lines WHERE length(x) >= 15
), p AS (
  SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(statement), '[()\[\]{{}},:;!?]', ' ', 'g'), '\s+', ' ', 'g')), '\b(?:the|a|an)\b', '', 'g'), '\s+', ' ', 'g')) AS fp FROM f
), one AS (
  SELECT entity, topic, fp, arg_max(statement, (es, length(statement), -doc_id, -nth)) AS statement, least(1, greatest(0, arg_max(es, (es, length(statement), -doc_id, -nth)) * 0.6E0 + arg_max(ss, (es, length(statement), -doc_id, -nth)) * 0.4E0)) AS strength,
         count(*) AS n_merged, list_distinct(list(doc_id)) AS documents, min((doc_id, nth)) AS first FROM p GROUP BY ALL
)"""
_CELLS = rf"""{_FACTS}, num AS (
  SELECT entity, topic, string_agg(DISTINCT x, ',' ORDER BY x) AS numbers FROM (SELECT entity, topic, unnest(regexp_extract_all(statement, '\b[0-9]+(?:\.[0-9]+)?%') || regexp_extract_all(statement, '\b(?:USD|AED|PKR|EUR|GBP)\s+[0-9]+(?:\.[0-9]+)?')
    || regexp_extract_all(statement, '(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:MW|GW|TW)\b') || regexp_extract_all(statement, '\b(?:19|20)[0-9]{{2}}\b')) AS x FROM one) GROUP BY ALL
), doc AS (
  SELECT entity, topic, count(DISTINCT d) AS n_documents FROM (SELECT entity, topic, unnest(documents) AS d FROM one) GROUP BY ALL
), cell AS (
  SELECT entity, topic, count(*) AS n_facts, max(strength) AS strength, arg_max(statement, (strength, -first[1], -first[2])) AS statement FROM (SELECT * REPLACE ([first[1], first[2]] AS first) FROM one) GROUP BY ALL
), dense AS (
  SELECT entity, topic FROM (SELECT DISTINCT entity FROM one), (SELECT DISTINCT topic FROM one)
), m AS (
  SELECT entity, topic, n_facts IS NOT NULL AS has_evidence, coalesce(n_facts, 0) AS n_facts, coalesce(CAST(floor(strength * 100 + 0.5E0) AS BIGINT), 0) AS strength, statement, coalesce(numbers, '') AS numbers, coalesce(n_documents, 0) AS n_documents
  FROM dense LEFT JOIN cell USING (entity, topic) LEFT JOIN num USING (entity, topic) LEFT JOIN doc USING (entity, topic)
)"""


def _facts(s, d):
    rows = view(s, d, "reports").select(F.col("country").alias("entity"), F.col("text").alias("content"), (0.4 + (F.col("doc_id") % 6) / 10.0).alias("evidence_score"), ((F.col("doc_id") % 8) / 10.0).alias("semantic_score"), "doc_id")
    return comparison.facts(rows)


@query("agg16_merged_facts", f"WITH {_FACTS} SELECT entity, topic, fp AS fingerprint, statement, round(strength, 9) AS strength, n_merged, len(documents) AS n_documents FROM one")
def agg16(s, d):
    """Facts that say the same as one, with the stronger statement."""
    return comparison.merged(_facts(s, d)).select("entity", "topic", "fingerprint", "statement", F.round("strength", 9).alias("strength"), "n_merged", F.size("documents").alias("n_documents"))


@query("agg15_matrix", f"WITH {_CELLS} SELECT * FROM m")
def agg15(s, d):
    """What every country has on every topic."""
    return comparison.matrix(comparison.merged(_facts(s, d)))


@query("agg15_gaps", f"""WITH {_CELLS} SELECT topic, count(*) FILTER (has_evidence) AS n_with, count(*) FILTER (NOT has_evidence) AS n_without, bool_and(has_evidence) AS complete, bool_or(has_evidence) AND bool_or(NOT has_evidence) AS partial,
coalesce(string_agg(entity, ',' ORDER BY entity) FILTER (NOT has_evidence), '') AS missing FROM m GROUP BY topic""")  # fmt: skip
def agg15_gaps(s, d):
    return comparison.gaps(comparison.matrix(comparison.merged(_facts(s, d))))
