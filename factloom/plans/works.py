"""Queries on the library's catalogue as a graph, each with SQL that must give the same rows.

Nulls: null titles and texts are empty, documents without country go with any. Ties end in doc_id. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.operators import library
from factloom.plans.catalog import _AUTHORITY, query, view

_BLOB = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), replace(coalesce(topics, ''), '|', ' ')))"


def _works(s, d):
    return view(s, d, "works").withColumn("words", F.replace("topics", F.lit("|"), F.lit(" ")))


@query("jon10_cited_by", f"""SELECT a.doc_id, b.doc_id AS by FROM works a JOIN (SELECT doc_id, {_BLOB} AS blob FROM works) b ON b.doc_id <> a.doc_id AND length(trim(coalesce(a.title, ''))) >= 12 AND contains(b.blob, lower(trim(a.title))[1:40])
QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) <= 8""")  # fmt: skip
def jon10(s, d):
    """The first eight documents whose title, description or topics hold a document's title."""
    return library.cited_by(_works(s, d), ["title", "description", "words"])


_TOPICS = "list_distinct(string_split(topics, '|'))"


@query("jon8_similar_pairs", f"""SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS shared FROM (SELECT doc_id, country, {_TOPICS} AS t FROM works) a JOIN (SELECT doc_id, country, {_TOPICS} AS t FROM works) b
ON a.doc_id < b.doc_id AND (a.country IS NULL OR b.country IS NULL OR a.country = b.country) WHERE len(list_intersect(a.t, b.t)) >= 2 ORDER BY 1, 2 LIMIT 24""")  # fmt: skip
def jon8(s, d):
    """The first 24 pairs of documents of one country (or none) with two shared topics."""
    return library.similar_pairs(view(s, d, "works"))


def _list(items: list[str]) -> str:
    return ", ".join(items)


_THEMES = _list([f"CASE WHEN regexp_matches(concat_ws(' ', title, replace(topics, '|', ' ')), '(?i){'|'.join(patterns)}') THEN '{name}' END" for name, patterns in library.THEMES])
_EDGES = f"""
ten AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(document_type), 'law|regulation|decree') THEN 'implements' WHEN regexp_matches(lower(document_type), 'strategy|roadmap|policy|plan') THEN 'supports' ELSE 'mentions' END AS type,
         list_concat(list_filter([{_THEMES}], lambda x: x IS NOT NULL), list_filter(string_split(topics, '|'), lambda x: length(x) BETWEEN 3 AND 40)[1:4]) AS all_themes FROM works
), once AS (
  SELECT doc_id, type, list_filter(all_themes, lambda x, i: list_position(all_themes, x) = i)[1:5] AS themes FROM ten
), held AS (
  SELECT doc_id, type, unnest(themes) AS theme, generate_subscripts(themes, 1) AS nth FROM once
)"""


@query("fun16_themes", f"WITH {_EDGES} SELECT doc_id, theme, nth, type FROM held")
def fun16(s, d):
    """The first five themes of every document, and by which verb it belongs to them."""
    return library.theme_edges(view(s, d, "works"))


@query("grf17_relationship_graph", f"""WITH {_EDGES} SELECT 'doc:' || w.doc_id AS source, 'doc:' || w.supersedes AS target, 'supersedes' AS type FROM works w JOIN works o ON o.doc_id = w.supersedes WHERE w.doc_id <> w.supersedes
UNION SELECT 'doc:' || doc_id, 'theme:' || theme, type FROM held UNION SELECT 'doc:' || a, 'doc:' || b, 'similar' FROM (SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT doc_id, country, {_TOPICS} AS t FROM works) a
JOIN (SELECT doc_id, country, {_TOPICS} AS t FROM works) b ON a.doc_id < b.doc_id AND (a.country IS NULL OR b.country IS NULL OR a.country = b.country) WHERE len(list_intersect(a.t, b.t)) >= 2 ORDER BY 1, 2 LIMIT 24)""")  # fmt: skip
def grf17(s, d):
    """All edges of the library's graph."""
    return library.relationship_graph(view(s, d, "works"))


@query("grf17_theme_paths", f"""WITH {_EDGES}, f AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY doc_id) AS k FROM held)
SELECT x.theme, x.doc_id AS a, y.doc_id AS b, x.type AS a_type, y.type AS b_type FROM f x JOIN f y ON y.theme = x.theme AND x.k = 1 AND y.k = 2 ORDER BY x.doc_id, x.nth LIMIT 8""")  # fmt: skip
def grf17_paths(s, d):
    """From document to theme to document, for the eight themes that come up first."""
    return library.theme_paths(view(s, d, "works"))


@query("grf18_supersession", """WITH RECURSIVE w AS (SELECT doc_id, doc_id AS at, [doc_id] AS chain FROM works UNION ALL SELECT w.doc_id, o.doc_id, list_append(w.chain, o.doc_id) FROM w JOIN works c ON c.doc_id = w.at JOIN works o ON o.doc_id = c.supersedes
WHERE len(w.chain) < 8 AND NOT list_contains(w.chain, o.doc_id)) SELECT doc_id, array_to_string(arg_max(chain, len(chain)), '>') AS chain FROM w GROUP BY doc_id""")  # fmt: skip
def grf18(s, d):
    """The chain of what every document supersedes."""
    return library.chains(view(s, d, "works")).select("doc_id", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


_FILLED = " + ".join(f"CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) <> '' THEN 1 ELSE 0 END" for c in ("title", "country", "issuer", "document_type", "source_class", "published", "topics"))


@query("fun6_quality", f"""SELECT doc_id, metadata, authority, "text", chunk_points AS chunks, embedding_points AS embeddings, citations, relations, readiness, metadata + authority + "text" + chunk_points + embedding_points + citations + relations + readiness AS score
FROM (SELECT doc_id, CAST(floor(({_FILLED}) / 10.0E0 * 20 + 0.5E0) AS INT) AS metadata, CAST(floor({_AUTHORITY} / 100 * 20 + 0.5E0) AS INT) AS authority,
  CASE WHEN chars <= 0 THEN 0 WHEN pages > 0 THEN CASE WHEN chars / pages >= 800 THEN 12 WHEN chars / pages >= 300 THEN 9 WHEN chars / pages >= 80 THEN 6 ELSE 3 END WHEN chars >= 5000 THEN 12 WHEN chars >= 500 THEN 8 ELSE 4 END AS "text",
  CASE WHEN chunks >= 8 THEN 12 WHEN chunks >= 3 THEN 9 WHEN chunks >= 1 THEN 5 ELSE 0 END AS chunk_points, CASE WHEN embeddings <= 0 THEN 0 WHEN chunks > 0 AND embeddings >= chunks THEN 12 ELSE 7 END AS embedding_points,
  CASE WHEN len(string_split(topics, '|')) >= 6 THEN 8 WHEN len(string_split(topics, '|')) >= 3 THEN 5 ELSE 3 END AS citations, CASE WHEN supersedes IS NOT NULL THEN 8 ELSE 0 END AS relations,
  CASE WHEN status IN ('published', 'verified') THEN 8 WHEN status = 'pending_review' THEN 4 WHEN status = 'failed' THEN 0 ELSE 2 END AS readiness FROM works)""")  # fmt: skip
def fun6_quality(s, d):
    """Quality of every document of the catalogue, 0 to 100, with its eight parts (language, sectors, url and tags are not in it)."""
    none = F.lit(None).cast("string")
    docs = view(s, d, "works").withColumn("source_authority", scoring.authority(F.col("source_class"))).withColumn("lang", none).withColumn("sectors", none).withColumn("url", none).withColumn("n_tags", F.lit(0))
    return library.quality_score(docs.withColumnRenamed("chunks", "n_chunks").withColumnRenamed("embeddings", "n_embeddings"))
