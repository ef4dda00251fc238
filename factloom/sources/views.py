"""Driver tables and the library, graph, evidence and question views bound to them.

Each view is one SQL text that Spark and DuckDB read alike; {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: All times are measured against this one, so results don't depend on when a query runs.
AS_OF = "2025-01-01"

VIEWS = {
    "library": """
SELECT d.doc_id, d.text, d.lang, d.source AS issuer, d.n_chars, n.n_name AS country, substr(d.text, 1, 60) AS title,
       CASE d.doc_id % 9 WHEN 0 THEN 'government' WHEN 1 THEN 'international_organization' WHEN 2 THEN 'standard_body' WHEN 3 THEN 'registry' WHEN 4 THEN 'research'
            WHEN 5 THEN 'industry' WHEN 6 THEN 'customer' WHEN 7 THEN 'news' ELSE 'other' END AS source_class,
       CASE d.doc_id % 5 WHEN 0 THEN 'law' WHEN 1 THEN 'report' WHEN 2 THEN 'standard' WHEN 3 THEN 'policy' ELSE 'guideline' END AS document_type,
       CASE d.doc_id % 7 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'processing' WHEN 3 THEN 'failed' ELSE 'published' END AS status,
       CASE d.doc_id % 6 WHEN 0 THEN 'internal' WHEN 1 THEN 'private' WHEN 2 THEN 'workspace' ELSE 'public' END AS visibility,
       d.doc_id % 50 AS owner_id, d.doc_id % 10 AS workspace_id, CAST(DATE '2015-01-01' + CAST((d.doc_id * 37) % 4000 AS INT) AS DATE) AS published
FROM {documents} d LEFT JOIN {nation} n ON n.n_nationkey = d.doc_id % 25""",
    "entities": """
SELECT concat('R', r_regionkey) AS id, r_name AS name, 'region' AS kind FROM {region}
UNION ALL SELECT concat('N', n_nationkey), n_name, 'country' FROM {nation}
UNION ALL SELECT concat('S', s_suppkey), s_name, 'organization' FROM {supplier}""",
    "edges": """
SELECT concat('S', s_suppkey) AS subject, 'IS_A' AS predicate, concat('N', s_nationkey) AS object, (s_suppkey % 10) / 10.0E0 AS confidence, CAST(s_suppkey AS BIGINT) AS ord FROM {supplier}
UNION ALL SELECT concat('N', n_nationkey), 'IS_A', concat('R', n_regionkey), (n_nationkey % 10) / 10.0E0, 1000000 + n_nationkey FROM {nation}
UNION ALL SELECT concat('S', s_suppkey), 'SUPPORTS', concat('S', (s_suppkey * 7 + 3) % 50 + 1), ((s_suppkey + 5) % 10) / 10.0E0, 2000000 + s_suppkey FROM {supplier}""",
    "claims": """
SELECT event_id AS ord, concat('U', user_id % 200) AS subject, event_type AS predicate, concat('O', event_id % 7) AS object, least(value / 200.0E0, 1.0E0) AS confidence,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 = 0 AS negated,
       CASE event_id % 4 WHEN 0 THEN 'DOCUMENT' WHEN 1 THEN 'GRAPH' WHEN 2 THEN 'ONTOLOGY' ELSE 'INFERENCE' END AS stream, ts
FROM {events}""",
    "questions": """
SELECT n_nationkey * 6 + k AS id, CASE k WHEN 0 THEN concat('What is ', n_name, ' policy?') WHEN 1 THEN concat('How is ', n_name, ' related to trade?')
       WHEN 2 THEN concat('Compare ', n_name, ' and EGYPT') WHEN 3 THEN concat('Is ', n_name, ' a market?') WHEN 4 THEN concat('Show the whole list of ', n_name) ELSE concat('Tell me of ', n_name, ' storage') END AS question
FROM {nation} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) q""",
    "statements": """
SELECT l_orderkey * 10 + l_linenumber AS id, p_type AS metric, l_suppkey % 20 AS subject, CAST(l_quantity AS INT) AS amount, 2025 + l_linenumber AS year,
       CASE l_linenumber % 3 WHEN 0 THEN concat('Target of ', CAST(CAST(l_quantity AS INT) AS VARCHAR(10)), '% by ', CAST(2025 + l_linenumber AS VARCHAR(10)))
            WHEN 1 THEN concat('USD ', CAST(CAST(l_quantity AS INT) AS VARCHAR(10)), ' million for grids') ELSE concat('Adds ', CAST(CAST(l_quantity AS INT) AS VARCHAR(10)), ' GW of wind') END AS text
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
}
#: A long report for each customer with orders, from the lines of those orders: title, pages, numbered headings, lists and paragraphs with figures.
_LINES = """
SELECT o.o_custkey AS doc_id, o.o_orderdate AS day, o.o_orderkey AS part, l.l_linenumber AS line,
       concat(CASE WHEN l.l_linenumber = 1 THEN concat(CASE WHEN o.o_orderkey % 5 = 0 THEN concat('\n-- ', CAST(o.o_orderkey % 9 + 1 AS STRING), ' of 9 --\n') ELSE '' END,
       '\n', CASE WHEN o.o_orderkey % 3 = 0 THEN concat(CAST(o.o_orderkey % 7 + 1 AS STRING), '. ') ELSE '' END, 'Programme ', CAST(o.o_orderkey % 40 AS STRING), ' Outlook\n\n') ELSE '' END,
       CASE l.l_linenumber % 5 WHEN 0 THEN concat('- Target of ', CAST(CAST(l.l_quantity AS INT) AS STRING), '% renewable electricity by ', CAST(2025 + l.l_suppkey % 6 AS STRING))
         WHEN 1 THEN concat('The ', lower(p.p_type), ' programme adds ', CAST(CAST(l.l_quantity AS INT) AS STRING), ' MW of solar capacity before ', CAST(2025 + l.l_suppkey % 6 AS STRING), '. It includes ', p.p_name, '.')
         WHEN 2 THEN concat('Investment reaches USD ', CAST(CAST(l.l_quantity AS INT) AS STRING), ',500 million for grids and storage. ', p.p_name, ' is part of the ', lower(p.p_brand), ' plan!\n')
         WHEN 3 THEN concat('a) size ', CAST(p.p_size AS STRING), ' for hydrogen and ', CAST(CAST(l.l_quantity AS INT) AS STRING), ' tonnes of ', p.p_name)
         ELSE concat('Emissions fall by ', CAST(CAST(l.l_quantity AS INT) AS STRING), '.5 percent; the carbon market registry covers ', lower(p.p_type), '.') END) AS body
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey"""
_REPORT = """
SELECT b.doc_id, n.n_name AS country, b.published, concat('Plan of Customer ', CAST(b.doc_id AS STRING)) AS title, CASE b.doc_id % 4 WHEN 0 THEN 'government' WHEN 1 THEN 'registry' WHEN 2 THEN 'research' ELSE 'news' END AS source_class,
       c.c_mktsegment AS issuer, CASE b.doc_id % 7 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'failed' ELSE 'published' END AS status, concat('Plan of Customer ', CAST(b.doc_id AS STRING), '\n\n', c.c_mktsegment, ' policy overview for ', n.n_name, '.\n', b.body) AS text
FROM ({bodies}) b JOIN {customer} c ON c.c_custkey = b.doc_id JOIN {nation} n ON n.n_nationkey = c.c_nationkey"""
_BODIES = f"SELECT doc_id, CAST(max(day) AS DATE) AS published, array_join(transform(array_sort(collect_list(struct(part, line, body))), x -> x.body), '\n') AS body FROM ({_LINES}) GROUP BY doc_id"
VIEWS["reports"] = _REPORT.replace("{bodies}", _BODIES)
#: The same view where DuckDB has other words for it.
DUCK = {"reports": _REPORT.replace("{bodies}", f"SELECT doc_id, CAST(max(day) AS DATE) AS published, string_agg(body, '\n' ORDER BY part, line, body) AS body FROM ({_LINES}) GROUP BY doc_id")}
#: An answer on each report, from the returned lines of its orders: headings, bullets, citations, and figures that are partly off by one.
_SAID = """
SELECT o.o_custkey AS answer_id, o.o_orderkey AS part, l.l_linenumber AS line,
       concat(CASE l.l_suppkey % 4 WHEN 0 THEN '- ' WHEN 1 THEN '**' WHEN 2 THEN '2. ' ELSE '' END,
       CASE l.l_linenumber % 4 WHEN 0 THEN concat('The target is ', CAST(CAST(l.l_quantity AS INT) + l.l_suppkey % 3 AS STRING), '% renewable electricity by ', CAST(2025 + l.l_suppkey % 6 AS STRING))
         WHEN 1 THEN concat('The ', lower(p.p_type), ' programme adds ', CAST(CAST(l.l_quantity AS INT) + l.l_suppkey % 2 AS STRING), ' MW of solar capacity. It includes ', p.p_name, ' therefore')
         WHEN 2 THEN concat('Investment reaches USD ', CAST(CAST(l.l_quantity AS INT) AS STRING), ',500 million for storage') ELSE concat('Overall, ', p.p_name, ' compared with hydrogen gets ', CAST(CAST(l.l_quantity AS INT) + 1 AS STRING), ' tonnes') END,
       CASE l.l_suppkey % 4 WHEN 1 THEN '**' ELSE '' END, CASE l.l_partkey % 3 WHEN 0 THEN ' [CA-001].' WHEN 1 THEN ' ([CA-002])!' ELSE '.' END) AS body
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey WHERE l.l_returnflag = 'R'"""
VIEWS["answers"] = f"SELECT answer_id, concat('## Summary\n\n', array_join(transform(array_sort(collect_list(struct(part, line, body))), x -> x.body), '\n')) AS text FROM ({_SAID}) GROUP BY answer_id"
DUCK["answers"] = f"SELECT answer_id, concat('## Summary\n\n', string_agg(body, '\n' ORDER BY part, line, body)) AS text FROM ({_SAID}) GROUP BY answer_id"
#: What was retrieved for each answer: its own report and the next two of the same country.
_RETRIEVED = """
SELECT a.doc_id AS answer_id, a.place, concat('CA-00', CAST(a.place AS STRING)) AS citation_id, r.doc_id, CASE WHEN r.doc_id % 11 = 0 THEN 'Global' ELSE r.country END AS country, r.published, r.title, r.source_class, r.issuer, r.status, r.text AS content, 0.4E0 + (r.doc_id % 6) / 10.0E0 AS evidence_score, (r.doc_id % 8) / 10.0E0 AS semantic_score
FROM (SELECT doc_id, 1 AS place, doc_id AS other FROM ({reports})
      UNION ALL SELECT doc_id, 2, lead(doc_id, 1) OVER (PARTITION BY country ORDER BY doc_id) FROM ({reports})
      UNION ALL SELECT doc_id, 3, lead(doc_id, 2) OVER (PARTITION BY country ORDER BY doc_id) FROM ({reports})) a JOIN ({reports}) r ON r.doc_id = a.other"""
VIEWS["retrieved"] = _RETRIEVED.replace("{reports}", VIEWS["reports"])
DUCK["retrieved"] = _RETRIEVED.replace("{reports}", DUCK["reports"])
#: What was asked for each answer: of its own country, of another, a comparison, or of no country.
_ASKED = """
SELECT r.doc_id AS answer_id, CASE r.doc_id % 4 WHEN 0 THEN concat('What does ', r.country, ' plan?') WHEN 1 THEN concat('Is solar planned in Nation_', CAST(r.doc_id % 25 AS STRING), '?')
       WHEN 2 THEN concat('Compare worldwide targets with ', r.country, ' and nation_', CAST(r.doc_id % 25 AS STRING)) ELSE 'How large is the solar plan?' END AS question
FROM ({reports}) r"""
VIEWS["asked"] = _ASKED.replace("{reports}", VIEWS["reports"])
DUCK["asked"] = _ASKED.replace("{reports}", DUCK["reports"])
#: The catalogue of a document library: titles that others' descriptions name, topics (joined by |), what a document supersedes (with cycles), and counts of its processing.
_TITLE = "concat({0}.p_name, ' ', lower({0}.p_type), ' roadmap ', CAST({0}.p_partkey % 50 AS STRING))"
VIEWS["works"] = f"""
SELECT p.p_partkey AS doc_id, CASE WHEN p.p_partkey % 9 = 0 THEN p.p_name ELSE {_TITLE.format("p")} END AS title, CASE WHEN q.p_partkey IS NULL THEN 'Solar and wind.' ELSE concat('Builds on the ', upper({_TITLE.format("q")}), ' and net zero plans') END AS description,
       CASE WHEN p.p_partkey % 10 = 0 THEN NULL ELSE concat('NATION_', CAST(p.p_partkey % 25 AS STRING)) END AS country, p.p_brand AS issuer, CASE p.p_partkey % 6 WHEN 0 THEN 'law' WHEN 1 THEN 'strategy' WHEN 2 THEN 'report' WHEN 3 THEN 'Decree' WHEN 4 THEN 'policy' ELSE '' END AS document_type,
       CASE p.p_partkey % 4 WHEN 0 THEN 'government' WHEN 1 THEN 'registry' WHEN 2 THEN 'news' ELSE 'other' END AS source_class, CASE p.p_partkey % 5 WHEN 0 THEN 'published' WHEN 1 THEN 'verified' WHEN 2 THEN 'pending_review' WHEN 3 THEN 'failed' ELSE 'processing' END AS status,
       concat_ws('|', p.p_type, p.p_brand, split_part(p.p_name, ' ', 2), CASE p.p_partkey % 5 WHEN 0 THEN 'hydrogen storage' WHEN 1 THEN 'solar pv' WHEN 2 THEN 'carbon market registry' ELSE NULL END) AS topics,
       CASE WHEN p.p_partkey % 60 = 0 THEN p.p_partkey + 12 WHEN p.p_partkey % 6 = 0 THEN p.p_partkey - 6 ELSE NULL END AS supersedes, p.p_size % 13 AS pages, CAST(p.p_size * 171 % 9000 AS BIGINT) AS chars, p.p_size % 11 AS chunks, p.p_size % 7 AS embeddings,
       CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE CAST(DATE '2015-01-01' + CAST(p.p_partkey % 3000 AS INT) AS DATE) END AS published
FROM {{part}} p LEFT JOIN {{part}} q ON q.p_partkey = p.p_partkey - 5"""
#: A registry of entities with a few aliases, and facts about suppliers with literal objects: names, phrases, amounts, known nations, unknown subjects.
VIEWS["registry"] = """
SELECT concat('E', n_nationkey + 1) AS entity_id, n_name AS name, 'country' AS type, concat('the nation of ', n_name) AS alias, concat('COUNTRY_', n_name) AS candidate, CAST(1 AS BIGINT) AS occurrences FROM {nation}
UNION ALL SELECT concat('E', s_suppkey + 100), s_name, 'organization', concat('supplier no ', s_suppkey), concat('INITIATIVE_SUPPLIER_PROGRAMME_', s_suppkey), CAST(s_suppkey % 3 AS BIGINT) FROM {supplier}"""
VIEWS["literal_facts"] = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS rel_id, concat('E', l.l_suppkey + CASE WHEN l.l_orderkey % 40 = 0 THEN 100000000 ELSE 100 END) AS subject_id, CASE l.l_linenumber WHEN 1 THEN 'supplies' WHEN 2 THEN 'runs the' ELSE 'reports' END AS predicate,
       CASE l.l_linenumber WHEN 1 THEN p.p_name WHEN 2 THEN concat('expanding ', lower(p.p_type), ' energy Programme ', CAST(p.p_partkey % 30 AS STRING)) WHEN 3 THEN concat('USD ', CAST(CAST(l.l_quantity AS INT) AS STRING), ' million')
         WHEN 4 THEN concat('Supplier  no ', CAST(l.l_partkey % 90 AS STRING)) WHEN 5 THEN concat('nation-', CAST(l.l_partkey % 25 AS STRING)) WHEN 6 THEN concat('It includes ', p.p_name, ' and much more.') ELSE CASE WHEN l.l_suppkey % 2 = 0 THEN 'N/A' ELSE concat('Supplier Programme ', CAST(l.l_suppkey % 50 AS STRING)) END END AS object,
       CASE WHEN l.l_linenumber = 3 THEN 'currency' ELSE NULL END AS value_type, (l.l_orderkey % 10) / 10.0E0 AS confidence, l.l_orderkey AS source
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey"""
#: Raw evidence of questions in six streams, from events: predicates affirmed and negated in several ways, repeated records, missing confidences.
VIEWS["streams"] = """
SELECT user_id % 150 AS question_id, CASE event_id % 6 WHEN 0 THEN 'retrieved_chunks' WHEN 1 THEN 'document_evidence' WHEN 2 THEN 'graph_evidence' WHEN 3 THEN 'inferred_relationships' WHEN 4 THEN 'inferred_evidence' ELSE 'ontology_evidence' END AS stream, event_id AS ord,
       CASE WHEN event_id % 17 = 0 THEN 'graph' ELSE NULL END AS source_type, concat('C', user_id % 3) AS subject, CASE WHEN (user_id % 150) % 3 <> 0 THEN 'is a' WHEN event_type = 'error' THEN 'does not support' WHEN event_type = 'purchase' THEN 'supports' WHEN event_type = 'view' THEN 'is a' WHEN event_type = 'click' THEN 'Located-In' ELSE 'opposes' END AS predicate,
       CASE WHEN event_type = 'click' THEN concat('P', event_id % 2) ELSE concat('O', event_id % 5) END AS object, CASE WHEN event_id % 23 = 0 THEN 'affirms' ELSE NULL END AS polarity, event_id % 29 = 0 AND (user_id % 150) % 3 = 0 AS negated, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value / 150.0E0 - 0.1E0 END AS confidence,
       CASE WHEN event_id % 6 < 2 THEN event_id % 4 ELSE NULL END AS document_id, CASE WHEN event_id % 6 = 2 THEN event_id % 3 ELSE NULL END AS relationship_id, CASE WHEN event_id % 6 IN (3, 4) THEN 'TRANSITIVE' ELSE NULL END AS rule
FROM {events}"""
#: Texts of policies in plain sentences, from parts: named and carried subjects, several predicates, lists, protected phrases and figures.
VIEWS["policies"] = """
SELECT p_partkey AS doc_id, concat(CASE p_partkey % 4 WHEN 0 THEN 'The strategy supports ' WHEN 1 THEN 'Ministry of Energy requires ' WHEN 2 THEN 'the small plan of ' ELSE 'National Grid targets ' END, p_name, ', ', lower(p_type), ' storage, and research and development; aims to add ',
       CAST(p_size AS STRING), ' MW by ', CAST(2025 + p_partkey % 9 AS STRING), '; with ', lower(p_brand), ' meters. ', CASE p_partkey % 3 WHEN 0 THEN 'The policy will reduce emissions by ' WHEN 1 THEN 'It will cut them by ' ELSE 'And so on, by ' END, CAST(p_size AS STRING), '%. ',
       CASE WHEN p_partkey % 5 = 0 THEN 'It is late. It is late. ' ELSE '' END, 'Pakistan mobilizes USD ', CAST(p_size AS STRING), ' million for oil and gas, ', p_name, ' or wind parks! Parks of ', lower(p_type), ' • including roofs, walls and grids.') AS text
FROM {part}"""
#: Pairs of nodes of the graph that trade: suppliers of orders and the nations that they go to.
VIEWS["trade"] = """
SELECT DISTINCT concat('S', l.l_suppkey) AS start, concat('N', c.c_nationkey) AS target FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey"""
#: Trees of parts: one for each fifty, up to some forty steps deep.
VIEWS["taxonomy"] = """
SELECT concat('P', p_partkey) AS child, CASE WHEN p_partkey % 50 = 0 THEN concat('T', p_partkey DIV 50) WHEN p_partkey % 50 > 1 AND p_partkey % 7 = 0 THEN concat('P', p_partkey - 2) ELSE concat('P', p_partkey - 1) END AS parent,
       CAST(p_partkey AS BIGINT) AS ord, CAST(p_size AS BIGINT) AS size FROM {part}"""
DUCK["taxonomy"] = VIEWS["taxonomy"].replace(" DIV ", " // ")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations pages labels".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in sorted(set(re.findall(r"{(\w+)}", text)))})


def view_on(reports: DataFrame, name: str) -> DataFrame:
    """The view `retrieved` or `asked` on a table of the reports, which are then made once for all its parts."""
    return reports.sparkSession.sql({"retrieved": _RETRIEVED, "asked": _ASKED}[name].replace("({reports})", "{reports}"), reports=reports)


def retrieved_places(reports: DataFrame) -> DataFrame:
    """answer_id, place, citation_id, doc_id of the view `retrieved`, from reports(doc_id, country) without their texts."""
    after = Window.partitionBy("country").orderBy("doc_id")
    others = F.array("doc_id", F.lead("doc_id", 1).over(after), F.lead("doc_id", 2).over(after))
    rows = reports.withColumn("others", others).select(F.col("doc_id").alias("answer_id"), F.posexplode_outer("others").alias("nth", "other")).where("other is not null")
    return rows.select("answer_id", (F.col("nth") + 1).alias("place"), F.concat(F.lit("CA-00"), (F.col("nth") + 1).cast("string")).alias("citation_id"), F.col("other").alias("doc_id"))


def with_views(sql: str) -> str:
    """An oracle's SQL with the views that it names as first members of its WITH."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = ", ".join(f"{v} AS ({re.sub(r'{(\w+)}', r'\1', DUCK.get(v, VIEWS[v]))})" for v in used)
    if not used:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
