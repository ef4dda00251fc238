"""Queries on graph reasoning, document truth, lookups and dashboards, each with SQL that must give the same rows.

Some of them are short forms on single tables; the whole rules are in answers, figures, verdicts, claims, works and knowledge.

Nulls: a null confidence passes filters and counts as 1 in products; null names compare as unequal. Ties always end in an
id, so results are the same in every run. Empty tables give no rows, or one row of zeros for plain totals.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.plans.catalog import AS_OF, query, table, view

_AUTHORITATIVE = ["government", "un", "registry", "standard_body", "international_organization"]
_CLASSES = "('government', 'un', 'registry', 'standard_body', 'international_organization')"


def _six(c: Column) -> Column:
    return F.round(c, 6)


@query("agg11_graph_summary", "SELECT count(*) AS edges, count(DISTINCT subject) AS out_entities, count(DISTINCT object) AS object_nodes, count(DISTINCT predicate) AS predicates, (SELECT count(*) FROM entities) AS nodes FROM edges")
def agg11(s, d):
    e = view(s, d, "edges").agg(F.count("*").alias("edges"), F.count_distinct("subject").alias("out_entities"), F.count_distinct("object").alias("object_nodes"), F.count_distinct("predicate").alias("predicates"))
    return e.join(F.broadcast(view(s, d, "entities").agg(F.count("*").alias("nodes"))), F.lit(True))  # one row each


@query("agg12_fact_groups", "SELECT predicate, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, round(avg(0.65E0 * coalesce(confidence, 1) + 0.35E0), 6) AS avg_score FROM edges GROUP BY predicate")
def agg12(s, d):
    """Facts by predicate; a fact is a path of one edge, so its score is .65 confidence + .2 + .15."""
    return view(s, d, "edges").groupBy("predicate").agg(F.count("*").alias("n"), _six(F.avg("confidence")).alias("avg_confidence"), _six(F.avg(0.65 * F.coalesce("confidence", F.lit(1.0)) + 0.35)).alias("avg_score"))


@query("agg13_reasoning_confidence", """SELECT subject, round(c, 6) AS confidence, CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.65 THEN 'moderate' WHEN c < 0.35 THEN 'insufficient' ELSE 'low' END AS label
FROM (SELECT subject, greatest(0, least(1, 0.55E0 * avg(confidence) + 0.2E0 * min(confidence) + 0.25E0 * (count(DISTINCT stream) / 4.0E0) - 0.35E0 * least(count(*) FILTER (WHERE negated) * 1.0E0 / count(*), 1))) AS c FROM claims GROUP BY subject)""")
def agg13(s, d):
    """Coverage is the share of the four streams that speak of the subject; negated claims are its conflicts."""
    c = 0.55 * F.avg("confidence") + 0.2 * F.min("confidence") + 0.25 * (F.count_distinct("stream") / 4.0) - 0.35 * F.least(F.count_if(F.col("negated")) / F.count("*"), F.lit(1.0))
    rows = view(s, d, "claims").groupBy("subject").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("c"))
    return rows.select("subject", _six(F.col("c")).alias("confidence"), F.when(F.col("c") >= 0.85, "high").when(F.col("c") >= 0.65, "moderate").when(F.col("c") < 0.35, "insufficient").otherwise("low").alias("label"))


_UP = "SELECT a.subject, b.object, 'IS_A' AS predicate FROM edges a JOIN edges b ON a.object = b.subject AND b.predicate = 'IS_A' WHERE a.predicate = 'IS_A'"


@query("set2_inference", f"SELECT DISTINCT subject, predicate, object FROM ({_UP} UNION ALL SELECT subject, object, predicate FROM edges WHERE predicate = 'IS_A')")
def set2(s, d):
    """Transitive and ontology inference together, once for each relationship key."""
    isa = view(s, d, "edges").where("predicate = 'IS_A'").select("subject", "predicate", "object")
    onward = isa.select(F.col("subject").alias("object"), F.col("object").alias("far"))
    far = isa.join(onward, "object").select("subject", "predicate", F.col("far").alias("object"))
    return isa.unionByName(far).distinct()


@query("set4_support_split", """SELECT subject, predicate, count(*) FILTER (WHERE NOT clash) AS supporting, count(*) FILTER (WHERE clash) AS conflicting
FROM (SELECT subject, predicate, bool_or(negated) OVER w AND bool_or(NOT negated) OVER w AS clash FROM claims WINDOW w AS (PARTITION BY subject, predicate, object)) GROUP BY subject, predicate""")
def set4(s, d):
    """Evidence on both sides of one statement is conflicting, all other supports."""
    sides = view(s, d, "claims").groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"), (F.bool_or("negated") & F.bool_or(~F.col("negated"))).alias("clash"))
    count = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    return sides.groupBy("subject", "predicate").agg(count(~F.col("clash")).alias("supporting"), count(F.col("clash")).alias("conflicting"))


@query("grf6_one_hop", """SELECT 'out' AS side, object AS other, predicate, round(confidence, 6) AS confidence FROM edges WHERE subject = 'N4' AND (confidence >= 0.2 OR confidence IS NULL)
UNION ALL SELECT 'in', subject, predicate, round(confidence, 6) FROM edges WHERE lower(object) = 'n4' AND (confidence >= 0.2 OR confidence IS NULL)""")
def grf6(s, d):
    e = view(s, d, "edges").where("confidence >= 0.2 or confidence is null")
    shown = lambda df, side, other: df.select(F.lit(side).alias("side"), F.col(other).alias("other"), "predicate", _six(F.col("confidence")).alias("confidence"))
    return shown(e.where("subject = 'N4'"), "out", "object").unionByName(shown(e.where("lower(object) = 'n4'"), "in", "subject"))


@query("flt7_multihop_filter", "SELECT subject, predicate, object FROM edges WHERE predicate IN ('IS_A', 'SUPPORTS') AND (confidence IS NULL OR confidence >= 0.6) AND object IN (SELECT id FROM entities)")
def flt7(s, d):
    """Edges between entities (others are dropped) of the asked predicates; a null confidence passes."""
    e = view(s, d, "edges").where("predicate in ('IS_A', 'SUPPORTS') and (confidence is null or confidence >= 0.6)")
    return e.join(view(s, d, "entities").select(F.col("id").alias("object")), "object", "left_semi").select("subject", "predicate", "object")


_CHAIN = """SELECT e.id, p.object AS parent, g.object AS grandparent FROM entities e LEFT JOIN edges p ON p.subject = e.id AND p.predicate = 'IS_A' LEFT JOIN edges g ON g.subject = p.object AND g.predicate = 'IS_A'"""


@query("grf12_hierarchy", f"""SELECT id, parent, CASE WHEN parent IS NULL THEN '' WHEN grandparent IS NULL THEN parent ELSE parent || '>' || grandparent END AS ancestors, coalesce(n, 0) AS children
FROM ({_CHAIN}) LEFT JOIN (SELECT object AS id, count(*) AS n FROM edges WHERE predicate = 'IS_A' GROUP BY object) c USING (id)""")
def grf12(s, d):
    """Parent, ancestors (nearest first; supplier, country and region are three levels) and number of children of every entity."""
    isa = view(s, d, "edges").where("predicate = 'IS_A'").select("subject", "object")
    up = lambda a, b: isa.select(F.col("subject").alias(a), F.col("object").alias(b))
    rows = view(s, d, "entities").select("id").join(up("id", "parent"), "id", "left").join(up("parent", "grandparent"), "parent", "left")
    children = isa.groupBy(F.col("object").alias("id")).agg(F.count("*").alias("n"))
    return rows.join(children, "id", "left").select("id", "parent", F.concat_ws(">", "parent", "grandparent").alias("ancestors"), F.coalesce("n", F.lit(0)).alias("children"))


@query("grf11_ontology_inference", f"SELECT id, 'IS_A' AS predicate, ancestor FROM (SELECT id, unnest([parent, grandparent]) AS ancestor FROM ({_CHAIN})) WHERE ancestor IN (SELECT id FROM entities)")
def grf11(s, d):
    """All ancestors of an entity that are entities themselves."""
    rows = grf12(s, d).select("id", F.explode(F.split("ancestors", ">")).alias("ancestor"))
    known = view(s, d, "entities").select(F.col("id").alias("ancestor"))
    return rows.join(known, "ancestor", "left_semi").select("id", F.lit("IS_A").alias("predicate"), "ancestor")


_TWO = """SELECT a.subject, a.object AS via, b.object AS target, coalesce(a.confidence, 1) * coalesce(b.confidence, 1) AS c FROM edges a JOIN edges b ON a.object = b.subject AND b.object <> a.subject WHERE a.predicate = 'SUPPORTS'"""


@query("top3_path_scores", f"""SELECT subject, via, target, round(c, 6) AS confidence, round(0.65E0 * c + 0.2E0 / 2 + 0.15E0, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(0.65E0 * c + 0.2E0 / 2 + 0.15E0, 6) DESC, round(c, 6) DESC, via, target) AS rank FROM ({_TWO})) WHERE rank <= 10""")
def top3(s, d):
    """Two-edge paths by score, confidence and ids, numbered for each start; every edge brings one piece of evidence."""
    e, conf = view(s, d, "edges"), lambda c: F.coalesce(F.col(c), F.lit(1.0))
    first = e.where("predicate = 'SUPPORTS'").select("subject", F.col("object").alias("via"), F.col("confidence").alias("c1"))
    second = e.select(F.col("subject").alias("via"), F.col("object").alias("target"), F.col("confidence").alias("c2"))
    rows = first.join(second, "via").where("target <> subject").withColumn("c", conf("c1") * conf("c2"))
    rows = rows.select("subject", "via", "target", _six(F.col("c")).alias("confidence"), _six(0.65 * F.col("c") + F.lit(0.2) / 2 + 0.15).alias("score"))
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("score"), F.desc("confidence"), "via", "target"))
    return rows.withColumn("rank", rank).where("rank <= 10")


@query("agg9_evidence_summary", f"""SELECT country, count(*) AS n_evidence, count(DISTINCT doc_id) AS n_documents, count(DISTINCT source_class) AS n_classes, count(*) FILTER (WHERE source_class IN {_CLASSES}) AS authoritative, max(n_chars) AS longest FROM library GROUP BY country""")
def agg9(s, d):
    return view(s, d, "library").groupBy("country").agg(
        F.count("*").alias("n_evidence"), F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("source_class").alias("n_classes"),
        F.count_if(F.col("source_class").isin(_AUTHORITATIVE)).alias("authoritative"), F.max("n_chars").alias("longest"),
    )


@query("fun14_document_truth", f"""SELECT country, issuer, CASE WHEN n_conflicts > 0 THEN 'conflicting_evidence' WHEN (docs >= 2 AND c >= 0.8 AND (auth >= 1 OR verified >= 2)) OR (n >= 2 AND c >= 0.5) THEN 'supported' WHEN n >= 1 AND c >= 0.5 THEN 'partially_supported' ELSE 'insufficient_evidence' END AS code
FROM (SELECT country, issuer, count(*) AS n, count(DISTINCT doc_id) AS docs, avg(CASE WHEN status IN ('verified', 'published') THEN 0.9E0 ELSE 0.3E0 END) AS c, count(*) FILTER (WHERE source_class IN {_CLASSES}) AS auth,
count(*) FILTER (WHERE status IN ('verified', 'published')) AS verified, CASE WHEN bool_or(status = 'failed') AND bool_or(status = 'verified') THEN 1 ELSE 0 END AS n_conflicts FROM library GROUP BY country, issuer)""")
def fun14(s, d):
    """Truth status of the evidence of a country and issuer; a failed and a verified document of one issuer conflict."""
    ok = F.col("status").isin("verified", "published")
    rows = view(s, d, "library").groupBy("country", "issuer").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.avg(F.when(ok, 0.9).otherwise(0.3)).alias("c"), F.count_if(F.col("source_class").isin(_AUTHORITATIVE)).alias("auth"),
        F.count_if(ok).alias("verified"), (F.bool_or(F.col("status") == "failed") & F.bool_or(F.col("status") == "verified")).alias("clash"),
    )
    supported = "(docs >= 2 and c >= 0.8 and (auth >= 1 or verified >= 2)) or (n >= 2 and c >= 0.5)"
    code = F.when(F.col("clash"), "conflicting_evidence").when(F.expr(supported), "supported").when(F.expr("n >= 1 and c >= 0.5"), "partially_supported").otherwise("insufficient_evidence")
    return rows.select("country", "issuer", code.alias("code"))


@query("top8_citations", """SELECT country, doc_id, number, concat_ws(' · ', nullif(trim(issuer), ''), nullif(document_type, ''), CAST(year(published) AS VARCHAR)) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY published DESC, doc_id) AS number FROM (SELECT country, doc_id, min(issuer) AS issuer, min(document_type) AS document_type, max(published) AS published FROM library WHERE status IN ('verified', 'published') AND doc_id IS NOT NULL GROUP BY country, doc_id)) WHERE number <= 12""")
def top8(s, d):
    """One citation a document in rank order, twelve at most for each country."""
    docs = view(s, d, "library").where("status in ('verified', 'published') and doc_id is not null").groupBy("country", "doc_id").agg(F.min("issuer").alias("issuer"), F.min("document_type").alias("document_type"), F.max("published").alias("published"))
    number = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("published"), "doc_id"))
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return docs.withColumn("number", number).where("number <= 12").select("country", "doc_id", "number", F.concat_ws(" · ", filled("issuer"), filled("document_type"), F.year("published").cast("string")).alias("label"))


@query("flt11_chips", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND contains(lower(concat_ws(' ', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)), lower('Urgent'))")
def flt11(s, d):
    shown = F.lower(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))
    return table(s, d, "orders").where((F.col("o_orderstatus") == "O") & shown.contains("urgent")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("agg19_user_dashboard", "SELECT o_custkey AS user_id, count(*) AS projects, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_projects, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed_projects, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, round(sum(o_totalprice), 2) AS tons FROM orders GROUP BY o_custkey")
def agg19(s, d):
    one = lambda c, v, name: F.count_if(F.col(c) == v).alias(name)
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count("*").alias("projects"), one("o_orderstatus", "O", "open_projects"), one("o_orderstatus", "F", "closed_projects"), one("o_orderpriority", "1-URGENT", "urgent"), F.round(F.sum("o_totalprice"), 2).alias("tons")
    )


@query("agg23_unread", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS unread, count(*) FILTER (WHERE event_type = 'purchase') AS watched, count(*) AS n FROM events GROUP BY user_id")
def agg23(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("unread"), F.count_if(F.col("event_type") == "purchase").alias("watched"), F.count("*").alias("n"))


@query("snk3_access_fields", "SELECT e.vec_id, l.visibility, l.owner_id, l.workspace_id FROM embeddings e JOIN library l ON l.doc_id = e.vec_id")
def snk3(s, d):
    """Access fields of a document written through to its vectors."""
    fields = view(s, d, "library").select(F.col("doc_id").alias("vec_id"), "visibility", "owner_id", "workspace_id")
    return table(s, d, "embeddings").select("vec_id").join(fields, "vec_id")


@query("api1_lookup", "SELECT id, name, kind FROM entities WHERE id = 'R1' OR lower(name) = lower('France') OR kind = 'region'")
def api1(s, d):
    return view(s, d, "entities").where("id = 'R1' or lower(name) = lower('France') or kind = 'region'").select("id", "name", "kind")


@query("api2_listing", "SELECT kind, count(*) AS size, min(id) AS first_id, max(id) AS last_id FROM entities GROUP BY kind")
def api2(s, d):
    return view(s, d, "entities").groupBy("kind").agg(F.count("*").alias("size"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("win3_carry_forward", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inherited FROM events")
def win3(s, d):
    """What has no subject of its own inherits the last one before it."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(s, d, "events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(own).alias("inherited"))


@query("flt5_stream_pruning", "SELECT q.id, c.stream, count(*) AS n FROM (SELECT id, id % 4 AS plan FROM questions WHERE id < 24) q JOIN claims c ON c.ord % 24 = q.id AND ((q.plan = 0 AND c.stream = 'DOCUMENT') OR (q.plan = 1 AND c.stream IN ('GRAPH', 'ONTOLOGY')) OR q.plan >= 2) GROUP BY q.id, c.stream")
def flt5(s, d):
    """Evidence of the streams that a question's plan enables: documents only, graph and ontology, or all."""
    enabled = F.when(F.col("id") % 4 == 0, F.array(F.lit("DOCUMENT"))).when(F.col("id") % 4 == 1, F.array(F.lit("GRAPH"), F.lit("ONTOLOGY"))).otherwise(F.array(*map(F.lit, ("DOCUMENT", "GRAPH", "ONTOLOGY", "INFERENCE"))))
    plans = view(s, d, "questions").where("id < 24").select("id", F.explode(enabled).alias("stream"))
    claims = view(s, d, "claims").groupBy((F.col("ord") % 24).alias("id"), "stream").agg(F.count("*").alias("n"))
    return claims.join(plans, ["id", "stream"]).select("id", "stream", "n")


@query("fun6_document_quality", """SELECT doc_id, CAST((CASE WHEN trim(coalesce(title, '')) <> '' THEN 20 ELSE 0 END) + (CASE WHEN n_chars >= 500 THEN 20 ELSE 0 END) + (CASE WHEN country IS NOT NULL THEN 12 ELSE 0 END) + (CASE WHEN published IS NOT NULL THEN 12 ELSE 0 END)
+ (CASE WHEN issuer IS NOT NULL THEN 12 ELSE 0 END) + (CASE WHEN document_type IS NOT NULL THEN 8 ELSE 0 END) + (CASE WHEN status IN ('verified', 'published') THEN 8 ELSE 0 END) + (CASE WHEN source_class <> 'other' THEN 8 ELSE 0 END) AS INT) AS quality FROM library""")
def fun6(s, d):
    """Document quality from 0 to 100: eight parts of 20, 20, 12, 12, 12, 8, 8 and 8."""
    parts = [
        (20, F.trim(F.coalesce("title", F.lit(""))) != ""), (20, F.col("n_chars") >= 500), (12, F.col("country").isNotNull()), (12, F.col("published").isNotNull()),
        (12, F.col("issuer").isNotNull()), (8, F.col("document_type").isNotNull()), (8, F.col("status").isin("verified", "published")), (8, F.col("source_class") != "other"),
    ]
    return view(s, d, "library").select("doc_id", sum((F.when(hit, n).otherwise(0) for n, hit in parts), F.lit(0)).cast("int").alias("quality"))


@query("top9_markets", "SELECT r_name AS region, n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY region, name")
def top9(s, d):
    return table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("name")).orderBy("region", "name")
