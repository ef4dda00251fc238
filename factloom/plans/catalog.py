"""The library's queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.operators import evidence, graph, retrieval, text
from factloom.operators.numbering import numbered
from factloom.sources.views import AS_OF, table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is any."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register


def _query_vector(s: SparkSession, d: str) -> list[float]:
    return table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_OPEN = "status IN ('verified', 'published') AND visibility = 'public'"
_AUTHORITY = "CASE source_class WHEN 'government' THEN 100.0 WHEN 'international_organization' THEN 96.0 WHEN 'standard_body' THEN 95.0 WHEN 'registry' THEN 94.0 WHEN 'research' THEN 90.0 WHEN 'industry' THEN 80.0 WHEN 'customer' THEN 70.0 WHEN 'news' THEN 60.0 ELSE 45.0 END"
_STATUS = "CASE status WHEN 'verified' THEN 1.0 WHEN 'published' THEN 0.9 WHEN 'pending_review' THEN 0.45 WHEN 'processing' THEN 0.25 WHEN 'failed' THEN 0.0 ELSE 0.35 END"
_AGE = f"date_diff('day', published, DATE '{AS_OF}')"
_RANK_FRESH = f"CASE WHEN published IS NULL THEN 0.4 WHEN {_AGE} <= 365 THEN 1.0 WHEN {_AGE} <= 730 THEN 0.9 WHEN {_AGE} <= 1095 THEN 0.8 WHEN {_AGE} <= 1825 THEN 0.65 WHEN {_AGE} <= 3650 THEN 0.5 ELSE 0.35 END"
_YEARS = f"greatest({_AGE}, 0) / 365.25"
_SOURCE_FRESH = f"CASE WHEN published IS NULL THEN 0.0 WHEN {_YEARS} <= 1 THEN 1.0 WHEN {_YEARS} <= 2 THEN 0.9 WHEN {_YEARS} <= 3 THEN 0.8 WHEN {_YEARS} <= 5 THEN 0.65 WHEN {_YEARS} <= 8 THEN 0.45 ELSE 0.25 END"
_META = "(" + " + ".join(f"CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) <> '' THEN 1 ELSE 0 END" for c in ("title", "country", "issuer", "document_type", "source_class", "published")) + ") / 6.0"
_STREAM = "CASE stream WHEN 'DOCUMENT' THEN 1.0 WHEN 'GRAPH' THEN 0.98 WHEN 'ONTOLOGY' THEN 0.95 ELSE 0.9 END"
_DEDUP_KEY = "subject, predicate, object, stream, negated"


@query("evidence_topk", f"""
SELECT doc_id, round(similarity, 6) AS similarity, round(0.38 * similarity + 0.30 * least({_AUTHORITY} / 100 + CASE WHEN source_class = 'government' THEN 0.03 ELSE 0 END, 1) + 0.12 * {_STATUS}
  + 0.10 * {_RANK_FRESH} + 0.05 * {_META} + 0.05 * content, 6) AS score
FROM (SELECT l.*, {_COS} AS similarity, CASE WHEN length(text) = 0 THEN 0 ELSE CASE WHEN length(text) >= 200 THEN 0.25 ELSE 0 END + CASE WHEN length(text) >= 500 THEN 0.2 ELSE 0 END
  + CASE WHEN length(text) <= 5000 THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(text, '[.!?]') THEN 0.15 ELSE 0 END + 0.1 END AS content
  FROM library l JOIN embeddings e ON e.vec_id = l.doc_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_OPEN})
ORDER BY round(similarity, 9) DESC, doc_id LIMIT 40""")  # fmt: skip
def evidence_topk(s, d):
    """Access filter, vector top-k, join with documents and evidence rank (TOP1, JON1, FLT1, TOP2)."""
    docs = view(s, d, "library").where(retrieval.access())
    # ids and vectors only until the best are known; then those few rows fetch their documents
    vectors = table(s, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "embedding")
    best = retrieval.vector_topk(vectors, _query_vector(s, d), 40).select(F.col("vec_id").alias("doc_id"), "similarity")
    near = docs.join(F.broadcast(best), "doc_id")
    return retrieval.ranked(near, AS_OF).select("doc_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query("top1_vector_topk", f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round({_COS}, 9) DESC, e.vec_id LIMIT 10")
def top1(s, d):
    return retrieval.vector_topk(table(s, d, "embeddings"), _query_vector(s, d), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("flt1_access", "SELECT doc_id, visibility, status FROM library WHERE status IN ('verified', 'published') AND (visibility = 'public' OR (visibility = 'private' AND owner_id = 7) OR (visibility = 'workspace' AND workspace_id = 8))")
def flt1(s, d):
    return view(s, d, "library").where(retrieval.access(user_id=7, workspace_id=8)).select("doc_id", "visibility", "status")


@query("flt3_facets", "SELECT doc_id, country, published FROM library WHERE lower(country) LIKE '%on_1%' AND document_type = 'report' AND published >= DATE '2020-01-01' AND published < DATE '2021-01-01' ORDER BY published DESC, doc_id LIMIT 100")
def flt3(s, d):
    return view(s, d, "library").where("lower(country) LIKE '%on_1%' AND document_type = 'report' AND published >= DATE '2020-01-01' AND published < DATE '2021-01-01'").orderBy(F.desc("published"), "doc_id").limit(100).select("doc_id", "country", "published")


@query("flt4_country_scope", "SELECT q.id, q.question, n.n_name AS country, count(l.doc_id) AS n_docs FROM questions q JOIN nation n ON regexp_matches(lower(q.question), '\\b' || lower(n.n_name) || '\\b') LEFT JOIN library l ON l.country = n.n_name GROUP BY ALL")
def flt4(s, d):
    """Countries that a question names, and how many documents that scope keeps."""
    per = view(s, d, "library").groupBy("country").agg(F.count("*").alias("n"))
    names = F.broadcast(table(s, d, "nation").select(F.col("n_name").alias("country")))  # 25 fixed rows
    hits = view(s, d, "questions").join(names, F.expr(r"rlike(lower(question), concat('\\b', lower(country), '\\b'))"))
    return hits.join(per, "country", "left").select("id", "question", "country", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query("flt6_edge_filter", "SELECT subject, object, round(confidence, 6) AS confidence FROM edges WHERE predicate = 'IS_A' AND confidence >= 0.5")
def flt6(s, d):
    return view(s, d, "edges").where("predicate = 'IS_A' AND confidence >= 0.5").select("subject", "object", F.round("confidence", 6).alias("confidence"))


@query("flt8_metadata_lines", rf"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE v = '' OR regexp_matches(v, '^page [0-9]+') OR (NOT regexp_matches(v, '{text.DATE}') AND (regexp_matches(v, '^({"|".join(text.METADATA_PREFIXES)})') OR regexp_matches(v, '{"|".join(text.METADATA_PARTS)}')))) AS n_metadata
FROM (SELECT doc_id, lower(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g'))) AS v FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY doc_id""")
def flt8(s, d):
    """Metadata lines of each document: empty, page, then any date keeps a line, then prefixes and parts. No exchange of lines."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))))
    return table(s, d, "documents").where("text is not null").select("doc_id", lines.alias("v")).groupBy("doc_id").agg(F.sum(F.size("v")).alias("n_lines"), F.sum(F.size(F.filter("v", text.is_metadata))).alias("n_metadata"))


@query("prj2_context", "SELECT issuer, doc_id, 'CA-' || lpad(CAST(rn AS VARCHAR), 3, '0') AS block, chars_upto FROM (SELECT issuer, doc_id, row_number() OVER (PARTITION BY issuer ORDER BY doc_id) AS rn, CAST(sum(length(text)) OVER (PARTITION BY issuer ORDER BY doc_id) AS BIGINT) AS chars_upto FROM library) WHERE chars_upto <= 30000")
def prj2(s, d):
    """Numbered blocks of each issuer's documents until the context window of 30,000 characters is full (the window is the feature)."""
    w = Window.partitionBy("issuer").orderBy("doc_id")
    hits = view(s, d, "library").select("issuer", "doc_id", F.length("text").alias("chars"))
    hits = hits.withColumn("rn", F.row_number().over(w)).withColumn("chars_upto", F.sum("chars").over(w))
    return hits.where("chars_upto <= 30000").select("issuer", "doc_id", F.format_string("CA-%03d", "rn").alias("block"), "chars_upto")


@query("prj3_conversation", "SELECT conv_id, turn, role, substr(trim(text), 1, 4000) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def prj3(s, d):
    rows = table(s, d, "conversations").where("role IN ('user', 'assistant') AND trim(text) <> ''")
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("at <= 6").select("conv_id", "turn", "role", F.substring(F.trim("text"), 1, 4000).alias("text"))


@query("jon2_left_populate", "SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def jon2(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query("jon4_transitive", "SELECT DISTINCT a.subject, b.object FROM edges a JOIN edges b ON a.object = b.subject AND a.predicate = 'IS_A' AND b.predicate = 'IS_A' WHERE a.subject <> b.object AND NOT EXISTS (SELECT 1 FROM edges k WHERE k.predicate = 'IS_A' AND k.subject = a.subject AND k.object = b.object)")
def jon4(s, d):
    return graph.composed(view(s, d, "edges"))


@query("jon5_link_cascade", "SELECT p_type AS object, count(*) AS n, min(CASE WHEN e.name IS NOT NULL THEN 'canonical_name' ELSE 'none' END) AS match_type FROM part LEFT JOIN entities e ON lower(e.name) = lower(split_part(p_type, ' ', 1)) GROUP BY p_type")
def jon5(s, d):
    names = view(s, d, "entities").select(F.lower("name").alias("key")).distinct().withColumn("hit", F.lit(True))
    objects = table(s, d, "part").groupBy(F.col("p_type").alias("object")).agg(F.count("*").alias("n")).withColumn("key", F.lower(F.split_part("object", F.lit(" "), F.lit(1))))
    return objects.join(names, "key", "left").select("object", "n", F.when(F.col("hit"), "canonical_name").otherwise("none").alias("match_type"))


@query("jon7_value_conflicts", "SELECT subject, metric, year, count(DISTINCT amount) AS n_values, CAST(min(amount) AS BIGINT) AS low, CAST(max(amount) AS BIGINT) AS high FROM statements GROUP BY subject, metric, year HAVING count(DISTINCT amount) > 1")
def jon7(s, d):
    """Groups of one subject, metric and year whose numbers differ: an aggregate instead of pairs."""
    g = view(s, d, "statements").groupBy("subject", "metric", "year")
    return g.agg(F.count_distinct("amount").alias("n_values"), F.min("amount").cast("long").alias("low"), F.max("amount").cast("long").alias("high")).where("n_values > 1")


@query("jon9_checksum_dedup", "SELECT sha256(text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def jon9(s, d):
    return table(s, d, "documents").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("agg1_entities", "SELECT lower(trim(name)) AS canonical_key, min(name) AS name, count(*) AS occurrences, min(kind) AS kind FROM entities GROUP BY lower(trim(name))")
def agg1(s, d):
    return view(s, d, "entities").groupBy(F.lower(F.trim("name")).alias("canonical_key")).agg(F.min("name").alias("name"), F.count("*").alias("occurrences"), F.min("kind").alias("kind"))


@query("agg2_relationships", "SELECT l_suppkey AS subject, l_partkey AS object, count(*) AS occurrences, round(max(l_discount), 6) AS max_confidence, round(avg(l_discount), 6) AS avg_confidence FROM lineitem GROUP BY l_suppkey, l_partkey")
def agg2(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object")).agg(F.count("*").alias("occurrences"), F.round(F.max("l_discount"), 6).alias("max_confidence"), F.round(F.avg("l_discount"), 6).alias("avg_confidence"))


@query("agg3_confidence", f"SELECT predicate, round(sum(confidence * {_STREAM}) / sum({_STREAM}), 4) AS confidence, count(*) AS n_evidence FROM claims GROUP BY predicate")
def agg3(s, d):
    return evidence.confidence(view(s, d, "claims"), ["predicate"]).select("predicate", F.round("confidence", 4).alias("confidence"), "n_evidence")


_POLAR = "SELECT subject, predicate, object, count(*) FILTER (WHERE NOT negated) AS affirmed, count(*) FILTER (WHERE negated) AS negated FROM claims GROUP BY subject, predicate, object HAVING count(*) FILTER (WHERE NOT negated) > 0 AND count(*) FILTER (WHERE negated) > 0"
_OBJECTS = f"SELECT subject, predicate, count(DISTINCT object) AS objects FROM claims c WHERE NOT EXISTS (SELECT 1 FROM ({_POLAR}) p WHERE p.subject = c.subject AND p.predicate = c.predicate) GROUP BY subject, predicate HAVING count(DISTINCT object) > 1"


@query("agg4_polarity_conflicts", _POLAR)
def agg4(s, d):
    return evidence.polarity_conflicts(view(s, d, "claims"))


@query("agg5_object_conflicts", _OBJECTS)
def agg5(s, d):
    return evidence.object_conflicts(view(s, d, "claims"))


@query("agg6_evidence_dedup", f"SELECT ord, subject, predicate, object, stream, round(confidence, 6) AS confidence FROM claims QUALIFY row_number() OVER (PARTITION BY {_DEDUP_KEY} ORDER BY ord) = 1")
def agg6(s, d):
    return evidence.deduplicated(view(s, d, "claims")).select("ord", "subject", "predicate", "object", "stream", F.round("confidence", 6).alias("confidence"))


@query("agg7_document_confidence", f"SELECT country, count(*) AS n_docs, round(0.35 * least(count(DISTINCT source_class) / 3.0, 1) + 0.4 * least(count(DISTINCT doc_id) / 4.0, 1) + 0.25 * least(count(DISTINCT issuer) / 3.0, 1), 6) AS diversity, round(avg({_SOURCE_FRESH}), 6) AS freshness FROM library GROUP BY country")
def agg7(s, d):
    share = lambda c, n: F.least(F.count_distinct(c) / n, F.lit(1.0))
    return view(s, d, "library").groupBy("country").agg(F.count("*").alias("n_docs"), F.round(0.35 * share("source_class", 3.0) + 0.4 * share("doc_id", 4.0) + 0.25 * share("issuer", 3.0), 6).alias("diversity"), F.round(F.avg(scoring.source_freshness(F.col("published"), AS_OF)), 6).alias("freshness"))


@query("agg8_clusters", "SELECT l_orderkey, max(l_extendedprice) AS max_score, round(avg(l_extendedprice), 6) AS avg_score, count(*) AS n FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 3) GROUP BY l_orderkey ORDER BY 2 DESC, 3 DESC, 1 LIMIT 8")
def agg8(s, d):
    return retrieval.clusters(table(s, d, "lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber").withColumn("avg_score", F.round("avg_score", 6))


@query("agg10_predicates", "SELECT predicate, count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM edges GROUP BY predicate")
def agg10(s, d):
    return view(s, d, "edges").groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"))


@query("agg17_dashboard", "SELECT year(published) AS year, count(*) AS n_docs, count(*) FILTER (WHERE status = 'published') AS published_docs, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE visibility = 'public') AS public_docs, count(DISTINCT issuer) AS issuers, count(DISTINCT country) AS countries FROM library GROUP BY year(published)")
def agg17(s, d):
    one = lambda c, v: F.count_if(F.col(c) == v)
    return view(s, d, "library").groupBy(F.year("published").cast("long").alias("year")).agg(F.count("*").alias("n_docs"), one("status", "published").alias("published_docs"), one("status", "failed").alias("failed"), one("visibility", "public").alias("public_docs"), F.count_distinct("issuer").alias("issuers"), F.count_distinct("country").alias("countries"))


@query("agg18_queue", "SELECT event_type AS stage, count(*) AS n, count(*) FILTER (WHERE value >= 100) AS active FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY event_type")
def agg18(s, d):
    """Latest job of each user, counted by stage."""
    last = table(s, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.groupBy(F.col("e.event_type").alias("stage")).agg(F.count("*").alias("n"), F.count_if(F.col("e.value") >= 100).alias("active"))


_PLAN = "CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'enterprise' ELSE 'free' END"


@query("agg20_billing", f"SELECT {_PLAN} AS plan, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS linked, CAST(count(*) FILTER (WHERE c_mktsegment = 'BUILDING') * 49 AS BIGINT) AS revenue FROM customer GROUP BY 1")
def agg20(s, d):
    """Customers by plan (unknown ones are free); only pro pays."""
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "pro").when(F.col("c_mktsegment") == "MACHINERY", "enterprise").otherwise("free")
    return table(s, d, "customer").groupBy(plan.alias("plan")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("linked"), (F.count_if(F.col("c_mktsegment") == "BUILDING") * 49).alias("revenue"))


@query("agg21_profile", "SELECT event_type AS stage, count(*) AS n, round(sum(value), 2) AS total, round(max(value), 6) AS longest FROM events GROUP BY event_type")
def agg21(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.max("value"), 6).alias("longest"))


@query("agg22_quota", "SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) AS asked, least(count(*), 5) AS allowed, greatest(0, 5 - count(*)) AS remaining FROM events GROUP BY user_id, strftime(ts, '%Y-%m')")
def agg22(s, d):
    g = table(s, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("asked"))
    return g.withColumn("allowed", F.least("asked", F.lit(5))).withColumn("remaining", F.greatest(F.lit(0), 5 - F.col("asked")))


@query("agg27_chunk_stats", "SELECT doc_id, length(text) AS chars, CAST(ceil(length(text) / 1200.0) AS BIGINT) AS chunks, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def agg27(s, d):
    n = F.length("text")
    return table(s, d, "documents").select("doc_id", n.alias("chars"), F.ceil(n / 1200.0).alias("chunks"), F.ceil(n / 4.0).alias("tokens"))


@query("win7_entity_ids", "SELECT id, 'ENTITY_' || lpad(CAST(row_number() OVER (ORDER BY kind, id) AS VARCHAR), 6, '0') AS entity_id FROM entities")
def win7(s, d):
    """Sequential ids in a fixed order, dealt out by ranges of it."""
    return numbered(view(s, d, "entities").select("id", "kind"), ["kind", "id"], "n").select("id", F.format_string("ENTITY_%06d", "n").alias("entity_id"))


@query("top7_similar", "SELECT b.doc_id, (CASE WHEN a.country = b.country THEN 2 ELSE 0 END + CASE WHEN a.issuer = b.issuer THEN 2 ELSE 0 END + CASE WHEN a.document_type = b.document_type THEN 1 ELSE 0 END) AS score FROM library b CROSS JOIN (SELECT * FROM library WHERE doc_id = 0) a WHERE b.doc_id <> 0 AND (a.country = b.country OR a.issuer = b.issuer OR a.document_type = b.document_type) ORDER BY 2 DESC, 1 LIMIT 8")
def top7(s, d):
    docs = view(s, d, "library")
    f = docs.where("doc_id = 0").select("country", "issuer", "document_type").first()
    one = lambda c, v, w: F.when(F.col(c) == v, w).otherwise(0)
    score = one("country", f["country"], 2) + one("issuer", f["issuer"], 2) + one("document_type", f["document_type"], 1)
    return docs.where("doc_id <> 0").select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(8)


@query("set1_streams", "SELECT stream, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM (SELECT stream, confidence FROM claims UNION ALL SELECT 'EDGE', confidence FROM edges) GROUP BY stream")
def set1(s, d):
    both = view(s, d, "claims").select("stream", "confidence").unionByName(view(s, d, "edges").select(F.lit("EDGE").alias("stream"), "confidence"))
    return both.groupBy("stream").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query("set5_activity", "SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS happened FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY happened DESC, kind, id LIMIT 8")
def set5(s, d):
    a = table(s, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("happened"))
    b = table(s, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("happened"))
    return a.unionByName(b).orderBy(F.desc("happened"), "kind", "id").limit(8)


@query("grf2_neighbors", "SELECT node, other, predicate, direction FROM (SELECT subject AS node, object AS other, predicate, 'outgoing' AS direction FROM edges UNION ALL SELECT object, subject, predicate, 'incoming' FROM edges)")
def grf2(s, d):
    return graph.undirected(view(s, d, "edges"))


@query("grf3_bfs", "WITH RECURSIVE p AS (SELECT DISTINCT * FROM (SELECT subject AS a, object AS b FROM edges UNION ALL SELECT object, subject FROM edges)), w(node, depth) AS (SELECT 'N0', 0 UNION SELECT p.b, w.depth + 1 FROM w JOIN p ON p.a = w.node WHERE w.depth < 3) SELECT node, min(depth) AS depth FROM w WHERE node <> 'N0' GROUP BY node")
def grf3(s, d):
    return graph.reached(view(s, d, "edges"), "N0", 3)


@query("grf5_paths", "WITH RECURSIVE w(path, last, confidence) AS (SELECT [subject, object], object, confidence FROM edges WHERE subject = 'S1' UNION ALL SELECT list_append(w.path, e.object), e.object, w.confidence * e.confidence FROM w JOIN edges e ON e.subject = w.last WHERE NOT list_contains(w.path, e.object) AND len(w.path) <= 4 AND w.last <> 'R4') SELECT array_to_string(path, '>') AS path, round(confidence, 6) AS confidence FROM w WHERE last = 'R4'")
def grf5(s, d):
    return graph.simple_paths(view(s, d, "edges"), "S1", "R4", 4).select(F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


@query("txt1_clean", r"""SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (
SELECT doc_id, line, often, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (
SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS often FROM (SELECT doc_id, pos, trim(lines[pos]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) x, range(1, len(lines) + 1) t(pos))))
WHERE NOT regexp_matches(line, '^(?i:page )?[0-9]+$') AND NOT (often >= 2 AND length(line) <= 140 AND NOT regexp_matches(line, '[.!?]$') AND len(regexp_split_to_array(line, ' +')) <= 16) AND line <> '' AND coalesce(line <> before, true) GROUP BY doc_id""")
def txt1(s, d):
    return text.cleaned_lines(table(s, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("txt2_sentences", r"SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) WHERE trim(s) <> '' GROUP BY doc_id")
def txt2(s, d):
    return text.sentences(table(s, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).alias("longest"))


@query("txt6_values", rf"""SELECT id, kind, CASE kind WHEN 'currency' THEN money ELSE share END AS number, CASE kind WHEN 'currency' THEN upper(regexp_extract(text, '{text.MONEY}', 1)) WHEN 'percentage' THEN '%' ELSE 'GW' END AS unit,
nullif(scale, '') AS scale, CASE WHEN kind = 'currency' THEN money * CASE scale WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 ELSE 1 END END AS amount, TRY_CAST(nullif(regexp_extract(text, '{text.BY_YEAR}', 1), '') AS INT) AS year, NULL::INT AS last_year
FROM (SELECT id, text, CASE WHEN regexp_matches(text, '{text.MONEY}') THEN 'currency' WHEN regexp_matches(text, '{text.SHARE}') THEN 'percentage' ELSE 'measurement' END AS kind, lower(regexp_extract(text, '{text.MONEY}', 3)) AS scale,
      TRY_CAST(replace(regexp_extract(text, '{text.MONEY}', 2), ',', '') AS DOUBLE) AS money, TRY_CAST(regexp_extract(text, '({text.NUMBER})', 1) AS DOUBLE) AS share FROM statements)""")  # fmt: skip
def txt6(s, d):
    return view(s, d, "statements").select("id", text.structured_value(F.col("text")).alias("v")).select("id", "v.*")


def _topic_sql(column: str) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{name}'" for name, terms in text.TOPICS)
    return f"CASE {arms} ELSE 'general' END"


@query("txt9_topics", f"""SELECT topic, count(*) AS n FROM (SELECT {_topic_sql("lower(x)")} AS topic FROM (SELECT trim(regexp_replace(regexp_replace(y, '^\\s*[-•]\\s*', ''), '\\s+', ' ', 'g')) AS x
FROM (SELECT unnest(string_split(regexp_replace(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))) AS y FROM reports)) WHERE length(x) >= 15) GROUP BY topic""")  # fmt: skip
def txt9(s, d):
    """Topics of the sentences and lines of all reports, of 15 characters or more."""
    parts = F.split(F.trim("text"), r"(?<=[.!?])\s+|\n+")
    lines = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*[-•]\s*", ""), r"\s+", " ")))
    rows = view(s, d, "reports").select(F.explode(F.filter(lines, lambda x: F.length(x) >= 15)).alias("x"))
    return rows.groupBy(text.topic(F.col("x")).alias("topic")).agg(F.count("*").alias("n"))


@query("txt13_predicates", "SELECT event_type, upper(regexp_replace(trim(event_type), '[^A-Za-z0-9]+', '_', 'g')) AS predicate, count(*) AS n FROM events GROUP BY event_type")
def txt13(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.upper(F.regexp_replace(F.trim(F.col("event_type")), "[^A-Za-z0-9]+", "_")).alias("predicate"), F.count("*").alias("n"))


@query("txt20_embedding_text", r"SELECT doc_id, sha256(substr(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), 1, 24000)) AS checksum, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 50) AS BIGINT) AS batch FROM documents")
def txt20(s, d):
    clean = F.substring(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), 1, 24000)
    rows = numbered(table(s, d, "documents").select("doc_id", "source", F.sha2(clean, 256).alias("checksum")), ["source", "doc_id"], "n")
    first = rows.groupBy("source").agg(F.min("n").alias("first"))
    return rows.join(first, rows["source"].eqNullSafe(first["source"])).select("doc_id", "checksum", F.floor((F.col("n") - F.col("first")) / 50).alias("batch"))


_LIMITED = "CASE WHEN length(t) <= 60000 THEN t ELSE substr(t, 1, 45000) || chr(10) || chr(10) || '[DOCUMENT MIDDLE OMITTED]' || chr(10) || chr(10) || right(t, 15000) END"


@query("txt21_limit_text", f"SELECT doc_id, length({_LIMITED}) AS chars, sha256({_LIMITED}) AS digest FROM (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)")
def txt21(s, d):
    """Texts over 60,000 characters keep 45,000 at the start and 15,000 at the end, with a mark between; null is empty."""
    cut = text.limited(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.length(cut).alias("chars"), F.sha2(cut, 256).alias("digest"))


@query("fun1_freshness", f"SELECT doc_id, {_RANK_FRESH} AS rank_freshness, {_SOURCE_FRESH} AS source_freshness FROM library")
def fun1(s, d):
    return view(s, d, "library").select("doc_id", scoring.rank_freshness(F.col("published"), AS_OF).alias("rank_freshness"), scoring.source_freshness(F.col("published"), AS_OF).alias("source_freshness"))


_TRACE = "(0.25E0 + 0.25E0 + 0.15E0 + CASE WHEN doc_id % 3 = 0 THEN 0.15E0 ELSE 0E0 END + CASE WHEN page_start > 0 THEN 0.1E0 ELSE 0E0 END + CASE WHEN trim(section) <> '' THEN 0.1E0 ELSE 0E0 END)"
_NINE = "(" + " + ".join(f"CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) <> '' THEN 1 ELSE 0 END" for c in ("title", "issuer", "country", "document_type", "source_class", "lang", "published")) + ") / 9.0E0"
_QUALITY = f"0.3E0 * {_AUTHORITY} / 100 + 0.25E0 * {_STATUS} + 0.15E0 * {_SOURCE_FRESH} + 0.15E0 * {_NINE} + 0.15E0 * {_TRACE}"


@query("fun3_source_quality", f"""SELECT doc_id, chunk, round(q, 6) AS quality, CASE WHEN q >= 0.9 THEN 5 WHEN q >= 0.78 THEN 4 WHEN q >= 0.62 THEN 3 WHEN q >= 0.45 THEN 2 ELSE 1 END AS stars
FROM (SELECT doc_id, part AS chunk, {_QUALITY} AS q FROM (SELECT *, unnest([0, 1]) AS part, unnest([0, doc_id % 4]) AS page_start, unnest(['', 'Targets']) AS section FROM library))""")  # fmt: skip
def fun3(s, d):
    """Source quality of evidence: authority, verification, freshness, metadata and how far it can be traced (document, chunk and place are known; url of every third; page and section of a document's second part)."""
    parts = F.explode(F.array(F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("page_start"), F.lit("").alias("section")), F.struct(F.lit(1).alias("chunk"), (F.col("doc_id") % 4).alias("page_start"), F.lit("Targets").alias("section"))))
    rows = view(s, d, "library").select("*", parts.alias("part"))
    traced = scoring.traceability(F.lit(True), F.lit(True), F.lit(True), F.col("doc_id") % 3 == 0, F.col("part.page_start") > 0, F.trim("part.section") != "")
    none = F.lit(None).cast("string")  # jurisdiction and effective date, which the library doesn't have
    meta = scoring.filled_share(*[F.col(c) for c in ("title", "issuer", "country", "document_type", "source_class", "lang", "published")], none, none)
    q = scoring.source_quality(scoring.authority(F.col("source_class")) / 100, scoring.verification(F.col("status")), scoring.source_freshness(F.col("published"), AS_OF), meta, traced)
    return rows.select("doc_id", F.col("part.chunk").alias("chunk"), F.round(q, 6).alias("quality"), scoring.stars(q).alias("stars"))


@query("fun7_calculators", "SELECT n_name AS market, count(*) AS n, round(sum(l_quantity * (0.2 + n_nationkey / 50.0)), 2) AS solar, round(sum(l_quantity * 0.9 * 28), 2) AS methane, round(sum(l_quantity * 0.7 * 44 / 12 * 0.8), 2) AS biochar FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")
def fun7(s, d):
    q = F.col("l_quantity")
    rows = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("market")).agg(F.count("*").alias("n"), F.round(F.sum(scoring.solar_credits(q, 0.2 + F.col("n_nationkey") / 50.0)), 2).alias("solar"), F.round(F.sum(scoring.methane_credits(q)), 2).alias("methane"), F.round(F.sum(scoring.biochar_credits(q)), 2).alias("biochar"))


_CONFLICTS = f"SELECT subject FROM ({_POLAR}) UNION ALL SELECT subject FROM ({_OBJECTS})"


@query("fun13_truth_status", f"""SELECT subject, round(confidence, 6) AS confidence, n_evidence, n_conflicts, CASE WHEN n_conflicts > 0 THEN 'CONFLICTING' WHEN confidence >= 0.75 THEN 'SUPPORTED' WHEN confidence >= 0.45 THEN 'PARTIALLY_SUPPORTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status
FROM (SELECT a.subject, a.c * CASE WHEN coalesce(b.n, 0) > 0 THEN 0.45 ELSE 1 END AS confidence, a.n_evidence, coalesce(b.n, 0) AS n_conflicts
FROM (SELECT subject, sum(confidence * {_STREAM}) / sum({_STREAM}) AS c, count(*) AS n_evidence FROM claims GROUP BY subject) a LEFT JOIN (SELECT subject, count(*) AS n FROM ({_CONFLICTS}) GROUP BY subject) b ON a.subject = b.subject)""")
def fun13(s, d):
    return evidence.truth(view(s, d, "claims")).withColumn("confidence", F.round("confidence", 6))


@query("fun15_planner", r"""SELECT id, question, CASE WHEN regexp_matches(q, 'compare|comparison|difference|versus| vs |vs\.') THEN 'COMPARISON' WHEN regexp_matches(q, 'type|category|classify|kind of|form of|\bis\b.+\ban?\b') THEN 'REASONING'
WHEN regexp_matches(q, 'how|why|relationship|related|connected|connection|link') THEN 'GRAPH' WHEN regexp_matches(q, 'what is|what''s|define|definition|meaning of') THEN 'ONTOLOGY' WHEN regexp_matches(q, 'what|when|where|which|who') THEN 'SEMANTIC' ELSE 'HYBRID' END AS strategy FROM (SELECT *, lower(question) AS q FROM questions)""")
def fun15(s, d):
    return view(s, d, "questions").select("id", "question", text.strategy(F.col("question")).alias("strategy"))


@query("fun18_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def fun18(s, d):
    return table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("fun19_notices", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Deal ' || o_orderkey || ' is closed' WHEN 'O' THEN 'Deal ' || o_orderkey || ' is open' ELSE 'Deal ' || o_orderkey || ' changed' END AS notice FROM orders")
def fun19(s, d):
    tail = F.when(F.col("o_orderstatus") == "F", " is closed").when(F.col("o_orderstatus") == "O", " is open").otherwise(" changed")
    return table(s, d, "orders").select("o_orderkey", F.concat(F.lit("Deal "), F.col("o_orderkey").cast("string"), tail).alias("notice"))


@query("src1_clean_text", r"SELECT doc_id, length(t) AS chars, CAST(len(regexp_extract_all(t, '[^ \t\r\n]+')) AS BIGINT) AS words FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS t FROM documents) WHERE length(t) >= 20")
def src1(s, d):
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    return table(s, d, "documents").select("doc_id", clean.alias("t")).where(F.length("t") >= 20).select("doc_id", F.length("t").alias("chars"), F.regexp_count("t", F.lit(r"[^ \t\r\n]+")).cast("long").alias("words"))


def _nested(column: str, pairs: list[tuple[str, str]]) -> str:
    for wrong, right in pairs:
        quoted = right.replace("'", "''")
        column = f"replace({column}, '{wrong}', '{quoted}')"
    return column


@query("src6_bad_bytes", f"""SELECT m AS pattern, count(*) AS n FROM (SELECT unnest({" || ".join(f"regexp_extract_all(html, '{p}')" for p in text.MOJIBAKE)}) AS m
FROM (SELECT replace(replace(replace(replace(replace(html, 'é', 'Ã©'), '·', 'Â·'), '&middot;', 'â€¢ '), 'ç', 'âœ“'), 'ü', 'â†’') AS html FROM pages)) GROUP BY m ORDER BY n DESC, m LIMIT 40""")  # fmt: skip
def src6(s, d):
    """The forty most frequent runs of text that was decoded in the wrong way, in pages some of whose letters were."""
    broken = F.col("html")
    for letter, wrong in (("é", "Ã©"), ("·", "Â·"), ("&middot;", "â€¢ "), ("ç", "âœ“"), ("ü", "â†’")):
        broken = F.replace(broken, F.lit(letter), F.lit(wrong))
    return text.bad_runs(table(s, d, "pages").select(broken.alias("html")), "html")


@query("src6_mended", f"""SELECT page_id, md5({_nested('html', text.MENDED)}) AS digest FROM (SELECT page_id, replace(replace(replace(coalesce(html, ''), '&middot;', 'â€¢'), 'ç', 'âœ“'), 'ü', 'â†’') AS html FROM pages)""")
def src6_mended(s, d):
    """Pages with wrongly decoded signs put right."""
    broken = F.coalesce("html", F.lit(""))
    for letter, wrong in (("&middot;", "â€¢"), ("ç", "âœ“"), ("ü", "â†’")):
        broken = F.replace(broken, F.lit(letter), F.lit(wrong))
    return table(s, d, "pages").select("page_id", F.md5(text.mended(broken)).alias("digest"))


@query("snk2_upsert", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def snk2(s, d):
    last = table(s, d, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "event_type", "e.event_id", F.round("e.value", 6).alias("value"))


@query("snk4_promote", "SELECT doc_id, CASE WHEN source_class IN ('government', 'international_organization', 'standard_body', 'registry', 'research') AND status IN ('pending_review', 'verified') THEN 'published' ELSE status END AS status FROM library")
def snk4(s, d):
    up = F.col("source_class").isin("government", "international_organization", "standard_body", "registry", "research") & F.col("status").isin("pending_review", "verified")
    return view(s, d, "library").select("doc_id", F.when(up, "published").otherwise(F.col("status")).alias("status"))


@query("snk5_csv", """SELECT c_custkey, '"' || replace(c_name, '"', '""') || '","' || c_mktsegment || '"' AS line FROM customer""")
def snk5(s, d):
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return table(s, d, "customer").select("c_custkey", F.concat_ws(",", quoted("c_name"), quoted("c_mktsegment")).alias("line"))


@query("str3_monthly", "SELECT user_id, date_trunc('month', ts) AS month, count(*) AS n FROM events GROUP BY user_id, date_trunc('month', ts)")
def str3(s, d):
    """Batch twin of the monthly counters in factloom.streaming."""
    return table(s, d, "events").groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("n"))
