"""What an answer's evidence amounts to: scope by country, confidence, reliability, status, summary and citations.

Evidence has the columns answer_id, place (rank), doc_id, country, published, source_class, issuer, status, evidence_score and
semantic_score. Every figure of an answer is one aggregate over its evidence.

Defined cases: null scores count as 0 and null names as none; an answer without evidence has confidence 0 and no_evidence;
repeated documents count once where documents are counted; ties don't arise, as places are unique; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scoring

#: Classes of official sources, and countries that name none.
OFFICIAL = ["government", "un", "registry", "standard_body", "international_organization"]
UNSPECIFIED = ["", "global", "other", "unknown", "unspecified", "n/a", "na", "none", "null", "undefined"]
COMPARES = r"(?i)\b(compare|comparison|versus|vs\.?|difference|differences|between|relative to|compared with|compared to)\b"
WORLDWIDE = r"(?i)\b(global|international|worldwide|world\s+wide|across\s+countries|gcc|gulf\s+cooperation)\b"
#: Coverage of one to six pieces of evidence.
COVERAGE = [0.4, 0.58, 0.72, 0.84, 0.92, 1.0]


def requested(questions: DataFrame, countries: DataFrame) -> DataFrame:
    """answer_id, country of each country that a question names, by countries(country, alias).

    A name is a run of a question's words, so runs of as many words as the longest alias has are joined with the aliases by equality.
    """
    longest = countries.agg(F.max(F.size(F.split(F.trim("alias"), r"\s+")))).first()[0] or 1
    words = questions.select("answer_id", F.filter(F.split(F.lower("question"), r"[^\p{L}\p{N}_.]+"), lambda x: x != "").alias("w"))
    run = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(F.array().cast("array<string>"))
    runs = words.select("answer_id", F.explode(F.flatten(F.array(*[run(k) for k in range(1, longest + 1)]))).alias("alias")).distinct()
    bare = runs.select("answer_id", F.explode(F.array("alias", F.regexp_replace("alias", r"\.+$", ""))).alias("alias")).distinct()
    return bare.join(countries.select("country", F.lower(F.trim("alias")).alias("alias")), "alias").select("answer_id", "country").distinct()


def scoped(evidence: DataFrame, questions: DataFrame, countries: DataFrame) -> DataFrame:
    """evidence with asked (whether its question names a country), kept and inside (of a country that is asked for, or none is).

    Of a question that names countries only their evidence is kept, and that of unspecified ones if it compares or asks worldwide.
    """
    named = requested(questions, countries)
    canonical = countries.select(F.lower(F.trim("alias")).alias("own_alias"), F.col("country").alias("own")).unionByName(countries.select(F.lower("country").alias("own_alias"), F.col("country").alias("own"))).distinct()
    wide = questions.select("answer_id", (F.col("question").rlike(COMPARES) | F.col("question").rlike(WORLDWIDE)).alias("wide"))
    place = F.lower(F.trim(F.coalesce("country", F.lit(""))))
    rows = evidence.withColumn("own_alias", F.when(place.isin(UNSPECIFIED), "").otherwise(place)).join(canonical, "own_alias", "left").withColumn("own", F.coalesce("own", "own_alias"))
    rows = rows.join(wide, "answer_id", "left").join(named.select("answer_id").distinct().withColumn("asked", F.lit(True)), "answer_id", "left")
    rows = rows.join(named.select("answer_id", F.col("country").alias("own"), F.lit(True).alias("hit")), ["answer_id", "own"], "left")
    kept = F.when(F.col("asked").isNull(), True).when(F.col("own") == "", F.coalesce("wide", F.lit(False))).otherwise(F.col("hit").isNotNull())
    inside = F.col("asked").isNull() | F.col("hit").isNotNull()
    return rows.select(*evidence.columns, F.coalesce("asked", F.lit(False)).alias("asked"), kept.alias("kept"), inside.alias("inside"))


def _distinct(c: str) -> Column:
    return F.count_distinct(F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))))


def level(score: Column) -> Column:
    return F.when(score >= 0.9, "very_high").when(score >= 0.78, "high").when(score >= 0.62, "moderate").when(score >= 0.45, "low").otherwise("insufficient")


def package(questions: DataFrame, evidence: DataFrame, conflicts: DataFrame, as_of: str) -> DataFrame:
    """One row per question with n_evidence, n_documents, diversity, coverage, agreement, authority, freshness, score, level, reliability and status.

    evidence is what scoped() keeps; conflicts(answer_id, …) has one row for each contradiction.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    official, checked = F.lower("source_class").isin(OFFICIAL), F.lower("status").isin("verified", "published")
    sums = evidence.groupBy("answer_id").agg(
        F.count("*").alias("n"), F.avg(part("evidence_score")).alias("strength"), F.avg(part("semantic_score")).alias("similarity"), _distinct("source_class").alias("classes"), _distinct("doc_id").alias("docs"),
        _distinct("issuer").alias("issuers"), F.count_if(official).alias("official"), F.count_if(checked).alias("checked"), F.count_if("inside").alias("n_inside"), F.avg(scoring.authority(F.col("source_class")) / 100).alias("authority"),
        F.avg(F.when(F.col("published").isNotNull(), scoring.source_freshness(F.col("published"), as_of))).alias("freshness"),
    )
    clashes = conflicts.groupBy("answer_id").agg(F.count("*").alias("n_conflicts"))
    rows = questions.select("answer_id").join(sums, "answer_id", "left").join(clashes, "answer_id", "left").fillna(0)
    n, bad = F.col("n"), F.col("n_conflicts")
    least = lambda c, top: F.least(F.col(c) / top, F.lit(1.0))
    rows = rows.withColumn("diversity", 0.35 * least("classes", 3) + 0.4 * least("docs", 4) + 0.25 * least("issuers", 3))
    rows = rows.withColumn("coverage", F.when(n == 0, 0.0).otherwise(F.element_at(F.array(*[F.lit(x) for x in COVERAGE]), F.least(F.greatest(n, F.lit(1)), F.lit(6)).cast("int"))))
    rows = rows.withColumn("agreement", F.when(n == 0, 0.0).otherwise(1 - F.least(bad / F.greatest(n, F.lit(1)), F.lit(1.0))))
    raw = 0.38 * F.col("strength") + 0.2 * F.col("similarity") + 0.14 * F.col("diversity") + 0.14 * F.col("coverage") + 0.14 * F.col("agreement") - F.least(0.08 * bad, F.lit(0.32))
    score = F.col("score")
    rows = rows.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 9))
    reliability = F.when((score >= 0.85) & (F.col("official") >= 2), "official_source").when(score >= 0.72, "strong_evidence").when(score >= 0.52, "partial_evidence").when(n > 0, "general_answer").otherwise("insufficient_evidence")
    sure = (F.col("docs") >= 2) & (score >= 0.8) & ((F.col("official") >= 1) | (F.col("checked") >= 2))
    status = F.when((n == 0) | (F.col("n_inside") == 0), "no_evidence").when(bad > 0, "conflicted").when(sure | ((n >= 2) & (score >= 0.5)), "supported").when(score >= 0.5, "partial_support").otherwise("insufficient_evidence")
    six = lambda c: F.round(c, 6).alias(c)
    return rows.select("answer_id", n.alias("n_evidence"), F.col("docs").alias("n_documents"), "n_conflicts", six("diversity"), six("coverage"), six("agreement"), six("authority"), six("freshness"), six("score"), level(score).alias("level"), reliability.alias("reliability"), status.alias("status"))


def summary(evidence: DataFrame) -> DataFrame:
    """answer_id, n_evidence, n_documents, classes (class:count by name, joined), countries (joined), highest (score of the first), average."""
    kind = F.when(F.trim(F.coalesce("source_class", F.lit(""))) == "", "other").otherwise(F.lower(F.trim("source_class")))
    per = evidence.groupBy("answer_id", kind.alias("kind")).agg(F.count("*").alias("n")).groupBy("answer_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", "n"))), ",").alias("classes"))
    own = evidence.groupBy("answer_id").agg(
        F.count("*").alias("n_evidence"), F.count_distinct("doc_id").alias("n_documents"), F.array_join(F.sort_array(F.collect_set(F.when(F.trim("country") != "", F.trim("country")))), ",").alias("countries"),
        F.round(F.coalesce(F.min_by("evidence_score", "place"), F.lit(0.0)), 6).alias("highest"), F.round(F.avg(F.coalesce("evidence_score", F.lit(0.0))), 6).alias("average"),
    )
    return own.join(per, "answer_id")


def citations(evidence: DataFrame, most: int = 12) -> DataFrame:
    """answer_id, citation (CA-001 on), doc_id, label of each document's first evidence by rank, `most` (1 to 30) an answer."""
    most = max(1, min(most, 30))
    first = evidence.groupBy("answer_id", "doc_id").agg(F.min(F.struct("place", "title", "issuer", "published")).alias("e")).where("doc_id is not null")
    number = F.row_number().over(Window.partitionBy("answer_id").orderBy("e.place"))
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    label = F.concat_ws(" · ", filled(F.col("e.title")), filled(F.col("e.issuer")), F.col("e.published").cast("string"))
    return first.withColumn("nth", number).where(F.col("nth") <= most).select("answer_id", F.format_string("CA-%03d", "nth").alias("citation"), "doc_id", label.alias("label"))
