"""Claim-level evidence: confidence, conflicts, registries and truth status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scoring

#: Predicates that may have several objects.
MULTI_VALUED = ["IS_A", "PART_OF", "RELATED_TO", "SUPPORTED_BY", "REGULATED_BY", "USES", "PRODUCES"]


def deduplicated(claims: DataFrame) -> DataFrame:
    """The first of equal claims, by ord."""
    w = Window.partitionBy("subject", "predicate", "object", "stream", "negated").orderBy("ord")
    return claims.withColumn("at", F.row_number().over(w)).where("at = 1").drop("at")


def polarity_conflicts(claims: DataFrame) -> DataFrame:
    """Claims that are both affirmed and negated; a null `negated` is false."""
    no = F.coalesce(F.col("negated"), F.lit(False))
    n = claims.groupBy("subject", "predicate", "object").agg(F.count_if(~no).alias("affirmed"), F.count_if(no).alias("negated"))
    return n.where("affirmed > 0 AND negated > 0")


def object_conflicts(claims: DataFrame) -> DataFrame:
    """Subjects and single-valued predicates with several objects and no polarity conflict."""
    n = claims.where(~F.col("predicate").isin(MULTI_VALUED)).groupBy("subject", "predicate").agg(F.count_distinct("object").alias("objects")).where("objects > 1")
    return n.join(polarity_conflicts(claims).select("subject", "predicate").distinct(), ["subject", "predicate"], "left_anti")


def confidence(claims: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean confidence by stream weight."""
    w = scoring.looked_up(F.col("stream"), scoring.STREAM_WEIGHT, 0.5)
    return claims.groupBy(*by).agg((F.sum(F.col("confidence") * w) / F.sum(w)).alias("confidence"), F.count("*").alias("n_evidence"))


def truth(claims: DataFrame) -> DataFrame:
    """subject, confidence (times 0.45 with any conflict), conflicts, status."""
    bad = polarity_conflicts(claims).select("subject").unionAll(object_conflicts(claims).select("subject")).groupBy("subject").agg(F.count("*").alias("n_conflicts"))
    found = confidence(claims, ["subject"]).join(bad, "subject", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
    final = F.col("confidence") * F.when(F.col("n_conflicts") > 0, 0.45).otherwise(1.0)
    return found.select("subject", final.alias("confidence"), "n_evidence", "n_conflicts", scoring.truth_status(final, F.col("n_evidence"), F.col("n_conflicts")).alias("status"))
