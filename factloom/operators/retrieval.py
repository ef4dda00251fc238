"""Access-filtered vector retrieval, country scope, evidence ranking, clustering and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scoring


def access(user_id: int | None = None, workspace_id: int | None = None, admin: bool = False) -> Column:
    """Rows that a user may see, as a filter that reaches the scan."""
    allowed = F.col("visibility") == "public"
    if admin:
        allowed |= F.col("visibility") == "internal"
    if user_id is not None:
        allowed |= (F.col("visibility") == "private") & (F.col("owner_id") == user_id)
    if workspace_id is not None:
        allowed |= (F.col("visibility") == "workspace") & (F.col("workspace_id") == workspace_id)
    return F.col("status").isin("verified", "published") & allowed


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a query vector (its length is fixed, so it is a literal)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = sum(float(x) ** 2 for x in query) ** 0.5
    return dot / (norm * F.lit(own))


def vector_topk(embeddings: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest rows: a partial top-k in each task, so only k rows of a task move."""
    return embeddings.withColumn("similarity", cosine(F.col("embedding"), query)).orderBy(F.desc(F.round("similarity", 9)), "vec_id").limit(k)


def ranked(hits: DataFrame, as_of: str) -> DataFrame:
    """hits with `score`, by similarity, source quality, status, freshness, metadata and content."""
    quality = F.least(scoring.authority(F.col("source_class")) / 100.0 + F.when(F.col("source_class") == "government", 0.03).otherwise(0.0), F.lit(1.0))
    metadata = scoring.filled_share(*[F.col(c) for c in ("title", "country", "issuer", "document_type", "source_class", "published")])
    return hits.withColumn("score", scoring.evidence_score(F.col("similarity"), quality, scoring.verification(F.col("status")), scoring.rank_freshness(F.col("published"), as_of), metadata, scoring.content_quality(F.col("text"))))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("first_of", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("first_of = 1").drop("first_of")


def clusters(rows: DataFrame, key: str, score: str, item: str, per_key: int = 3, keys: int = 8) -> DataFrame:
    """Best keys by greatest score over all rows and mean score over the per_key best."""
    w = Window.partitionBy(key).orderBy(F.desc(score), item)
    kept = rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= per_key)
    return kept.groupBy(key).agg(F.max(score).alias("max_score"), F.avg(score).alias("avg_score"), F.count("*").alias("n")).orderBy(F.desc("max_score"), F.desc("avg_score"), key).limit(keys)
