"""Quality classifier by importance resampling.

Two generative models of hashed words and word pairs are fitted: one of target text (labelled good and not toxic), one
of raw text (all documents). A document's log importance weight is the sum of the log-ratios of FEATURES words and pairs at its
mean ratio (shrunk for short texts), so long documents don't weigh more by their length. Gumbel noise is added and the k
largest sums are kept, which samples k documents without replacement by weight; k is the number of documents whose ratio
is at or above the cut that divides held-out labelled rows best (a lost good row counts GOOD_COST times a kept bad one).

FEATURES sets where the draw decides: a document whose weight is w over the least sum is kept with probability
1 - exp(-exp(w)). With 32, that is 63 % at a mean ratio on the border, 99 % a twentieth above it and 4 % a tenth below.

A mean over all words hardly moves by a few toxic ones, so toxicity has a score of its own: for each bucket the log-ratio
of the shares of toxic and of other labelled rows that hold it, less DOUBT standard errors (0 at least), and for a
document the mean of its STRONGEST largest. Its cut is placed on held-out rows by itself (a lost clean row counts
CLEAN_COST times a kept toxic one); documents beyond it go, and the resampling is among the rest.

Raw counts and scores cover all documents. Only the labelled rows are bounded: the SAMPLE rows with the smallest hash of
their doc_id, half of which fit the target and toxic models while the other half places the cuts.

Defined cases: a null or empty text has score 0; documents whose sums tie share one verdict; without labelled rows of
both kinds (good and bad, toxic and not) that cut is infinite and loses no document; an empty table stays empty; repeated label rows of a
doc_id count once (best quality, toxic if one of them is); of documents that repeat a labelled doc_id, the least text
places the cuts; rows with one doc_id (or none) share one draw; very long texts are hashed in slices of about 1 MB, or whole
if one text is longer; other columns pass through or are left out, whatever their names. Own columns are score, toxicity,
gumbel and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.ngrams import features
from factloom.llm.shared import write_shared

BUCKETS = 1 << 16
SAMPLE = 20_000
SHRINK = 30.0
FEATURES = 32.0
GOOD_COST = 20.0
DOUBT, STRONGEST, CLEAN_COST = 2.0, 3, 5.0
SEED = 29


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` labelled rows: doc_id, good and toxic (0 or 1), fold (0 fits, 1 places the cuts)."""
    mixed = F.xxhash64("doc_id", F.lit(SEED))
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return rows.select("doc_id", good.alias("good"), F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic"), F.pmod(mixed, F.lit(2)).alias("fold"), mixed.alias("mixed")).orderBy("mixed", "doc_id").limit(sample).drop("mixed")


def _held(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each distinct pair."""
    pairs = np.unique(doc * BUCKETS + bucket)
    return pairs % BUCKETS, pairs // BUCKETS


def _count(batches):
    totals = np.zeros((4, BUCKETS), np.int64)
    for batch in batches:
        chosen, toxic = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("chosen", "toxic")]
        for bucket, doc in features(batch.column("text"), BUCKETS):
            totals[0] += np.bincount(bucket, minlength=BUCKETS)
            if chosen[doc].any():
                totals[1] += np.bincount(bucket[chosen[doc] == 1], minlength=BUCKETS)
            fits = toxic[doc] >= 0
            if fits.any():
                held, of = _held(bucket[fits], doc[fits])
                for k in (0, 1):
                    totals[2 + k] += np.bincount(held[toxic[of] == k], minlength=BUCKETS)
    seen = np.flatnonzero(totals[0])
    yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(t[seen]) for t in totals]], names=["bucket", "raw", "target", "clean", "toxic"])


def log_ratios(docs: DataFrame, fitting: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the log of target over raw probability, and the toxic weight. fitting: doc_id, good, toxic (bounded)."""
    roles = fitting.select("doc_id", F.col("good").alias("g"), F.col("toxic").alias("t"))
    marked = docs.select("doc_id", "text").join(F.broadcast(roles), "doc_id", "left").select("text", F.coalesce("g", F.lit(0)).alias("chosen"), F.coalesce("t", F.lit(-1)).alias("toxic"))
    kinds = ["raw", "target", "clean", "toxic"]
    rows = marked.mapInArrow(_count, "bucket long, " + ", ".join(f"{k} long" for k in kinds)).groupBy("bucket").agg(*[F.sum(k).alias(k) for k in kinds]).collect()
    counts = np.zeros((4, BUCKETS))
    for r in rows:
        counts[:, r["bucket"]] = r["raw"], r["target"], r["clean"], r["toxic"]
    p = (counts[:2] + 1.0) / (counts[:2].sum(axis=1, keepdims=True) + BUCKETS)
    of = {r["toxic"]: r["n"] for r in fitting.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = counts[2] + 1.0, counts[3] + 1.0
    weights = np.log(toxic / (of.get(1, 0) + 2.0)) - np.log(clean / (of.get(0, 0) + 2.0)) - DOUBT * np.sqrt(1 / toxic + 1 / clean)
    return np.log(p[1] / p[0]), np.maximum(weights, 0.0)


def toxicity(bucket: np.ndarray, doc: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The mean of the STRONGEST largest weights among the distinct buckets of each of n documents."""
    bucket, doc = _held(bucket[weights[bucket] > 0], doc[weights[bucket] > 0])
    order = np.lexsort((-weights[bucket], doc))
    bucket, doc = bucket[order], doc[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return np.bincount(doc[rank < STRONGEST], weights=weights[bucket[rank < STRONGEST]], minlength=n) / STRONGEST


def with_scores(docs: DataFrame, ratios: np.ndarray, weights: np.ndarray) -> DataFrame:
    """docs with `score`, the shrunk mean log-ratio of the text, and `toxicity`; map-only."""
    def run(batches):
        for batch in batches:
            n, total, worst = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for bucket, doc in features(batch.column("text"), BUCKETS):
                n += np.bincount(doc, minlength=batch.num_rows)
                total += np.bincount(doc, weights=ratios[bucket], minlength=batch.num_rows)
                worst += toxicity(bucket, doc, weights, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total / (n + SHRINK)), pa.array(worst)], names=[*batch.schema.names, "score", "toxicity"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxicity", T.DoubleType())]))


def best_cut(scores: np.ndarray, good: np.ndarray, good_cost: float = GOOD_COST) -> float:
    """The score below which rows go: the cheapest place between neighbouring unlike scores."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order].astype(float)
    cost = np.concatenate([[0.0], np.cumsum(good_cost * g)]) + np.concatenate([np.cumsum((1 - g)[::-1])[::-1], [0.0]])
    cost[1:-1][s[1:] == s[:-1]] = np.inf
    at = int(np.argmin(cost))
    return float("-inf") if at == 0 else float((s[at - 1] + (s[at] if at < len(s) else s[at - 1] + 1)) / 2)


def gumbel_key(doc_id: Column, score: Column, seed: int = SEED) -> Column:
    """Log importance weight and Gumbel noise."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(seed + 1)), 11) + F.lit(0.5)) / float(2**53)
    return F.lit(FEATURES) * score - F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 1024, few: int = 5000) -> float:
    """The k-th largest value of df's column key (a narrow, written table): histograms of shrinking ranges, then the few rows of the last bin."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    while k > 0 and low is not None and low < high:
        width = (high - low) / bins
        if low + width == low:
            break
        bin_of = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        inside = df.where(F.col(key).between(low, high)).withColumn("bin", bin_of)
        counts = {r["bin"]: (r["n"], r["a"], r["b"]) for r in inside.groupBy("bin").agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).collect()}
        at = max(counts)
        while k > counts[at][0]:
            k -= counts[at][0]
            at = max(b for b in counts if b < at)
        n, low, high = counts[at]
        if n <= few:
            return inside.where(F.col("bin") == at).orderBy(F.desc(key)).limit(k).agg(F.min(key)).first()[0]
    return high if low is not None and k > 0 else float("inf")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Log-ratios and toxic weights of the buckets, the least score and the largest toxicity that stay."""
    sample = write_shared(labelled_sample(labels), "quality-sample")
    ratios, weights = log_ratios(docs, sample.where("fold = 0"))
    held = docs.select("doc_id", "text").join(F.broadcast(sample.where("fold = 1")), "doc_id")
    held = held.groupBy("doc_id", "good", "toxic").agg(F.min("text").alias("text")).select("text", "good", "toxic")
    rows = with_scores(held, ratios, weights).select("score", "toxicity", "good", "toxic").toPandas()
    most = -best_cut(-rows["toxicity"].to_numpy(float), 1 - rows["toxic"].to_numpy(int), CLEAN_COST)
    return ratios, weights, best_cut(rows["score"].to_numpy(float), rows["good"].to_numpy(int)), most


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, float, float]:
    """A narrow table (doc_id, score, toxicity, gumbel, kept), the fitted ratios and weights, the least sum and the largest toxicity that are kept."""
    ratios, weights, cut, most = fit(docs, labels)
    scored = with_scores(docs.select("doc_id", "text"), ratios, weights).select("doc_id", "score", "toxicity", gumbel_key(F.col("doc_id"), F.col("score")).alias("gumbel"))
    scored = write_shared(scored, "quality-scores")
    clean = scored.where(F.col("toxicity") <= most)
    least = kth_largest(clean, "gumbel", clean.where(F.col("score") >= cut).count()) if cut > float("-inf") else float("-inf")
    return scored.withColumn("kept", (F.col("gumbel") >= least) & (F.col("toxicity") <= most)), ratios, weights, least, most


def verdicts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray, float]:
    """A narrow table (doc_id, score, toxicity, gumbel, kept), the fitted ratios and the least sum that is kept."""
    found, ratios, _, least, _ = judged(docs, labels)
    return found, ratios, least


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the resampling keeps, with their own columns; scored again on the way, so no text is shuffled."""
    _, ratios, weights, least, most = judged(docs, labels)
    plain = docs.select("doc_id", "text").schema.names
    renamed = docs.toDF(*[c if c in plain else f"c{i}_{c}" for i, c in enumerate(docs.columns)])
    stays = (gumbel_key(F.col("doc_id"), F.col("score")) >= least) & (F.col("toxicity") <= most)
    return with_scores(renamed, ratios, weights).where(stays).drop("score", "toxicity").toDF(*docs.columns)
