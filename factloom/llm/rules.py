"""Quality rules: plain limits on word and repetition counts, then robust multivariate outliers.

Each text gives a vector of transformed statistics (logs of mean word length and of the words a line; square
roots of the shares of symbols, duplicate lines, repeated words and upper-case letters). Per language and source, per
language and for the table the minimum covariance determinant is estimated from three deterministic starts (medians and
MADs; mean and covariance of all rows; those of the half nearest to the medians). C-steps, each of which takes the H_SHARE
of rows with the least Mahalanobis distances and estimates mean and covariance anew, go on until no determinant falls any
more, and the start with the least one wins. A step is one aggregate of moments over the rows by group, start and bin of
the distance, so a group may be of any size and no rows are gathered.

A pair's estimate is drawn to its language's, and a language's to the table's, by PRIOR rows' worth, so small groups need
no rule of their own. FLOORS are added to the variances for axes that are constant over clean text (where they decide);
variance_shares() tells their part of the variance, by axis. Rows beyond CUTOFF go.

Defined cases: a null text has no words and fails the base rule; null language and source are values like others; with
no eligible row nothing is estimated and the result has only base failures; repeated rows count as often as they occur;
rows whose distances fall into the dividing bin are all taken; a very long text is one vector like others; other columns
of the input pass through or are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.shared import small_side, write_shared

MIN_WORDS, REPEAT_PERCENT = 50, 50
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
AXES = ["x0", "x1", "x2", "x3", "x4", "x5"]
#: Standard deviations that are added (as variances) to each axis.
FLOORS = [0.02, 0.10, 0.10, 0.10, 0.01, 0.10]
H_SHARE = 0.75
#: Covariance of the inner 75 % of a six-dimensional normal distribution, brought back to the whole.
CONSISTENCY = 1.361
#: A fall of the log determinant below this counts as none; no start is followed for more than MOST_STEPS.
SETTLED, MOST_STEPS = 0.01, 30
PRIOR = 100
#: The chi-square value with six degrees of freedom that one normal vector in a million exceeds.
CUTOFF = 38.3
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-Z]")


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    repeated = 0
    if n > 3:
        base = len(ids) + 1
        if base < 2_000_000:
            _, inverse, counts = np.unique((w[:-2] * base + w[1:-1]) * base + w[2:], return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
        else:
            windows = list(zip(words, words[1:], words[2:], strict=False))
            found = Counter(windows)
            twice = np.array([found[x] > 1 for x in windows])
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        repeated = int(inside.sum())
    lines = [x for x in text.split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
    chars = len(text) - sum(map(text.count, "\x20\t\n\x0b\x0c\r"))
    return n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), len(_UPPER.findall(text))


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with STATS of `text` after their own columns; map-only."""
    def run(batches):
        for batch in batches:
            rows = [text_stats(x.as_py()) for x in batch.column("text")]
            found = np.array(rows, dtype=np.int64).reshape(len(rows), len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[:, k]) for k in range(len(STATS))]], names=[*batch.schema.names, *STATS])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(x, T.LongType()) for x in STATS]]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def axes() -> list[Column]:
    n, lines, chars = (F.greatest(c, F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    share = lambda a, b: F.sqrt(F.col(a) / b)
    found = [F.log(chars / n), share("n_symbols", n), share("n_dup_lines", lines), share("n_repeat_words", n), share("n_upper", chars), F.log(n / lines)]
    return [c.cast("double").alias(a) for c, a in zip(found, AXES, strict=True)]


def _distance() -> Column:
    """Squared Mahalanobis distance of AXES under center and inverse (row by row) of the joined estimate."""
    d = [F.col(a) - F.col("center")[i] for i, a in enumerate(AXES)]
    terms = [d[i] * d[j] * F.col("inverse")[i * len(AXES) + j] for i in range(len(AXES)) for j in range(len(AXES))]
    return sum(terms[1:], terms[0])


def with_floors(cov: np.ndarray) -> np.ndarray:
    return cov * CONSISTENCY + np.diag(np.square(FLOORS))


def _square(cov) -> np.ndarray:
    return np.array(list(cov), float).reshape(len(AXES), len(AXES))


def _inverted(frames):
    """Inverse and log determinant of each estimate's covariance with floors; fell: by how much the latter is less than before."""
    for f in frames:
        found = [with_floors(_square(c)) for c in f["cov"]]
        logdet = [float(np.linalg.slogdet(m)[1]) for m in found]
        yield pd.DataFrame({
            "grp": f["grp"], "start": f["start"], "center": f["center"].map(list), "cov": f["cov"].map(list), "inverse": [np.linalg.inv(m).ravel().tolist() for m in found],
            "logdet": logdet, "fell": np.array(f["before"], float) - logdet,
        })


ESTIMATE = "grp string, start int, center array<double>, cov array<double>, inverse array<double>, logdet double, fell double"


def _middle(long: DataFrame, value: Column) -> DataFrame:
    """Median of value (to 0.005) for each grp and axis of long, from exact counts of rounded values."""
    run = Window.partitionBy("grp", "axis").orderBy("v")
    counts = long.groupBy("grp", "axis", F.round(value / 0.005).alias("v")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("grp", "axis")))
    return ranked.where(F.col("upto") * 2 >= F.col("all")).groupBy("grp", "axis").agg((F.min("v") * 0.005).alias("middle"))


def _nearest(far: DataFrame, share: float) -> DataFrame:
    """grp, start, center, cov, before of the share of rows with the least d, from moments by bin of d; far has grp, start, before, AXES and d."""
    pairs = [(i, j) for i in range(len(AXES)) for j in range(i, len(AXES))]
    moments = [F.sum(a).alias(f"s{i}") for i, a in enumerate(AXES)] + [F.sum(F.col(AXES[i]) * F.col(AXES[j])).alias(f"s{i}{j}") for i, j in pairs]
    bins = far.groupBy("grp", "start", "before", F.floor(16 * F.log2(1 + 64 * F.greatest("d", F.lit(0.0)))).alias("bin")).agg(F.count("*").alias("n"), *moments)
    upto = F.coalesce(F.sum("n").over(Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("grp", "start"))).where(F.col("upto") < share * F.col("all"))
    names = [f"s{i}" for i in range(len(AXES))] + [f"s{i}{j}" for i, j in pairs]
    sums = inner.groupBy("grp", "start", "before").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(len(AXES))]
    cov = [F.col(f"s{min(i, j)}{max(i, j)}") / F.col("n") - mean[i] * mean[j] for i in range(len(AXES)) for j in range(len(AXES))]
    return sums.select("grp", "start", "before", F.array(*mean).alias("center"), F.array(*cov).alias("cov"))


def _starts(z: DataFrame) -> DataFrame:
    """The three starts of each group."""
    long = z.select("grp", F.posexplode(F.array(*AXES)).alias("axis", "x"))
    medians = write_shared(_middle(long, F.col("x")), "rules-medians")
    spread = _middle(long.join(small_side(medians), ["grp", "axis"]), F.abs(F.col("x") - F.col("middle"))).withColumnRenamed("middle", "mad")
    rows = medians.join(spread, ["grp", "axis"]).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("axis", "middle", "mad"))).alias("a"))
    variance = F.flatten(F.transform("a", lambda p: F.transform("a", lambda q: F.when(p["axis"] == q["axis"], F.pow(1.4826 * p["mad"], 2)).otherwise(0.0))))
    none = F.lit(float("inf")).alias("before")
    first = write_shared(rows.select("grp", F.lit(0).alias("start"), none, F.transform("a", lambda p: p["middle"]).alias("center"), variance.alias("cov")), "rules-start")
    plain = z.select("grp", F.lit(1).alias("start"), none, *AXES, F.lit(0.0).alias("d"))
    d = sum((F.pow((F.col(a) - F.col("center")[i]) / FLOORS[i], 2) for i, a in enumerate(AXES)), F.lit(0.0))
    near = z.join(small_side(first.select("grp", "center")), "grp").select("grp", F.lit(2).alias("start"), none, *AXES, d.alias("d"))
    return first.unionByName(_nearest(plain, 1.0)).unionByName(_nearest(near, 0.5))


def estimates(z: DataFrame) -> DataFrame:
    """One row (grp, n, center, cov) per group of z(grp, x0..x5), a narrow written table: the settled start of least determinant."""
    found = write_shared(_starts(z).mapInPandas(_inverted, ESTIMATE), "rules-estimate")
    moving, done = found.withColumn("fell", F.lit(float("inf"))).withColumn("logdet", F.lit(float("inf"))), None  # a start is no result to compare with
    for _ in range(MOST_STEPS):
        moving = moving.where(F.col("fell") >= SETTLED)
        if moving.limit(1).count() == 0:
            break
        at = small_side(moving.select("grp", "start", F.col("logdet").alias("before"), "center", "inverse"))
        far = z.join(at, "grp").select("grp", "start", "before", *AXES, _distance().alias("d"))
        moving = write_shared(_nearest(far, H_SHARE).mapInPandas(_inverted, ESTIMATE), "rules-estimate")
        done = moving if done is None else done.union(moving)
    if done is None:
        done = found
    sizes = z.groupBy("grp").agg(F.count("*").alias("n"))
    # the least determinant of the last steps wins; equal ones go to the first start, so that reruns agree
    best = done.groupBy("grp").agg(F.min_by(F.struct("center", "cov"), F.struct(F.round("logdet", 6), "start", "logdet")).alias("e"))
    return write_shared(best.join(sizes, "grp").select("grp", "n", "e.center", "e.cov"), "rules-mcd")


def _name(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})  # a null is a value of its own


def _shrunk(frames):
    """Estimates drawn to those of the levels above: table, language and pair come as n, center and cov each (null where a level has no row)."""
    for f in frames:
        centers, covs, inverse = [], [], []
        for levels in f["levels"]:
            center = cov = None
            for e in sorted(levels, key=lambda e: -e["level"]):  # the table first
                m, c, n = np.array(list(e["center"]), float), _square(e["cov"]), e["n"]
                center = m if center is None else (n * m + PRIOR * center) / (n + PRIOR)
                cov = c if cov is None else (n * c + PRIOR * cov) / (n + PRIOR)
            centers.append(center.tolist())
            covs.append(cov.ravel().tolist())
            inverse.append(np.linalg.inv(with_floors(cov)).ravel().tolist())
        yield pd.DataFrame({"g_lang": f["g_lang"], "g_source": f["g_source"], "center": centers, "cov": covs, "inverse": inverse})


def group_estimates(stats: DataFrame) -> DataFrame:
    """lang, source, center, cov, inverse for every pair in stats (narrow, written); cov is without consistency factor and floors."""
    ok = stats.where(~base_failed()).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *axes())
    levels = [_name("g_lang", "g_source"), _name("g_lang"), F.lit("all")]
    found = estimates(write_shared(ok.select(F.explode(F.array(*levels)).alias("grp"), *AXES), "rules-vectors"))
    pairs = stats.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).distinct()
    held = pairs.select("g_lang", "g_source", F.posexplode(F.array(*levels)).alias("level", "grp")).join(small_side(found), "grp")
    lists = held.groupBy("g_lang", "g_source").agg(F.collect_list(F.struct("level", "n", "center", "cov")).alias("levels"))
    return write_shared(lists.mapInPandas(_shrunk, "g_lang string, g_source string, center array<double>, cov array<double>, inverse array<double>"), "rules-estimates")


def variance_shares(found: DataFrame) -> DataFrame:
    """g_lang, g_source and for each axis the floor's share of the variance that distances are taken with."""
    shares = [(FLOORS[i] ** 2 / (F.col("cov")[i * len(AXES) + i] * CONSISTENCY + FLOORS[i] ** 2)).alias(a) for i, a in enumerate(AXES)]
    return found.select("g_lang", "g_source", *shares)


def judged(stats: DataFrame, found: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """stats with base_failed, distance (squared; null if nothing was estimated) and kept."""
    joined = stats.join(small_side(found), stats["lang"].eqNullSafe(found["g_lang"]) & stats["source"].eqNullSafe(found["g_source"]), "left")
    for c, a in zip(axes(), AXES, strict=True):
        joined = joined.withColumn(a, c)
    joined = joined.withColumn("base_failed", base_failed()).withColumn("distance", _distance())
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).drop(*AXES, "g_lang", "g_source", "center", "cov", "inverse")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, STATS, base_failed, distance, kept of docs."""
    stats = write_shared(with_stats(docs.select("doc_id", "lang", "source", "text")).drop("text"), "rules-stats")
    return judged(stats, group_estimates(stats))


def keep_regular(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns; statistics are computed again on the way, so no text is shuffled."""
    stats = write_shared(with_stats(docs.select("lang", "source", "text")).drop("text"), "rules-stats")
    own = ("lang", "source", "text")
    renamed = docs.toDF(*[c if c in own else f"c{i}_{c}" for i, c in enumerate(docs.columns)])
    return judged(with_stats(renamed), group_estimates(stats)).where("kept").select(*renamed.columns).toDF(*docs.columns)
