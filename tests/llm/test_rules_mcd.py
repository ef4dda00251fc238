"""The minimum covariance determinant against numpy C-steps on small groups, and the whole verdict from it."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import rules

P = len(rules.AXES)


def bin_of(d):
    return np.floor(16 * np.log2(1 + 64 * np.maximum(d, 0)))


def nearest(x, d, share):
    """Mean and covariance of all rows up to the bin in which the share of rows is reached."""
    bins = bin_of(d)
    last = np.sort(bins)[int(np.ceil(share * len(x))) - 1]
    k = x[bins <= last]
    return k.mean(0), (k.T @ k) / len(k) - np.outer(k.mean(0), k.mean(0))


def middle(v):
    r = np.sort(np.sign(v) * np.floor(np.abs(v) / 0.005 + 0.5), axis=0)
    return r[-(-len(v) // 2) - 1] * 0.005


def mcd(x):
    med = middle(x)
    near = (((x - med) / rules.FLOORS) ** 2).sum(1)
    starts = [(med, np.diag((1.4826 * middle(np.abs(x - med))) ** 2)), nearest(x, np.zeros(len(x)), 1.0), nearest(x, near, 0.5)]
    found = []
    for k, (center, cov) in enumerate(starts):
        before = np.inf
        for _ in range(rules.MOST_STEPS):
            y = x - center
            center, cov = nearest(x, np.einsum("ij,jk,ik->i", y, np.linalg.inv(rules.with_floors(cov)), y), rules.H_SHARE)
            logdet = np.linalg.slogdet(rules.with_floors(cov))[1]
            found.append((round(logdet, 6), k, center, cov))
            if before - logdet < rules.SETTLED:
                break
            before = logdet
    return min(found, key=lambda f: f[:2])[2:]


def brute_verdicts(rows):
    """kept by (doc_id, text) for rows with lang, source and statistics that pass the base rule."""
    x = np.array([[r[a] for a in rules.AXES] for r in rows])
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        for g in (("all",), (r["lang"],), (r["lang"], r["source"])):
            groups[g].append(i)
    fitted = {g: mcd(x[i]) for g, i in groups.items()}
    far = []
    for i, r in enumerate(rows):
        center = cov = None
        for g in (("all",), (r["lang"],), (r["lang"], r["source"])):
            m, c, n = *fitted[g], len(groups[g])
            center = m if center is None else (n * m + rules.PRIOR * center) / (n + rules.PRIOR)
            cov = c if cov is None else (n * c + rules.PRIOR * cov) / (n + rules.PRIOR)
        y = x[i] - center
        far.append(y @ np.linalg.inv(rules.with_floors(cov)) @ y)
    return far


def test_against_numpy(documents):
    found = rules.verdicts(documents)
    rows = [r for r in found.select("*", *rules.axes()).collect() if not r["base_failed"]]
    assert [r["distance"] for r in rows] == pytest.approx(brute_verdicts(rows), rel=0.02, abs=0.02)


def test_determinants_fall_and_starts_agree_on_clean_groups(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.5, (900, P)), rng.normal(6, 0.1, (100, P))])
    z = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{a} double" for a in rules.AXES))
    (row,) = rules.estimates(z).collect()
    cov = np.array(row["cov"]).reshape(P, P) * rules.CONSISTENCY
    assert np.abs(np.array(row["center"])).max() < 0.1 and np.allclose(np.diag(cov), 0.25, atol=0.08)  # the far cluster has no part in it
    shares = rules.variance_shares(spark.createDataFrame([("en", "a", [0.0] * P, [1.0 if i % (P + 1) == 0 else 0.0 for i in range(P * P)])], "g_lang string, g_source string, center array<double>, cov array<double>"))
    assert all(v < 0.01 for v in shares.select(*rules.AXES).first())


def test_groups_of_one_row_and_no_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, text, None, None), (3, "", "fr", "b")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["kept"] for r in rules.verdicts(docs).collect()} == {1: True, 2: True, 3: False}
    assert rules.verdicts(docs.where(F.col("doc_id") == 3)).count() == 1


def test_null_groups_are_groups_of_their_own(spark, documents):
    """Nulls in language and source give the estimates that names of their own would give."""
    from pyspark.sql import functions as F

    source = F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.col("source").substr(1, 4))
    lang = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("lang"))
    docs = documents.withColumn("source", source).withColumn("lang", lang)
    named = docs.fillna("none", ["source", "lang"])
    found, expected = [{(r.lang or "none", r.source or "none", r.doc_id): (round(r.distance, 6) if r.distance is not None else None, r.kept) for r in rules.verdicts(d).collect()} for d in (docs, named)]
    assert found == expected and any("none" in k for k in found)
