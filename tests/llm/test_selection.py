"""Classifier, rules and near-duplicates against brute force, held-out accuracy and planted cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import quality, rules, simhash
from factloom.llm.shared import write_shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("which", ["documents", "odd_docs", "no_docs"])
def test_rule_statistics(which, request):
    docs = request.getfixturevalue(which)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = rules.verdicts(docs).collect()
    expected = [(d, *brute_stats(t)) for d, t in texts]
    assert sorted(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in found) == sorted(map(repr, expected))
    for r in found:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_outliers_go_and_a_hot_group_is_estimated(spark):
    rng = random.Random(5)
    plain = [" ".join(rng.choice(["ab", "abc", "abcd", "abcde", "abcdef", "xyzab", "qrs"]) + str(rng.randrange(99)) for _ in range(120)) for _ in range(600)]
    bad = ["### %%% &&& " * 3 + " ".join(f"#{k}$%" for k in range(100)), " ".join("x" * 40 + str(k) for k in range(80))]
    docs = spark.createDataFrame([(k, t, "en" if k % 5 else "fr", "hot" if k % 3 else "few") for k, t in enumerate(plain + bad)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.verdicts(docs).collect()}
    assert all(kept[k] for k in range(600)) and not kept[600] and not kept[601]
    assert {r["doc_id"] for r in rules.keep_regular(docs).collect()} == set(range(600))


def test_filters_keep_columns(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    for keep in (rules.keep_regular, simhash.keep_first, lambda d: quality.keep_good(d, labels)):
        assert keep(odd_docs).columns == odd_docs.columns
        assert keep(odd_docs).count() <= 10
        assert keep(no_docs).count() == 0


def test_classifier_on_labelled_rows(spark, documents, sf_dir):
    """Labelled good rows stay, most junk goes; the verdict of the filter is that of the table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found, _, _ = quality.verdicts(documents, labels)
    assert found.count() == documents.count()
    rows = found.join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["toxic"]]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.95 and (not junk or np.mean(junk) <= 0.5)
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(documents, labels).select("doc_id").collect()} == kept


def test_gumbel_draw_decides_at_the_border(spark):
    """Inclusion rates follow the weights over many documents and seeds, and the sample's size is fixed."""
    scores = [-0.2, -0.1, -0.05, 0.0, 0.1]
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, scores)), (F.col("id") % 5 + 1).cast("int")).alias("score"))
    kept = []
    for seed in (1, 2, 3):
        keyed = write_shared(docs.withColumn("gumbel", quality.gumbel_key(F.col("doc_id"), F.col("score"), seed)), "t")
        least = quality.kth_largest(keyed, "gumbel", 9_000)
        rows = keyed.where(F.col("gumbel") >= least).collect()
        assert len(rows) == 9_000
        rates = Counter(r["score"] for r in rows)
        for s in scores:
            assert rates[s] / 4000 == pytest.approx(1 - np.exp(-np.exp(quality.FEATURES * s - least)), abs=0.03)
        kept.append({r["doc_id"] for r in rows})
    assert len(kept[0] - kept[1]) > 500 and len(kept[1] - kept[2]) > 500


def test_odd_rows_are_judged(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, 1, 0), (4, 0, 0), (None, 1, 0), (-3, 0, 1)], "doc_id long, quality int, toxic int")
    found = quality.verdicts(odd_docs, labels)[0].collect()
    assert len(found) == 10 and all(r["kept"] is not None and r["gumbel"] is not None for r in found)
    assert {r["score"] for r in found if r["doc_id"] in (1, 2, 3)} == {0.0}
    assert len({(r["score"], r["toxicity"], r["gumbel"], r["kept"]) for r in found if r["doc_id"] == 6}) == 1
    assert quality.verdicts(no_docs, labels)[0].count() == 0


def test_without_labels_all_stay(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(documents, none).count() == documents.count()


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 2.0, 3.0], [5.0] * 7, list(np.random.default_rng(3).gumbel(size=2000))])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in {1, 2, 4, len(values) // 2, len(values)} - {0}:
        assert quality.kth_largest(df, "v", k, bins=16, few=8) == sorted(values, reverse=True)[k - 1]


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """The least id of each print's component, by comparing all pairs of distinct prints."""
    distinct = sorted(set(prints.values()))
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least = {}
    for d, p in prints.items():
        least[top(p)] = min(least.get(top(p), d), d)
    return {d: least[top(p)] for d, p in prints.items()}


def test_near_duplicates(documents):
    prints = {r["doc_id"]: brute_print(r["text"]) for r in documents.collect()}
    found = simhash.near_duplicates(documents).collect()
    assert {r["doc_id"]: r["fp"] % 2**64 for r in found} == prints
    components = brute_components(prints)
    assert {r["doc_id"]: r["component_id"] for r in found} == components
    assert {r["doc_id"] for r in simhash.keep_first(documents).collect()} == set(components.values())


@pytest.mark.parametrize("crowd", [400, 1])
def test_planted_links(spark, crowd):
    """Chains and crowds of prints one and two bits apart; with crowd=1 every link takes the exact other way."""
    rng, prints = random.Random(9), {}
    for _ in range(25):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints[len(prints)] = p
            for b in rng.sample(range(64), rng.randrange(4)):
                p ^= 1 << b
    prints[len(prints)] = 0
    signed = [(d, p - 2**64 if p >= 2**63 else p) for d, p in prints.items()]
    rows = write_shared(spark.createDataFrame(signed, "doc_id long, fp long"), "t")
    found = {r["fp"]: r["component_id"] for r in simhash.classes(rows, crowd).collect()}
    assert {d: found[p] for d, p in signed} == brute_components(prints)


def test_rows_of_one_id_are_judged_apart(spark):
    """Of repeated ids with different texts, null ids and ties only one row of each component goes; reruns agree."""
    x, y, z = ("a b c d e f", "other words that stand nowhere else", "third text of some words here")
    rows = [(5, x), (6, x), (6, y), (None, x), (None, z), (None, z), (8, z), (9, None), (9, ""), (9, None), (4, "u v w"), (4, "u v w")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, own_fp string")
    for _ in range(2):
        found = [tuple(r) for r in simhash.keep_first(docs).collect()]
        assert sorted(map(repr, found)) == sorted(map(repr, [(5, x, "s"), (6, y, "s"), (8, z, "s"), (4, "u v w", "s")] + [f for f in found if f[0] == 9]))
        assert len([f for f in found if f[0] == 9]) == 1


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).select("doc_id", F.col("fp"), "component_id").collect()
    assert len(rows) == 10
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {1}  # null, empty and blank texts are one class
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert [r["doc_id"] for r in simhash.keep_first(odd_docs).where("doc_id in (1, 2, 3, 5, 6)").orderBy("doc_id").collect()] == [1, 5]
    assert simhash.near_duplicates(no_docs).count() == 0
