"""Mixing against a brute-force plan; the laws of the shards."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing, sharding
from factloom.llm.shared import word_count, write_shared


def brute_targets(sizes):
    """Water level by repeated resharing of what is above the caps."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in open_}
        capped |= {s: 2.0 * sizes[s] for s in over}


def mixed(docs, **how):
    sized = write_shared(docs.withColumn("size", word_count(F.col("text"))).select("doc_id", "source", "size"), "t")
    return mixing.with_copies(sized, mixing.plan(sized, **how), F.col("size")).collect()


def expected_copies(size, level):
    return min(2.0, level * max(1, 64 - 3 * size.bit_length()))


def brute_copies(rows, targets, seed=17):
    """Copies of each of rows(doc_id, source, size): bisected levels, certain copies, then the rank by Pareto ratio until the words are used up."""
    found = {}
    by_source = defaultdict(list)
    for doc, source, size in rows:
        by_source[source].append((doc, size))
    for source, own in by_source.items():
        target, total = targets[source], sum(size for _, size in own)
        low, high = 0.0, 2.0
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(n * expected_copies(n, level) for _, n in own) < target else (low, level)
        wanted = {(d, n): 2.0 if target >= 2 * total else expected_copies(n, high) for d, n in own}
        rest, ranked = target - sum(int(wanted[x] + 1e-12) * x[1] for x in own), []
        for doc, size in own:
            whole = int(wanted[doc, size] + 1e-12) if total else 0
            p = wanted[doc, size] - whole
            found[doc, source, size] = whole
            if total and p > 1e-12:
                u = (int(hashlib.md5(f"pareto|{seed}|{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append((u / (1 - u) / (p / (1 - p)), doc, size))
        upto = 0
        for _, doc, size in sorted(ranked, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
            upto += size
            found[doc, source, size] += upto - size / 2 <= rest
    return found


def test_mix_against_brute_force(documents):
    rows = mixed(documents)
    plain = [(r["doc_id"], r["source"], r["size"]) for r in rows]
    sizes = Counter()
    for _, source, size in plain:
        sizes[source] += size
    expected = brute_copies(plain, brute_targets(sizes))
    assert {(r["doc_id"], r["source"], r["size"]): r["mix_copies"] for r in rows} == expected


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_mix(which, request):
    rows = mixed(request.getfixturevalue(which))
    sizes, taken, biggest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["mix_copies"] * r["size"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    targets = brute_targets(sizes)
    for r in rows:
        assert r["mix_source_size"] == sizes[r["source"]] and r["mix_target"] == pytest.approx(targets[r["source"]]) and 0 <= r["mix_copies"] <= 2
    for s, t in targets.items():
        assert abs(taken[s] - t) <= biggest[s] * (2 if which == "odd_docs" else 0.5) + 1e-6
    assert sorted(map(repr, rows)) == sorted(map(repr, mixed(request.getfixturevalue(which))))


def test_inclusion_rates_and_order(spark):
    """400 sources with the same sizes are 400 draws: the rates are the expected copies, and rank is by ratio, not by draw."""
    sizes = [3, 3, 12, 12, 50, 50, 200, 200, 800, 800] * 3
    rows = [(s * 100 + k, f"s{s:03}", "w " * n) for s in range(400) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found, ranks = defaultdict(list), defaultdict(list)
    for r in mixed(docs, weights=(1,), share=0.6):
        found[r["size"]].append(r["mix_copies"])
        u = int(hashlib.md5(f"pareto|17|{r['doc_id']}".encode()).hexdigest()[:13], 16)
        ranks[r["source"]].append((u, r["mix_copies"]))
    low, high = 0.0, 2.0
    for _ in range(100):
        level = (low + high) / 2
        low, high = (level, high) if sum(n * expected_copies(n, level) for n in sizes) < 0.6 * sum(sizes) else (low, level)
    for n, copies in found.items():
        assert sum(copies) / len(copies) == pytest.approx(expected_copies(n, level), abs=0.05)
    taken = [[c for _, c in sorted(own)] for own in ranks.values()]
    assert any(c != sorted(c, reverse=True) for c in taken)


def test_mix_of_nothing(no_docs):
    assert mixed(no_docs) == []


def test_one_group_may_hold_nearly_all(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w " * 7).alias("text"), F.when(F.col("id") < 2990, "hot").otherwise("small").alias("source"))
    found = Counter()
    for r in mixed(docs):
        found[r["source"]] += r["mix_copies"] * r["size"]
    assert abs(found["hot"] - (1.5 * 21000 - 140)) <= 7 and found["small"] == 140


def test_growth_takes_rows_only_into_the_new_shard(documents):
    rows = sharding.shard_documents(documents).collect()
    assert len(rows) == documents.count()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows) and any(r["grown_shard"] == 40 for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_confined_movement(spark):
    tree = sharding.regular_tree(20)
    heavier = [(*leaf[:3], 3.0 if leaf[2] == 2 else 1.0) for leaf in tree]
    keys = spark.range(40_000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).collect()
    counts = Counter(r["a"] for r in rows)
    assert set(counts) == set(range(20)) and all(abs(n - 2000) < 250 for n in counts.values())
    assert Counter(r["b"] for r in rows)[2] == pytest.approx(40_000 * 3 / 22, rel=0.1)
    path = {leaf[2]: leaf[:2] for leaf in tree}
    for r in rows:
        if r["a"] != r["b"]:  # whatever moves goes into a subtree whose weight grew: shard 2, its rack or its region
            assert r["b"] == 2 or path[r["b"]] == path[2] or path[r["b"]][0] == path[2][0]


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs).collect()
    assert len(rows) == 10 and sum(r["size"] == 16 for r in rows) == 3
    assert len({r["shard"] for r in rows if r["doc_id"] == 6}) == 1 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.shard_documents(no_docs).count() == 0
