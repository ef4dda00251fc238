"""Shards from the hash tree and scores from the n-gram models, each computed again in plain Python."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
import xxhash

from factloom.llm import quality, queries, sharding

MASK = (1 << 64) - 1


def chained(*parts: str) -> int:
    """Spark's xxhash64 of several strings: each hash is the seed of the next."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed


def descend(key: str, tree: list[sharding.Leaf]) -> int:
    path, nodes = "/", tree
    for level in range(3):
        weight = Counter()
        for leaf in nodes:
            weight[str(leaf[level])] += leaf[3]
        draw = {name: -math.log(((chained(key, path, name) >> 11) + 0.5) / 2.0**53) / w for name, w in weight.items() if w > 0}
        won = min(draw, key=lambda name: (draw[name], name))
        nodes = [leaf for leaf in nodes if str(leaf[level]) == won]
        path = f"/{won}" if path == "/" else f"{path}/{won}"
    return int(won)


def test_every_document_stands_where_the_draws_put_it(spark, sf_dir, documents):
    tree = sharding.regular_tree(40)
    found = {r.doc_id: r for r in queries.op4_sharding(spark, sf_dir).collect()}
    rows = documents.collect()
    assert len(found) == len(rows)
    for r in rows:
        own, data = found[r.doc_id], (r.text or "").encode()
        assert (own.shard, own.grown_shard) == (descend(str(r.doc_id), tree), descend(str(r.doc_id), sharding.grown(tree)))
        assert (own.size, own.text_crc32) == (len(data) + 16, zlib.crc32(data))
    slots = {}
    for r in found.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("weights", [(1.0, 2.0, 0.0, 0.5), (3.0, 0.1, 1.0, 1.0)])
def test_weighted_trees(spark, weights):
    from pyspark.sql import functions as F

    tree = [(f"r{k % 2}", f"k{k // 2}", k, w) for k, w in enumerate(weights)]
    rows = spark.range(300).select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect()
    assert all(r.s == descend(str(r.id), tree) for r in rows)


def mixed(h: int) -> int:
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & MASK
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ (h >> 33)


def buckets_of(text: str) -> list[int]:
    """Buckets of the words and neighbouring pairs of a text."""
    base, out = 0x9E3779B97F4A7C15, []
    for word in (text or "").encode().split():
        out.append(mixed(sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(word)) + len(word) & MASK))
    pairs = [mixed(a * 3 + b + 1 & MASK) for a, b in zip(out, out[1:], strict=False)]
    return [h % quality.BUCKETS for h in out + pairs]


def test_scores_are_the_mean_log_ratios(spark, sf_dir, documents):
    """Counts of all texts and of the good ones in the fitting fold, their ratios, and every document's score and verdict."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found, ratios, weights, least, most = quality.judged(documents, labels)
    good = {r.doc_id for r in quality.labelled_sample(labels).where("fold = 0 and good = 1").collect()}
    raw, target, own = Counter(), Counter(), {}
    for r in documents.collect():
        own[r.doc_id] = buckets_of(r.text)
        raw.update(own[r.doc_id])
        if r.doc_id in good:
            target.update(own[r.doc_id])
    size = (sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS)
    ratio = {b: math.log((target[b] + 1) / size[1]) - math.log((raw[b] + 1) / size[0]) for b in raw}
    assert all(ratios[b] == pytest.approx(v, abs=1e-9) for b, v in ratio.items())
    for r in found.collect():
        mine = own[r.doc_id]
        score = sum(ratio[b] for b in mine) / (len(mine) + quality.SHRINK)
        u = ((xxhash.xxh64_intdigest((quality.SEED + 1).to_bytes(4, "little"), xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), 42)) >> 11) + 0.5) / 2.0**53
        toxic = sum(sorted((float(weights[b]) for b in set(mine)), reverse=True)[: quality.STRONGEST]) / quality.STRONGEST
        assert r.score == pytest.approx(score, abs=1e-9) and r.gumbel == pytest.approx(quality.FEATURES * score - math.log(-math.log(u)), abs=1e-6)
        assert r.toxicity == pytest.approx(toxic, abs=1e-9) and r.kept == (r.gumbel >= least and r.toxicity <= most)
