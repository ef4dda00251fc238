"""Sharding by a hierarchical weighted hash tree.

Shards stand under racks and racks under regions; a node weighs what its shards weigh together. A document descends from
the root: at each node every child draws -ln(u) / weight, with u hashed from the document's key and the child's path,
and the least draw wins. If weights change, documents move only into or out of subtrees whose weights changed. A shard
that opens a region (and rack) of its own takes documents only into itself, since all other draws stay as they are.

Defined cases: a null key draws as the word "null"; rows with one key share a shard; nodes without weight never win; an
empty table stays empty; own columns are named by the caller, and all others pass through.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import write_shared

Leaf = tuple[str, str, int, float]  # region, rack, shard, weight


def regular_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 5) -> list[Leaf]:
    """Shards 0 up to `shards` of weight 1, filled rack by rack and region by region."""
    per_region = racks_per_region * shards_per_rack
    return [(f"r{i // per_region}", f"k{i % per_region // shards_per_rack}", i, 1.0) for i in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own, so that rows move only into it."""
    top = max((leaf[2] for leaf in tree), default=-1) + 1
    return [*tree, (f"new{top}", "k0", top, weight)]


def _draw(key: Column, path: Column, child: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), path, child), 11)
    return -F.log((bits + F.lit(0.5)) / float(2**53))


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key, as an int Column: three weighted draws, one a level."""
    children: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for region, rack, shard, weight in tree:
        if weight > 0:
            children["/"][region] += weight
            children[f"/{region}"][rack] += weight
            children[f"/{region}/{rack}"][str(shard)] += weight
    arms = F.create_map(*[x for path, kids in children.items() for x in (F.lit(path), F.array(*[F.struct(F.lit(k).alias("name"), F.lit(w).alias("weight")) for k, w in kids.items()]))])

    def descend(path: Column) -> Column:
        scored = F.transform(F.element_at(arms, path), lambda c: F.struct((_draw(key, path, c["name"]) / c["weight"]).alias("d"), c["name"].alias("name")))
        return F.array_min(scored)["name"]

    region = descend(F.lit("/"))
    rack_path = F.concat(F.lit("/"), region)
    return descend(F.concat(rack_path, F.lit("/"), descend(rack_path))).cast("int")


def with_slots(docs: DataFrame, shard: str, slot: str, order: list[str], slices: int = 1024) -> DataFrame:
    """docs with a gapless number from 0 within each shard.

    A shard's rows are cut into hashed slices; rows are numbered within a slice and each slice starts where the ones
    before it end, so no task sees a whole shard. docs is read twice and should be a written table.
    """
    cut = docs.withColumn("slot_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(shard).orderBy("slot_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(shard, "slot_slice").agg(F.count("*").alias("slot_n")).select(shard, "slot_slice", F.coalesce(F.sum("slot_n").over(before), F.lit(0)).alias("slot_start"))
    own = Window.partitionBy(shard, "slot_slice").orderBy(*order)
    numbered = cut.withColumn("slot_own", F.row_number().over(own) - 1)
    return numbered.join(starts, [shard, "slot_slice"]).withColumn(slot, F.col("slot_own") + F.col("slot_start")).select(*docs.columns, slot)


def shard_documents(docs: DataFrame, shards: int = 40, slices: int = 1024) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, shard, slot and grown_shard (with one more shard) of docs(doc_id, text)."""
    tree = regular_tree(shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"),
    )
    return with_slots(write_shared(placed, "shards"), "shard", "slot", ["doc_id", "text_crc32", "size"], slices)
