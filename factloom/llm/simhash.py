"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint bit is the majority of that bit over the XXH64 hashes of the text's 3-word shingles. Two fingerprints that
differ in at most two bits differ in at most one bit in one of two 32-bit segments. So each distinct fingerprint is
indexed under every segment with one position deleted (the bit there is kept beside the key) and under each whole
segment; an equality join of unlike bits at one deleted position, or of equal segments, gives the candidates, each once
a segment, and the Hamming distance verifies them.

Where more than CROWD fingerprints share a key, pairs would grow with the square of that crowd. Its members are joined
by an exact other way: each sends itself to itself and its 64 one-bit neighbours; two fingerprints are within two bits
exactly if they meet at such a point, and all that meet at a point are within two bits of each other, so linking each to
the least there connects the same components without pairs. Components come from alternating large-star and small-star
steps over written tables.

Defined cases: a null text counts as empty; a text without words has fingerprint zero; equal fingerprints are one class;
null doc_ids never name a component unless a whole component has none; repeated rows repeat in the result; a very long text
is hashed shingle by shingle; an empty table stays empty; other columns pass through or are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.shared import small_side, write_shared

SHINGLE, HASH_SEED, BITS = 3, 42, 64
CROWD = 400
FPS_A_TASK = 25_000  # each gives 66 keys
WHOLE = 32  # the position number of a segment from which nothing is deleted


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: -SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def with_fingerprints(docs: DataFrame, column: str = "fp") -> DataFrame:
    """docs with the fingerprint of `text` as a signed long; map-only."""
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))


def deletion_keys(fps: DataFrame) -> DataFrame:
    """fp, key, bit: each segment with one position deleted (and the bit deleted there), and each whole segment (bit null).

    A key holds the variant, the position and the segment's number in one long.
    """
    rows = []
    for s in range(2):
        seg = _segment(F.col("fp"), s)
        for i in range(32):
            rows.append(F.struct((seg.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))) * 128 + (i * 2 + s)).alias("key"), F.shiftright(seg, i).bitwiseAND(F.lit(1)).cast("byte").alias("bit")))
        rows.append(F.struct((seg * 128 + (WHOLE * 2 + s)).alias("key"), F.lit(None).cast("byte").alias("bit")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("k")).select("fp", "k.key", "k.bit")


def close_links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of fps(fp; distinct, a written table) within two bits of each other."""
    keys = deletion_keys(fps.repartition(max(1, -(-fps.count() // FPS_A_TASK))))
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("bit") == 0).alias("zeros"), F.count_if(F.col("bit") == 1).alias("ones"))
    met = met.where((F.col("zeros") * F.col("ones") > 0) | ((F.col("zeros") + F.col("ones") == 0) & (F.col("n") > 1)))
    met = write_shared(met.select("key", (F.col("n") > crowd).alias("crowded")), "simhash-keys")
    held = write_shared(keys.join(met, "key"), "simhash-held")
    few = held.where("not crowded")
    a, b = few.select("key", F.col("fp").alias("a"), F.col("bit").alias("a_bit")), few.select("key", F.col("fp").alias("b"), F.col("bit").alias("b_bit"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    unlike = a.where("a_bit = 0").join(b.where("b_bit = 1"), "key").where(close).select("a", "b")
    equal = a.where("a_bit is null").join(b.where("b_bit is null"), "key").where((F.col("a") < F.col("b")) & close).select("a", "b")
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0))) for k in range(BITS)])
    meeting = held.where("crowded").select("fp").distinct().select("fp", F.explode(points).alias("point"))
    least = meeting.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    stars = meeting.join(least, "point").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b"))
    return write_shared(unlike.union(equal).union(stars).distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of edges(a, b), by alternating large-star and small-star steps."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = write_shared(e, "star")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_shared(large, "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = write_shared(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        same = e.join(small, ["u", "v"], "left_anti").limit(1).count() == 0 and small.join(e, ["u", "v"], "left_anti").limit(1).count() == 0
        e = small
        if same:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """fp, root, component_id for every fingerprint of prints(doc_id, fp): a number and the least doc_id of its component."""
    fps = write_shared(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-prints")
    tree = write_shared(components(close_links(fps.select("fp"), crowd)), "simhash-components")
    rooted = fps.join(tree, fps["fp"] == tree["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of docs(doc_id, text)."""
    prints = write_shared(with_fingerprints(docs.select("doc_id", "text")).drop("text"), "simhash-docs")
    return prints.join(write_shared(classes(prints), "simhash-classes"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(marked: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """marked (with doc_id and key) with one row of each component, told by rows(doc_id, *key, root; one for each row of marked).

    That of the least doc_id stays (null last), then of the least key; of rows alike in both, one. Other rows of a doc_id
    that stays in another component are not touched. Only what is lost is joined, so texts that stay are not shuffled
    while that is small.
    """
    whole = ["doc_id", *key]
    counted = write_shared(rows.groupBy(*whole, "root").agg(F.count("*").alias("n")), "one-rows")
    rank = F.struct(F.col("doc_id").isNull(), *whole)
    first = counted.groupBy("root").agg(F.min(rank).alias("first"), F.sum("n").alias("all")).where("all > 1").select(F.col("root").alias("of"), "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    for c in key:
        stays = stays & (F.col(c) == F.col(f"first.{c}"))
    judged = counted.join(first, F.col("root") == F.col("of")).withColumn("stays", stays).where("not stays or n > 1")
    judged = write_shared(judged.select(*[F.col(c).alias(f"lost_{c}") for c in whole], "stays"), "one-lost")
    same = marked["doc_id"].eqNullSafe(F.col("lost_doc_id"))
    for c in key:
        same = same & (marked[c] == F.col(f"lost_{c}"))
    kept, again = marked.join(small_side(judged), same, "left_anti"), judged.where("stays")
    if again.limit(1).count():
        kept = kept.unionByName(marked.join(small_side(again), same, "left_semi").dropDuplicates(whole))
    return kept


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, with its own columns; rows are told apart by doc_id, fingerprint and a hash of the text."""
    marked = lambda d: with_fingerprints(d, "own_fp").withColumn("own_hash", F.xxhash64("text"))
    prints = write_shared(marked(docs.select("doc_id", "text")).select("doc_id", F.col("own_fp").alias("fp"), "own_hash"), "simhash-docs")
    rows = prints.join(write_shared(classes(prints), "simhash-classes"), "fp").select("doc_id", F.col("fp").alias("own_fp"), "own_hash", "root")
    renamed = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}_{c}" for i, c in enumerate(docs.columns)])
    return one_of_each(marked(renamed), rows, ["own_fp", "own_hash"]).drop("own_fp", "own_hash").toDF(*docs.columns)
