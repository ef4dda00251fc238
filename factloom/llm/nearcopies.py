"""Near copies by a set-similarity join: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash with deletion variants (simhash.py) goes first: sets whose fingerprints are equal or within its two bits are
candidates. Alone it would not do: at a similarity of 0.8 fingerprints of 64 bits differ in about ten, and segments of
which one of them differs in at most one bit would be too short to tell texts apart. So what it leaves apart is indexed
under more keys. Sets of up to SMALL shingles: under one fixed order of all shingles, two sets of similarity t can only
reach it if they share one of their first n - ceil(t n) + 1, so each set has these as keys and no pair is missed. The
order puts what is frequent over all texts last, so that a passage that a third of all texts hold is hardly ever a key. It
rests on counts by bucket of a hash; any such order is exact, collisions only make it less selective. Larger
sets (and those within reach of one): BANDS times ROWS minimum hashes, each band one key; two sets of similarity 0.8 share
none with a probability of (1 - 0.8 ** ROWS) ** BANDS, 3 in a million. Every candidate of either kind is verified on the
whole sets, so none is taken unverified, up to equality of 32-bit hashes within two texts.

Where many near copies share a key, pairs would grow with the square of the crowd. So each key's members are compared
with one of them first, its least, or in keys of more than CROWD members the one that meets most others over all such keys
(the text that the others were copied from, if it is there). What that leaves in different components is pruned before any pair
is made: of a set only what sets of other components hold as well can be shared with them, which bounds the sizes that a
partner may have; a member without a partner of such a size in its key goes, which leaves others with less to share, so this
is repeated. A passage in common, however many texts hold it, brings nothing together this way. The pairs that are left are
met once each and verified. That connects the same components, whichever member came first.

Defined cases: letters are compared without ASCII case; a text of fewer words than a shingle is one shingle; null, empty
and blank texts are one class; rows are told apart by shingle set and doc_id, so of a component one row stays, that of the
least doc_id (null last), and rows that share a doc_id but not a component all stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.ngrams import mix, row_slices, utf8, word_hashes, words
from factloom.llm.shared import small_side, write_shared
from factloom.llm.simhash import close_links, components, one_of_each

SHINGLE = 5
#: The least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Sets of up to SMALL shingles have prefix keys; those of LARGE or more have bands. Similar sets share one kind, as SMALL is 5/4 of LARGE.
SMALL, LARGE = 120, 96
BANDS, ROWS = 24, 4
CROWD = 50
#: Buckets of shingles counted for the order, and how many times the mean makes one frequent: at most BUCKETS / FREQUENT are.
BUCKETS, FREQUENT = 1 << 18, 4
_TURNS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _joined(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbouring word hashes."""
    found = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        found = mix(found * np.uint64(3) + h[j : len(h) - k + 1 + j] + np.uint64(1))
    return found


def shingle_sets(column: pa.Array):
    """For one slice of rows after another: the sorted set of shingle hashes of each row."""
    for at, length in row_slices(column):
        data, offsets = utf8(pc.ascii_lower(column.slice(at, length)))
        starts, ends, doc = words(data, offsets)
        h = word_hashes(data, starts, ends)
        bounds = np.searchsorted(doc, np.arange(length + 1))
        found = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            k = min(SHINGLE, b - a)
            if not k:
                found.append(np.empty(0, np.uint64))
                continue
            found.append(np.unique(_joined(h[a:b], k)))
        yield at, found


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s % np.uint64(BUCKETS)).astype(np.int64)


def frequency_ranks(docs: DataFrame) -> np.ndarray:
    """A rank from 0 (not frequent) to 255 for each bucket of shingles, from counts over all texts of docs(text).

    Only buckets of FREQUENT times the mean or more come to the driver, which are at most BUCKETS / FREQUENT rows.
    """
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            column = batch.column("text")
            for at, length in row_slices(column):
                data, offsets = utf8(pc.ascii_lower(column.slice(at, length)))
                starts, ends, doc = words(data, offsets)
                h = word_hashes(data, starts, ends)
                if len(h) < SHINGLE:
                    continue
                joined = _joined(h, SHINGLE)[doc[SHINGLE - 1 :] == doc[: len(doc) - SHINGLE + 1]]
                total += np.bincount(_bucket(joined), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 65536):
            part = seen[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])

    counted = write_shared(docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "near-counts")
    ranks, mean = np.zeros(BUCKETS, np.uint8), (counted.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    if mean:
        often = counted.where(F.col("n") >= FREQUENT * mean).select("bucket", F.least(F.lit(255), F.floor(F.log2(F.col("n") / mean) * 8)).cast("int").alias("rank")).collect()
        ranks[[r["bucket"] for r in often]] = [r["rank"] for r in often]
    return ranks


def keys_of(s: np.ndarray, ranks: np.ndarray | None = None) -> np.ndarray:
    """The keys that an ascending set of shingle hashes is indexed under."""
    top, under = SIMILAR
    ordered = s[:0]
    if 0 < len(s) <= SMALL:  # the fixed order: rank, then hash
        ordered = s if ranks is None else s[np.argsort(ranks[_bucket(s)], kind="stable")]
    found = [ordered[: len(s) + top * len(s) // -under + 1]]
    if len(s) >= LARGE:
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
        for at in range(0, len(s), 2048):
            least = np.minimum(least, (s[at : at + 2048, None] * _TURNS).min(axis=0))
        band = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            band = mix(band * np.uint64(3) + row)
        found.append(band)
    return np.concatenate(found)


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def with_nodes(docs: DataFrame, column: str = "node") -> DataFrame:
    """docs with a number of the text's shingle set; map-only."""
    def run(batches):
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for at, sets in shingle_sets(batch.column("text")):
                found[at : at + len(sets)] = [_node(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def _print(s: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, signed."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(s), 65536):
        counts += np.unpackbits(s[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(s), bitorder="little").view("<i8")[0])


def with_sets(docs: DataFrame) -> DataFrame:
    """doc_id, node, n, fp (SimHash), keys, shingles (low 32 bits) of docs(doc_id, text)."""
    ranks = frequency_ranks(docs)

    def lists(arrays, kind):
        values = np.concatenate([*arrays, np.empty(0, np.uint64)])
        values = values.view(np.int64) if kind == np.int64 else values.astype(np.uint32).view(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(values))

    def run(batches):
        for batch in batches:
            for at, sets in shingle_sets(batch.column("text")):
                columns = [batch.column("doc_id").slice(at, len(sets)), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_print(s) for s in sets], pa.int64()), lists([keys_of(s, ranks) for s in sets], np.int64), lists(sets, np.int32)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "fp", "keys", "shingles"])

    kinds = [docs.schema["doc_id"], T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("shingles", T.ArrayType(T.IntegerType()))]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(kinds))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b; distinct, a written table) whose whole sets are similar enough; a written table."""
    top, under = SIMILAR
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    held = write_shared(sets.select("node", "n", "shingles").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "near-held")
    a, b = [held.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("shingles").alias(f"{x}_set")) for x in "ab"]
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return write_shared(pairs.join(a, "a").join(b, "b").where((top + under) * shared >= top * (F.col("a_n") + F.col("b_n"))).select("a", "b"), "near-links")


def simhash_links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of sets whose fingerprints are linked and whose sets are similar enough; a written table."""
    nodes = write_shared(sets.select("node", "fp").dropDuplicates(["node"]), "near-nodes")
    firsts = write_shared(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    equal = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = [firsts.select(F.col("fp").alias(f"{x}_fp"), F.col("first").alias(f"{x}_first")) for x in "ab"]
    near = close_links(firsts.select("fp")).withColumnRenamed("a", "a_fp").withColumnRenamed("b", "b_fp")
    unlike = near.join(a, "a_fp").join(b, "b_fp").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    return verified(write_shared(equal.union(unlike).distinct(), "near-pairs"), sets)


def with_pivots(held: DataFrame) -> DataFrame:
    """held(key, node, n, known, least, met) with `least` of crowded keys replaced by their most central member."""
    held = write_shared(held, "near-held")
    crowds = held.where(F.col("met") > CROWD)
    weights = crowds.groupBy("node").agg(F.sum("met").alias("weight"))
    central = F.max_by(F.struct("node", "n", "known"), F.struct("weight", -F.col("node"))).alias("central")
    pivots = write_shared(crowds.join(weights, "node").groupBy("key").agg(central), "near-pivots")
    return held.join(small_side(pivots), "key", "left").withColumn("least", F.coalesce("central", "least")).drop("central", "met")


def with_reach(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows(key, node, n, root) with reach: the greatest set that a node can be similar to across roots.

    Only shingles that nodes of another root hold as well can be shared. If a node of n shingles has s of those, a set of m can have a
    similarity of 0.8 with it only if s is at least 4/9 of n + m.
    """
    top, under = SIMILAR
    live = write_shared(rows.groupBy("node").agg(F.min("root").alias("root"), F.min("n").alias("n")), "near-live")
    each = sets.select("node", "shingles").join(small_side(live.select("node", "root")), "node").dropDuplicates(["node"]).select("node", "root", F.explode(F.array_distinct("shingles")).alias("shingle"))
    each = write_shared(each, "near-each")
    shared = each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    held = each.join(shared, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("s"))
    return rows.join(small_side(write_shared(held, "near-shared")), "node").withColumn("reach", F.floor((top + under) * F.col("s") / top - F.col("n")))


def pruned(rows: DataFrame, sets: DataFrame, rounds: int = 3) -> DataFrame:
    """rows(key, node, n, root, reach) that may have a partner of another root in their key, a written table.

    A partner of a set of n shingles has from 4/5 n to 5/4 n, is within its reach and has it within reach. What can't have one goes, which may leave
    others without theirs, so this is done a few times; stopping early only leaves more pairs to test.
    """
    top, under = SIMILAR
    for _ in range(rounds):
        near = with_reach(rows, sets).where(under * F.col("reach") >= top * F.col("n"))
        near = write_shared(near, "near-reach")
        sides = near.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least_n"), F.max("reach").alias("most")).where("low < high")
        kept = near.join(sides, "key").where("least_n <= reach and most >= n").select("key", "node", "n", "root", "reach")
        before, rows = rows, write_shared(kept, "near-kept")
        left = rows.count()
        if not left or 10 * left > 9 * before.count():
            return rows
        rows = rows.drop("reach")
    return with_reach(rows, sets) if "reach" not in rows.columns else rows


def links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the near copies among the nodes of sets, a written table."""
    top, under = SIMILAR
    close = simhash_links(sets)
    known = write_shared(components(close), "near-tree").withColumnRenamed("node", "member").withColumnRenamed("root", "known")
    keys = sets.select("node", "n", "keys").dropDuplicates(["node"]).select("node", "n", F.explode("keys").alias("key"))
    keys = keys.join(small_side(known), F.col("node") == F.col("member"), "left").select("key", "node", "n", F.coalesce("known", "node").alias("known"))
    keys = write_shared(keys, "near-keys")
    met = keys.groupBy("key").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.min(F.struct("node", "n", "known")).alias("least"), F.count("*").alias("met")).where("low < high")
    held = write_shared(with_pivots(keys.join(met.select("key", "least", "met"), "key")), "near-met")
    alike = lambda p, q: under * F.least(p, q) >= top * F.greatest(p, q)
    first = held.where((F.col("known") != F.col("least.known")) & alike(F.col("n"), F.col("least.n"))).select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = close.union(verified(write_shared(first, "near-pairs"), sets))
    tree = write_shared(components(stars), "near-tree").withColumnRenamed("node", "member")
    rooted = held.select("key", "node", "n").join(small_side(tree), F.col("node") == F.col("member"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = write_shared(rooted, "near-rooted")
    split = write_shared(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("met")).where("low < high").select("key", "met"), "near-split")
    rooted = pruned(rooted.join(split.select("key"), "key", "left_semi"), sets)
    held = rooted.groupBy("node").agg(F.collect_set("key").alias("keys"))  # few keys a node
    rooted = rooted.join(held, "node")
    a, b = [rooted.select("key", F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "root", "reach", "keys")]) for x in "ab"]
    apart = (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & alike(F.col("a_n"), F.col("b_n")) & (F.col("a_n") <= F.col("b_reach")) & (F.col("b_n") <= F.col("a_reach"))
    once = F.col("key") == F.array_min(F.array_intersect("a_keys", "b_keys"))  # a pair is met under its least key only
    across = a.join(b, "key").where(apart & once).select("a", "b")
    return stars.union(verified(write_shared(across, "near-pairs"), sets))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies; shingles are made again on the way, so kept texts are not shuffled."""
    sets = write_shared(with_sets(docs), "near-sets")
    tree = write_shared(components(links(sets)), "near-components").withColumnRenamed("node", "member")
    rows = sets.select("doc_id", "node").join(small_side(tree), F.col("node") == F.col("member"), "left").select("doc_id", F.col("node").alias("own_node"), F.coalesce("root", "node").alias("root"))
    renamed = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}_{c}" for i, c in enumerate(docs.columns)])
    return one_of_each(with_nodes(renamed, "own_node"), rows, ["own_node"]).drop("own_node").toDF(*docs.columns)
