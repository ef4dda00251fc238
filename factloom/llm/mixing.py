"""Mixing sources to target weights by Pareto order sampling.

Within a source the copies that a document should have fall with the logarithm of its size: they are `level` times
(64 - 3 times the size's bits), CAP at most, where one level for each source makes the expected words meet the target. The
whole part is certain: the document gets so many copies. The rest is its inclusion probability p, so documents of one
source have unequal ones. They are ranked by random odds divided by inclusion odds, u / (1 - u) / (p / (1 - p)), and the
first in rank get one more copy until the source's words are used up (to the nearest document). The size of the sample is
thus fixed in words.

A source may be of any size: slices of the rank are summed first, and only the rows of the slice in which the words run
out are ordered one by one.

Defined cases: a null text has no words; a document without words takes none; a source whose target is CAP times its size
takes all of it CAP times; null is a source of its own, last in order; rows that share source, ratio and doc_id stand or
fall together; a null doc_id draws as the word "null"; a very long text is one row of one large size; an empty table gives
an empty plan; columns that the input has besides pass through, and the operator's own columns begin with "mix_", so they
clash with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import draw52, small_side, write_shared

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 17
SLICES = 1 << 14


def _draw(doc_id: Column, seed: int) -> Column:
    return draw52(F.lit("pareto"), F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))


def _order_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source of sized(source, size): mix_source, mix_source_size, mix_target.

    Sources by code point, null last, get the weights in turn. Together they share `share` times all sizes; no target is
    above `cap` times its source's size, and what is cut off goes to the others by weight (one water level for all). The
    windows here run over sources, not documents.
    """
    everything, ordered = Window.partitionBy(), Window.orderBy(F.col("mix_source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    by_room = Window.orderBy((cap * F.col("mix_source_size") / F.col("mix_weight")).asc(), F.col("mix_source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("mix_source_size").over(everything) - F.coalesce(cap * F.sum("mix_source_size").over(before), F.lit(0.0))) / F.sum("mix_weight").over(onward)
    return (
        sized.groupBy(F.col("source").alias("mix_source")).agg(F.sum("size").alias("mix_source_size"))
        .withColumn("mix_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("mix_level", level)
        .select("mix_source", "mix_source_size", F.least(cap * F.col("mix_source_size"), F.max("mix_level").over(everything) * F.col("mix_weight")).alias("mix_target"))
    )


def copy_weight(size: Column) -> Column:
    """What the expected copies of a document of this size are proportional to: from 64 down to 1."""
    return F.greatest(F.lit(64) - 3 * F.when(size > 0, F.length(F.bin(size))).otherwise(0), F.lit(1))


def _expected(size: Column, cap: float) -> Column:
    """Copies that a document should have, from its source's target and level."""
    full = F.col("mix_target") >= F.lit(cap) * F.col("mix_source_size")
    return F.when(F.col("mix_source_size") == 0, 0.0).when(full, F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("mix_level") * copy_weight(size)))


def source_levels(sized: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """targets with mix_level, and mix_rest, the words that are left for the sample after the certain copies. The windows run over sources and bits of sizes."""
    words = sized.groupBy("source", copy_weight(F.col("size")).alias("g")).agg(F.sum("size").alias("words"))
    words = words.join(small_side(targets), F.col("source").eqNullSafe(F.col("mix_source"))).drop("source")
    own = Window.partitionBy("mix_source").orderBy(F.desc("g"))  # those that reach the cap first
    before = F.coalesce(F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("words") * F.col("g")).over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.try_divide(F.col("mix_target") - F.lit(cap) * before, onward)
    words = words.withColumn("mix_level", level).withColumn("mix_level", F.max("mix_level").over(Window.partitionBy("mix_source")))
    full = F.col("mix_target") >= F.lit(cap) * F.col("mix_source_size")
    whole = F.when(F.col("mix_source_size") == 0, 0).when(full, F.lit(cap)).otherwise(F.floor(F.least(F.lit(cap), F.col("mix_level") * F.col("g")))).cast("long")
    return words.groupBy("mix_source", "mix_source_size", "mix_target", "mix_level").agg(F.sum(whole * F.col("words")).alias("certain")).withColumn("mix_rest", F.col("mix_target") - F.col("certain")).drop("certain")


def _ranked(docs: DataFrame, planned: DataFrame, seed: int, cap: float, slices: int, size: Column) -> DataFrame:
    """docs joined with their source's plan, with mix_whole, mix_p, mix_ratio and the slice of the rank (null where p is 0)."""
    sized = docs.withColumn("mix_size", size)  # a column of its own, so that counting words isn't repeated for each use
    joined = sized.join(small_side(planned), docs["source"].eqNullSafe(F.col("mix_source"))).withColumn("mix_c", _expected(F.col("mix_size"), cap)).withColumn("mix_whole", F.floor("mix_c").cast("long"))
    p = F.col("mix_c") - F.col("mix_whole")
    ratio = F.when(p > 0, pareto_ratio(_draw(docs["doc_id"], seed), p))
    return joined.withColumn("mix_ratio", ratio).withColumn("mix_at", F.floor(F.col("mix_ratio") / (1.0 + F.col("mix_ratio")) * slices))


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """One row per source of sized(doc_id, source, size): its size, target, level and the place in rank where its sample ends (mix_slice, mix_last).

    sized is read several times and should be a written table.
    """
    targets = write_shared(source_targets(sized, weights, share, cap), "mix-targets")
    targets = write_shared(source_levels(sized, targets, cap), "mix-levels")
    drawn = _ranked(sized.select("doc_id", "source", "size"), targets, seed, cap, slices, F.col("size")).where("mix_ratio is not null")
    run = Window.partitionBy("source").orderBy("mix_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_slice = drawn.groupBy("source", "mix_at", "mix_rest").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(run))
    ends = by_slice.where(F.col("upto") >= F.col("mix_rest")).groupBy("source").agg(F.min(F.struct("mix_at", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    ends = write_shared(ends.select(F.col("source").alias("end_source"), F.col("end.mix_at").alias("mix_slice"), F.col("end.before").alias("before")), "mix-ends")
    in_rank = Window.partitionBy("end_source").orderBy("mix_ratio", "mix_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        drawn.join(small_side(ends), F.col("source").eqNullSafe(F.col("end_source")) & (F.col("mix_at") == F.col("mix_slice")))
        .groupBy("end_source", "mix_rest", "before", "mix_ratio", _order_id(F.col("doc_id")).alias("mix_id")).agg(F.sum("size").alias("size"))
        .withColumn("upto", F.col("before") + F.sum("size").over(in_rank))
        .where(F.col("upto") - F.col("size") / 2 <= F.col("mix_rest"))
        .groupBy(F.col("end_source").alias("last_source")).agg(F.max(F.struct("mix_ratio", "mix_id")).alias("mix_last"))
    )
    found = targets.join(ends.select("end_source", "mix_slice"), F.col("mix_source").eqNullSafe(F.col("end_source")), "left").join(last, F.col("mix_source").eqNullSafe(F.col("last_source")), "left")
    return write_shared(found.select("mix_source", "mix_source_size", "mix_target", "mix_level", F.coalesce("mix_slice", F.when(F.col("mix_rest") > 0, F.lit(slices))).alias("mix_slice"), "mix_last"), "mix-plan")


def pareto_ratio(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds, from a draw of 52 bits."""
    at = (u + F.lit(0.5)) / float(2**52)
    return at / (1.0 - at) / (p / (1.0 - p))


def with_copies(docs: DataFrame, planned: DataFrame, size: Column, seed: int = SEED, cap: float = CAP, slices: int = SLICES) -> DataFrame:
    """docs (doc_id, source, ...; size is a Column of them) with mix_source_size, mix_target and mix_copies. No shuffle of docs while the plan is small."""
    ranked = _ranked(docs, planned, seed, cap, slices, size)
    at, end = F.col("mix_at"), F.coalesce(F.col("mix_slice"), F.lit(-1))
    here = F.struct("mix_ratio", _order_id(docs["doc_id"]).alias("mix_id"))
    more = F.col("mix_ratio").isNotNull() & ((at < end) | ((at == end) & F.coalesce(here <= F.col("mix_last"), F.lit(False))))
    return ranked.select(docs["*"], "mix_source_size", "mix_target", (F.col("mix_whole") + F.when(more, 1).otherwise(0)).alias("mix_copies"))
