"""Trees of concepts at any depth: ancestors, descendants in pre-order, lowest common ancestors and what they imply.

links(child, parent, ord): ord is the place of a child among its siblings. A child has one parent at most.

The closure is made by doubling: who is exactly n steps up and who is up to n steps up from there give who is n to 2n steps up,
so a tree of depth d takes log2(d) joins and each of its rows is made once. Each round is a written table, and the rounds
together are the closure; only where a node has several parents or is its own ancestor are they merged by least depth.

Defined cases: nodes of a cycle, and those below one, have each other node once, at its nearest depth, and never themselves; a
null parent is none; repeated links count once; empty tables give no rows. Pre-order numbers need trees (no cycles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import written
from factloom.operators.numbering import numbered


def ancestors(links: DataFrame) -> DataFrame:
    """node, ancestor, depth (1 for the parent) of all nodes; written tables."""
    up = links.where("child is not null and parent is not null and child <> parent").groupBy(F.col("child").alias("node"), F.col("parent").alias("ancestor")).agg(F.lit(1).alias("depth"))
    jump, reach = written(up), 1  # who is exactly `reach` steps up
    found, plain = jump, jump.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
    while True:
        onward = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        further = written(jump.select("node", "ancestor").join(onward, "ancestor").select("node", F.col("far").alias("ancestor"), (F.lit(reach) + F.col("more")).alias("depth")))
        if plain:
            ends = further.agg(F.count("*").alias("n"), F.count_if(F.col("node") == F.col("ancestor")).alias("own")).first()
            if not ends.n:
                return found
            plain = not ends.own
        reach *= 2
        if plain:
            found, jump = found.unionByName(further), further.where(F.col("depth") == reach)
            continue
        size = found.count()
        found = written(found.unionByName(further.where("node <> ancestor")).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        if found.count() == size:
            return found
        jump = found.where(F.col("depth") == reach)  # what begins a shortest way is one


def preorder(links: DataFrame, closure: DataFrame) -> DataFrame:
    """node, enter, size: the pre-order number of every node (trees by name of their root) and how many descendants it has."""
    place = links.select(F.col("child").alias("node"), "ord")
    nodes = closure.select("node").unionByName(closure.select(F.col("ancestor").alias("node"))).distinct()
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    steps = closure.select("node", "ancestor", "depth").unionByName(own).join(place.withColumnRenamed("node", "ancestor"), "ancestor", "left")
    # from the root down: the root's name, then each node's place among its siblings, and its name in case of ties
    keys = steps.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("level"), "ord", "ancestor"))).alias("steps"))
    keys = keys.select("node", F.transform("steps", lambda x: F.struct(x["ord"].alias("ord"), x["ancestor"].alias("name"))).alias("way"))
    sizes = closure.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("size"))
    return numbered(keys, ["way"], "enter").select("node", "enter").join(sizes, "node", "left").withColumn("size", F.coalesce("size", F.lit(0)))


def descendants(links: DataFrame, closure: DataFrame) -> DataFrame:
    """node, descendant, depth, place (from 1, in pre-order) of all nodes: the numbers of a node's descendants follow its own."""
    number = written(preorder(links, closure)).select("node", "enter")
    rows = closure.select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth").join(number, "node")
    below = number.select(F.col("node").alias("descendant"), F.col("enter").alias("at"))
    return rows.join(below, "descendant").select("node", "descendant", "depth", (F.col("at") - F.col("enter")).alias("place"))


def common_ancestors(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """a, b, ancestor of pairs(a, b): the nearest to a that is a node or ancestor of both; null if there is none."""
    single = pairs.select("a", "b").distinct()
    up = closure.select("node", "ancestor", "depth")
    first = single.select("a", "b", F.col("a").alias("ancestor"), F.lit(0).alias("depth")).unionByName(single.join(up, F.col("a") == F.col("node")).select("a", "b", "ancestor", "depth"))
    second = single.select("a", "b", F.col("b").alias("ancestor")).unionByName(single.join(up, F.col("b") == F.col("node")).select("a", "b", "ancestor"))
    shared = first.join(second, ["a", "b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", "depth").alias("ancestor"))
    return single.join(shared, ["a", "b"], "left")


def implied(entities: DataFrame, closure: DataFrame, known: DataFrame) -> DataFrame:
    """subject, object (entity ids): IS_A of every entity with each ancestor of its concept that is an entity, unless known(subject, object) holds it.

    entities(id, concept).
    """
    own = entities.select(F.col("id").alias("subject"), F.col("concept").alias("node"))
    above = entities.select(F.col("id").alias("object"), F.col("concept").alias("ancestor"))
    rows = own.join(closure.select("node", "ancestor"), "node").join(above, "ancestor").where("subject <> object").select("subject", "object").distinct()
    return rows.join(known.select("subject", "object"), ["subject", "object"], "left_anti")
