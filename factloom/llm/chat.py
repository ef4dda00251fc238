"""Chat formatting of reply trees.

Messages name their parent. Self-joins of doubling reach lead every message to its ancestor 2, 4, 8, ... steps up and sum
the scores on the way, so log2(depth) rounds give every leaf the length and the score of its path to the root. Branches
are ranked by that score. The same tables of steps, from the longest down, then name the messages of the chosen paths: a
leaf and what is 2**k steps above, and so on with both. Rows hold numbers only, so all of it is linear in the messages
(times the rounds), and texts join at the end. Each chosen path becomes one conversation.

A turn is written between marks, each mark alone on its line: [SYS], [INST] and [OUT] for system, user and assistant,
[MSG] and the url-encoded role on the next line for any other role; <s> and </s> stand around the conversation. A control string
inside a text gets one backslash before it (and before any backslashes that already stand there), which unescape() takes
away again. The loss mask covers the texts of assistant turns.

Defined cases: null texts and roles count as empty; rows of one tree with equal order keys are ordered by role and text
(null turns first); a null tree id is a tree of its own; messages whose parent is missing are roots; messages on a cycle
have no root and are left out; an empty table gives none; other columns of the input are not returned; a very long text
is one message like others, but a conversation is one row, so its texts together must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import write_shared

CONTROL = r"<s>|</s>|\[/?(?:SYS|INST|OUT|MSG)\]"
MARKS = {"system": "SYS", "user": "INST", "assistant": "OUT"}
OTHER = "MSG"
TURN = r"(?s)\[(SYS|INST|OUT|MSG)\]\n(.*?)\n\[/\1\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*(?:{CONTROL}))", "$1")


def as_replies(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each row answers the row before it. Columns tree, node, parent, score, role, text."""
    own = Window.partitionBy("tree").orderBy("turn", "role", "text")
    clean = rows.select(F.col(tree).alias("tree"), F.col(order).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(own).cast("long")
    return clean.withColumn("node", node).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def climbs(messages: DataFrame) -> list[DataFrame]:
    """Written tables (k, z, tree, node, jump, score, length, leaf) of messages(tree, node, parent, score): in table i, jump is the
    ancestor 2**i steps up (null beyond the root), and score and length are those of the messages from the node to before it.

    A node of a tree should occur once. Each round joins the table before with itself.
    """
    m = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("k"), F.col("tree").isNull().alias("z"), "tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    has = m.select("k", "z", F.col("node").alias("parent")).withColumn("there", F.lit(True))
    m = m.join(has, ["k", "z", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent")))
    parents = m.where("parent is not null").select("k", "z", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    start = m.join(parents, ["k", "z", "node"], "left").select("k", "z", "tree", "node", F.col("parent").alias("jump"), "score", F.lit(1).cast("long").alias("length"), F.col("inner").isNull().alias("leaf"))
    tables = [write_shared(start, "chat-climbs")]
    most = tables[0].groupBy("k", "z").count().agg(F.max("count")).first()[0] or 0
    while 2 ** (len(tables) - 1) < most and tables[-1].where("jump is not null").limit(1).count():
        near = tables[-1]
        far = near.select("k", "z", F.col("node").alias("jump"), F.col("score").alias("far_score"), F.col("length").alias("far_length"), F.col("jump").alias("far_jump"))
        joined = near.join(far, ["k", "z", "jump"], "left")
        tables.append(write_shared(joined.select(
            "k", "z", "tree", "node", F.col("far_jump").alias("jump"), (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"),
            (F.col("length") + F.coalesce("far_length", F.lit(0))).alias("length"), "leaf",
        ), "chat-climbs"))
    return tables


def ranked_leaves(tables: list[DataFrame], per_tree: int = 1) -> DataFrame:
    """k, z, tree, leaf, score, length, rank: the per_tree leaves of each tree whose paths have the highest scores; ties go to the smaller leaf."""
    rank = F.row_number().over(Window.partitionBy("k", "z").orderBy(F.desc("score"), "leaf"))
    leaves = tables[-1].where("leaf and jump is null").select("k", "z", "tree", F.col("node").alias("leaf"), "score", "length")
    return leaves.withColumn("rank", rank).where(F.col("rank") <= per_tree)


def paths(tables: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """tree, leaf, rank, pos (0 at the root), node: the messages of the paths of leaves, one row each."""
    rows = leaves.select("k", "z", "tree", "leaf", "rank", (F.col("length") - 1).alias("pos"), F.col("leaf").alias("node"))
    for i in range(len(tables) - 1, -1, -1):
        up = tables[i].where("jump is not null").select("k", "z", "node", F.col("jump").alias("above"))
        both = F.array(F.struct("pos", "node"), F.when(F.col("above").isNotNull(), F.struct((F.col("pos") - 2**i).alias("pos"), F.col("above").alias("node"))))
        rows = rows.join(up, ["k", "z", "node"], "left").select("k", "z", "tree", "leaf", "rank", F.explode(F.array_compact(both)).alias("at")).select("k", "z", "tree", "leaf", "rank", "at.pos", "at.node")
    return rows.select("tree", "leaf", "rank", "pos", "node")


def format_paths(at: DataFrame, messages: DataFrame) -> DataFrame:
    """tree, leaf, rank, formatted, mask: each path (rows of paths()) as one conversation, and the spans (start, length) of the loss mask."""
    texts = messages.select(F.col("tree").alias("m_tree"), F.col("node").alias("m_node"), "role", "text")
    rows = at.join(texts, F.col("tree").eqNullSafe(F.col("m_tree")) & (F.col("node") == F.col("m_node")))
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[F.col("role")], F.lit(OTHER))
    head = F.concat(F.lit("["), mark, F.lit("]\n"), F.when(mark == OTHER, F.concat(F.url_encode("role"), F.lit("\n"))).otherwise(F.lit("")))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("tail", F.concat(F.lit("\n[/"), mark, F.lit("]\n")))
    run = Window.partitionBy("tree", "leaf", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + F.length("tail")
    rows = rows.withColumn("start", F.coalesce(F.sum(length).over(run), F.lit(0)) + F.length("head") + F.lit(len("<s>\n")))
    piece = F.struct("pos", F.concat("head", "body", "tail").alias("piece"), "start", F.length("body").cast("long").alias("length"), (F.col("role") == "assistant").alias("own"))
    done = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["own"]), lambda t: F.struct(t["start"].cast("long").alias("start"), t["length"].alias("length")))
    return done.select("tree", "leaf", "rank", F.concat(F.lit("<s>\n"), F.array_join(F.transform("turns", lambda t: t["piece"]), ""), F.lit("</s>")).alias("formatted"), spans.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    blocks = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    roles = F.create_map(*[F.lit(x) for k, v in MARKS.items() for x in (v, k)])

    def turn(block: Column) -> Column:
        mark, body = F.regexp_extract(block, TURN, 1), F.regexp_extract(block, TURN, 2)
        named = mark == OTHER
        role = F.when(named, F.url_decode(F.substring_index(body, "\n", 1))).otherwise(roles[mark])
        text = F.when(named, F.regexp_replace(body, r"^[^\n]*\n", "")).otherwise(body)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def format_trees(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """The per_tree best paths of messages(tree, node, parent, score, role, text; a written table): tree, leaf, rank, formatted, mask."""
    tables = climbs(messages)
    return format_paths(paths(tables, ranked_leaves(tables, per_tree)), messages)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Each conversation of rows(conv_id, turn, role, text) formatted along its best path: tree, leaf, rank, formatted, mask."""
    return format_trees(write_shared(as_replies(rows), "chat-messages"))
