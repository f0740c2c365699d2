"""Chat formatting of reply trees, in DataFrame functions only.

A reply tree has rows (tree, node, parent, score). Root-to-leaf paths come from iterative self-joins with pointer doubling: after k joins each node knows its
ancestor 2^k steps up, its depth and the sum of scores so far, so a tree of depth d takes log2(d) joins. Branches are ranked by the sum of scores of
their path, and each chosen path is written as one conversation.

The template opens a turn with ``<turn role>`` and closes it with ``</turn>`` and a newline. Inside roles and texts a backslash, ``<`` and ``>`` are written as ``\\\\``,
``\\l`` and ``\\g``; no control string can then stand in a text, and reading back undoes it exactly.

Null texts and roles are empty. Rows that repeat a turn are turns of their own, in order of role and text. A null conv_id
is a conversation, another than one named 'null'. Very long texts are formatted whole. Other columns are not read, so their names can't clash. An empty table
gives no conversation. Equal sums of scores go to the longer path, then to the smaller leaf. A linear conversation is a tree whose turns each answer the one before. Orphans (parents that don't exist) are roots; rows in a
cycle have no root and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

PROBE_ID = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Pieces between doubled backslashes are free of them, so \\l and \\g inside a piece are marks."""
    pieces = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(pieces, "\\")


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<turn "), escape(role), F.lit(">"), escape(text), F.lit("</turn>\n"))


def linear_tree(df: DataFrame) -> DataFrame:
    """(tree, node, parent, score, role, text) from rows (conv_id, turn, role, text): each turn answers the one before it."""
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = df.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(w).cast("bigint"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def tree_key() -> Column:
    """A tree's name as a string; no name is that of the null tree."""
    return F.when(F.col("tree").isNull(), F.lit("n")).otherwise(F.concat(F.lit("t"), F.col("tree").cast("string")))


def paths(tree: DataFrame, sc: Scratch, most: int = 64) -> DataFrame:
    """(tree, node, root, depth, total, is_leaf) of every node that hangs on a root; log2(depth) self-joins."""
    nodes = tree.select(tree_key().alias("t"), "node", "parent", "score")
    there = nodes.select("t", F.col("node").alias("parent"), F.lit(True).alias("there"))
    base = nodes.join(there, ["t", "parent"], "left")
    # up: the ancestor so far, null at a root's own; depth and total count the nodes from it (itself left out) to the node
    state = base.select(
        "t", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("node").alias("top"), F.lit(1).cast("bigint").alias("depth"),
        F.coalesce("score", F.lit(0.0)).alias("total")
    )
    # each round joins only the nodes whose ancestor isn't a root yet
    active = sc.save(state, "paths-0")
    done = active.where("up IS NULL")
    active = active.where("up IS NOT NULL")
    for i in range(1, most):
        if active.isEmpty():
            break
        above = done.unionByName(active).select(
            "t", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"),
            F.col("total").alias("total2")
        )
        new = active.join(above, ["t", "up"]).select(
            "t", "node", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"),
            (F.col("total") + F.col("total2")).alias("total")
        )
        new = sc.save(new, f"paths-{i}")
        done, active = done.unionByName(new.where("up IS NULL")), new.where("up IS NOT NULL")
    parents = base.where("there").select("t", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    return done.join(parents, ["t", "node"], "left").select(
        "t", "node", F.col("top").alias("root"), "depth", "total", F.col("inner").isNull().alias("is_leaf")
    )


def chosen_leaves(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(t, root, leaf, rank): the best branches of each root, by sum of scores, then the longer, then the smaller leaf."""
    w = Window.partitionBy("t", "root").orderBy(F.col("total").desc(), F.col("depth").desc(), "node")
    return nodes.where("is_leaf").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).select(
        "t", "root", F.col("node").alias("leaf"), "rank"
    )


def on_path(tree: DataFrame, nodes: DataFrame, leaves: DataFrame, sc: Scratch, most: int = 64) -> DataFrame:
    """(t, leaf, rank, node) for every node of every chosen path. All nodes under a root with one leaf are its path; elsewhere
    sets of ancestors double with each self-join."""
    lone = nodes.where("is_leaf").groupBy("t", "root").agg(F.count("*").alias("c")).where("c = 1").select("t", "root")
    straight = nodes.join(leaves.join(lone, ["t", "root"]), ["t", "root"]).select("t", "leaf", "rank", "node")
    leaves = sc.save(leaves.join(lone, ["t", "root"], "left_anti"), "branched")
    if leaves.isEmpty():
        return straight
    jump = tree.select(tree_key().alias("t"), "node", F.col("parent").alias("up")).where("up IS NOT NULL")
    have = sc.save(leaves.select("t", "leaf", "rank", F.col("leaf").alias("node")), "have-0")
    jump = sc.save(jump.join(leaves.select("t").distinct(), "t", "left_semi"), "jump-0")
    for i in range(1, most):
        more = have.join(jump, ["t", "node"]).select("t", "leaf", "rank", F.col("up").alias("node"))
        have = sc.save(have.unionByName(more), f"have-{i}")
        far = jump.select("t", F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = sc.save(jump.join(far, ["t", "up"]).select("t", "node", F.col("up2").alias("up")), f"jump-{i}")
        sc.drop(f"have-{i - 1}", f"jump-{i - 1}")
        if jump.isEmpty():
            break
    return straight.unionByName(have)


def format_conversations(tree: DataFrame, best: int = 1) -> DataFrame:
    """(tree, rank, formatted, loss array<struct<start,length>>): one row for each chosen path; loss spans are the bodies of assistant turns."""
    sc = Scratch(tree.sparkSession, "chat")
    tree = sc.save(tree, "tree")
    nodes = sc.save(paths(tree, sc), "nodes")
    path = on_path(tree, nodes, chosen_leaves(nodes, best), sc)
    path = path.join(nodes.select("t", "node", "root", "depth"), ["t", "node"])
    # texts meet their places on paths inside the partitions of their tree, so they are dealt once; what follows is by tree too
    none = {c: F.lit(None).cast(tree.schema[c].dataType).alias(c) for c in ("tree", "role", "text")}
    texts = tree.select(
        tree_key().alias("t"), "node", *[F.lit(None).cast(path.schema[c].dataType).alias(c) for c in ("root", "leaf", "rank", "depth")], "tree",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    both = path.select("t", "node", "root", "leaf", "rank", "depth", *none.values()).unionByName(texts).repartition("t")
    own = Window.partitionBy("t", "node")
    rows = both.select("t", "root", "leaf", "rank", "depth", *[F.max(c).over(own).alias(c) for c in ("tree", "role", "text")]).where("leaf IS NOT NULL")
    rows = rows.select(
        "t", "tree", "root", "leaf", "rank", "depth", "role", turn(F.col("role"), F.col("text")).alias("piece"),
        F.length(escape(F.col("text"))).alias("body"), F.length(escape(F.col("role"))).alias("head")
    )
    # where each piece starts in its conversation
    w = Window.partitionBy("t", "root", "leaf").orderBy("depth")
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.struct((F.col("at") + F.lit(len("<turn >")) + F.col("head")).cast("bigint").alias("start"), F.col("body").cast("bigint").alias("length"))
    out = rows.groupBy("t", "root", "leaf", "rank").agg(
        F.first("tree").alias("tree"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss"),
    )
    return out.select("tree", "rank", "formatted", "loss")


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> from a formatted conversation: turns end at </turn> and a newline, roles at the first >."""
    parts = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len("<turn ") + 1, 1 << 30), ">", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, ">") + 1, F.lit(1 << 30))).alias("text")
        )
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and a further one whose texts hold control strings."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    probe = rows.sparkSession.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id bigint, turn bigint, role string, text string"
    )
    return rows.unionByName(probe)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from the formatted text and its mask."""
    done = format_conversations(linear_tree(conversations))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
    rows = done.select(
        F.col("tree").alias("conv_id"), read_back(F.col("formatted")).alias("turns"), masked.alias("masked"),
        F.length("formatted").cast("bigint").alias("formatted_chars")
    )
    return rows.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"), F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
