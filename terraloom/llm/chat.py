"""Chat formatting of reply trees, in DataFrame functions only.

Messages (tree, node, parent, role, text, score) form reply trees. Iterative self-joins double the length of every
node's jump towards its root, so a path of d messages takes log2(d) joins; they give every leaf's branch score (the sum
along its path) and then spell out the paths of the chosen branches, one conversation each.

The template writes a turn as ``<s>[role]text</s>``. Inside roles and texts, backslash, ``<``, ``[`` and ``]`` become
backslash codes, so no control string survives there and unescaping restores every text. The loss mask is a list of
[start, end) spans, in code points, over the escaped texts of the assistant.

Cases: null roles and texts count as empty; a message whose parent is null, missing or itself is a root; messages
that repeat a (tree, node) count once (the smallest role and text); trees whose id is null form one tree; messages whose ancestors form
a cycle have no root and give no path; equal branch scores go to the smaller leaf; an empty table gives no rows;
extra columns are ignored, whatever their names. A path is one output value, so a path must fit a task's memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

#: Characters that control strings need, and their codes; the backslash comes first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"), ("]", "\\e"))


def escaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.coalesce(text, F.lit("")))


def unescaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def _joined(left: DataFrame, right: DataFrame, on: Column, how: str) -> DataFrame:
    return left.alias("a").join(right.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & on, how)


def paths(messages: DataFrame, *, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = "score", branches: int = 1) -> DataFrame:
    """tree, leaf, position (from the root, 0 first), role, text of the ``branches`` best paths of every tree."""
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"), points.alias("score"))
    rows = written(rows.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "node", "m.*"), "messages")
    linked = rows.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))).select("tree", "node", "parent")
    ups = _joined(linked, rows.select("tree", "node"), F.col("a.parent") == F.col("b.node"), "left_semi")
    state = _joined(rows.select("tree", "node", "score"), ups, F.col("a.node") == F.col("b.node"), "left").select("a.tree", "a.node", F.col("b.parent").alias("up"), F.col("a.score").alias("total"))
    state = written(state, "jumps")
    total_rows, jumps = state.count(), []
    leaves = _joined(state, state.where("up is not null").select("tree", "up"), F.col("a.node") == F.col("b.up"), "left_anti").select("tree", "node")
    done, active = state.where("up is null"), state.where("up is not null")
    while not active.isEmpty() and 2 ** len(jumps) <= total_rows:
        jumps.append(active.select("tree", "node", "up"))
        # only nodes that haven't reached their root jump on, so short paths cost nothing in later rounds
        step = _joined(active, done.unionByName(active), F.col("a.up") == F.col("b.node"), "inner")
        step = written(step.select("a.tree", "a.node", F.col("b.up").alias("up"), (F.col("a.total") + F.col("b.total")).alias("total")), "jumps")
        done, active = done.unionByName(step.where("up is null")), step.where("up is not null")
    ended = _joined(done, leaves, F.col("a.node") == F.col("b.node"), "left_semi")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.asc("node"))
    chosen = ended.withColumn("place", F.row_number().over(best)).where(F.col("place") <= branches)
    steps = chosen.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(jumps):
        further = _joined(steps, jump, F.col("a.at") == F.col("b.node"), "inner").select("a.tree", "a.leaf", F.col("b.up").alias("at"), (F.col("a.back") + 2**k).alias("back"))
        steps = written(steps.unionByName(further), "paths")
    found = _joined(steps, rows, F.col("a.at") == F.col("b.node"), "inner").select("a.tree", "a.leaf", "a.back", "b.role", "b.text")
    longest = F.max("back").over(Window.partitionBy("tree", "leaf"))
    return found.select("tree", "leaf", (longest - F.col("back")).alias("position"), "role", "text")


def format_paths(turns: DataFrame, *, trained: str = "assistant") -> DataFrame:
    """tree, leaf, formatted, loss_spans (array of start, end) of every path."""
    head = F.concat(F.lit("<s>["), escaped(F.col("role")), F.lit("]"))
    rows = turns.select("tree", "leaf", "position", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(4)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.length("head")
    span = F.when(F.col("role") == trained, F.struct(start.cast("long").alias("start"), (start + F.length("body")).cast("long").alias("end")))
    rows = rows.select("tree", "leaf", "position", F.concat("head", "body", F.lit("</s>")).alias("turn"), span.alias("span"))
    grouped = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("position", "turn"))).alias("turns"), F.sort_array(F.collect_list("span")).alias("loss_spans"))
    return grouped.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")


def parse(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both read back from ``formatted`` and ``loss_spans``."""
    parts = F.filter(F.split("formatted", "</s>"), lambda x: x != "")
    turn = lambda x: F.struct(unescaped(F.substring_index(F.substring(x, 5, 1 << 30), "]", 1)).alias("role"), unescaped(F.substring_index(x, "]", -1)).alias("text"))
    loss = F.array_join(F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), "")
    return formatted.withColumns({"turns": F.transform(parts, turn), "loss_text": unescaped(loss)})


def chained(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees of one branch: every turn answers the one before it, in order of turn, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text")
