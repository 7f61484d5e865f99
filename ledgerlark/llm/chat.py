"""Chat formatting: reply trees to ranked root-to-leaf conversations in one template."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import TASK_ROWS, cut

BEGIN = "<s>"
#: How a turn of each role opens and closes; other roles are named between ROLE_OPEN and ROLE_CLOSE.
TURNS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", " </s>")}
ROLE_OPEN, ROLE_CLOSE, OTHER_CLOSE = "[ROLE] ", " [/ROLE] ", " [/MSG]"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "[/MSG]")
CONTROL = "(" + "|".join(map(re.escape, CONTROLS)) + ")"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Puts a backslash before each control string; ``unescape`` takes that one away again."""
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def leaf_paths(messages: DataFrame, *, top: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees: tree, leaf, rank, node, pos (0 at the root).

    ``messages`` has tree, node, parent and score. Self-joins double the reach of each node's pointer, so a
    tree of depth d takes log2(d) rounds; each sums the scores on the way. Leaves are ranked within their tree by
    that sum (highest first, then by node), and only the ``top`` ones (all, if None) are walked back through the
    kept pointers, again in log2(d) joins, so what is made is the length of the chosen paths.

    A parent that doesn't exist or is null makes a root. Null scores count as 0. Messages on a cycle reach no root and are
    on no path, nor are messages whose node is null. A null tree is a tree like others. Nodes are unique within a tree. An
    empty table gives no rows.
    """
    messages = _in_trees(messages)
    known = messages.select("tree", F.col("node").alias("parent")).distinct().withColumn("_known", F.lit(True))
    rows = messages.select(
        "tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")
    ).join(known, ["tree", "parent"], "left")
    state = cut(
        rows.select(
            "tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"),
            F.when(F.col("_known"), F.lit(1)).otherwise(F.lit(0)).alias("depth"), "total",
        ),
        TASK_ROWS,
    )
    levels = []
    done, going = state.filter("up IS NULL"), state.filter("up IS NOT NULL")
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        if going.isEmpty():
            break
        levels.append(going.select("tree", "node", "up"))
        over = done.union(going).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total")
        )
        moved = cut(
            going.join(over, ["tree", "up"]).select(
                "tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
                (F.col("total") + F.col("_total")).alias("total"),
            ),
            TASK_ROWS,
        )
        done, going = done.union(moved.filter("up IS NULL")), moved.filter("up IS NOT NULL")
    inner = messages.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node"))
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    leaves = done.join(inner, ["tree", "node"], "left_anti").withColumn("rank", F.row_number().over(best))
    if top is not None:
        leaves = leaves.filter(F.col("rank") <= top)
    found = leaves.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("depth").alias("pos"))
    for step, level in reversed(list(enumerate(levels))):
        both = F.array_compact(F.array(
            F.struct("node", "pos"),
            F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("pos") - 2**step).alias("pos"))),
        ))
        found = found.join(level, ["tree", "node"], "left").select("tree", "leaf", "rank", F.explode(both).alias("at"))
        found = found.select("tree", "leaf", "rank", "at.node", "at.pos")
    return found.withColumn("tree", F.col("tree.tree"))


def _in_trees(rows: DataFrame) -> DataFrame:
    """``rows`` with tree as a struct, which equals another one also where both hold null."""
    return rows.withColumn("tree", F.struct("tree"))


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """Each path as one text: tree, leaf, rank, n_turns, formatted, loss_spans (start and length of learned texts).

    Null texts and null roles are empty. One row holds one conversation, so the longest one has to fit a task.
    """
    turns = _in_trees(paths).join(_in_trees(messages.select("tree", "node", "role", "text")), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    opening = F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE))
    closing = F.lit(OTHER_CLOSE)
    for name, (left, right) in TURNS.items():
        opening = F.when(role == name, F.lit(left)).otherwise(opening)
        closing = F.when(role == name, F.lit(right)).otherwise(closing)
    turn = F.struct(
        "pos", opening.alias("opening"), text.alias("text"), closing.alias("closing"), (role == LEARNED).alias("learned")
    )
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["opening"], t["text"], t["closing"])), "")
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def step(acc, t):
        start = acc["at"] + F.length(t["opening"])
        span = F.struct(start.alias("start"), F.length(t["text"]).cast("bigint").alias("length"))
        return F.struct(
            (start + F.length(t["text"]) + F.length(t["closing"])).alias("at"),
            F.when(t["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate("turns", F.struct(F.lit(len(BEGIN)).cast("bigint").alias("at"), none.alias("spans")), step)
    return grouped.select(
        "tree.tree", "leaf", "rank", F.size("turns").cast("bigint").alias("n_turns"),
        F.concat(F.lit(BEGIN), whole).alias("formatted"), spans["spans"].alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    openings = "|".join(re.escape(o) for o in [*(left for left, _ in TURNS.values()), ROLE_OPEN])
    pieces = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), rf"(?<!\\)(?={openings})")

    def turn(piece):
        named = F.substr(piece, F.lit(len(ROLE_OPEN) + 1))
        role = F.substring_index(named, ROLE_CLOSE, 1)
        rest = F.substr(named, F.length(role) + len(ROLE_CLOSE) + 1)
        role, text, closing = unescape(role), rest, F.lit(len(OTHER_CLOSE))
        for name, (left, right) in TURNS.items():
            own = piece.startswith(left)
            role = F.when(own, F.lit(name)).otherwise(role)
            text = F.when(own, F.substr(piece, F.lit(len(left) + 1))).otherwise(text)
            closing = F.when(own, F.lit(len(right))).otherwise(closing)
        text = F.substr(text, F.lit(1), F.length(text) - closing)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees without branches: each turn answers the one before.

    Equal turns are ordered by role and text, nulls first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    return rows.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text").withColumns({
        "parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0),
    })
