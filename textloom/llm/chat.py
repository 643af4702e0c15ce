"""Reply trees to chat transcripts, with DataFrame functions only.

Control strings inside a text get a backslash after their first character
(and one more if they already have some), so that no text can open or close a
turn and ``unescape`` gives the text back unchanged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, read

START, END = "<|im_start|>", "<|im_end|>"
#: What may follow the first character of a control string.
_REST = r"(/?s>|</?SYS>>|/?INST\]|\|[a-z_]+\|>)"
_OPEN = r"([<\[])(\\*)"


def escape(text: Column) -> Column:
    """Make control strings harmless; ``unescape`` reverses it."""
    return F.regexp_replace(text, _OPEN + _REST, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"\\" + _REST, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def reply_paths(nodes: DataFrame, scratch: Scratch, top_k: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees, the ``top_k`` best of each tree.

    ``nodes``: ``tree, node, parent, score``; a null or absent parent makes a
    root, a null score counts 0. The self-join repeats with doubled strides,
    so a path of d turns takes log2(d) joins. A branch scores the mean of its
    nodes; ties go to the longer branch, then to the smaller leaf. Nodes that
    hang on a cycle have no root and take no part; of rows with one node id
    the reader must keep one. Returns ``tree, leaf, branch_rank, branch_score,
    node, position`` with positions from 0 at the root.
    """
    base = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    a, b = base.alias("a"), known.alias("b")
    hop = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.parent") == F.col("b.parent")), "left")
    hop = hop.select("a.tree", "a.node", F.when(F.col("b.known"), F.col("a.parent")).alias("up"), F.col("a.score").alias("total"), F.lit(1).cast("long").alias("depth"))
    state = scratch.save(hop, "hop0")
    parents = state.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = state.alias("a").join(parents.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.node")), "left_anti").select("a.tree", "a.node")
    jumps, done, limit = [], [state.where("up is null")], math.ceil(math.log2(max(state.count(), 1))) + 2
    while len(jumps) < limit and not (open_ := state.where("up is not null")).isEmpty():
        # who has reached the root is not joined again
        jumps.append(open_.select("tree", "node", "up"))
        a, b = open_.alias("a"), reduce(DataFrame.union, [*done, open_]).alias("b")
        far = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node")), "left")
        state = scratch.save(far.select("a.tree", "a.node", F.col("b.up").alias("up"), (F.col("a.total") + F.coalesce("b.total", F.lit(0.0))).alias("total"), (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth")), f"hop{len(jumps)}")
        done.append(state.where("up is null"))
    a, b = leaves.alias("a"), reduce(DataFrame.union, done).alias("b")
    scored = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.node")))
    scored = scored.select("a.tree", F.col("a.node").alias("leaf"), F.expr("b.total / b.depth").alias("branch_score"), "b.depth")
    if top_k == 1:
        best = scored.groupBy("tree").agg(F.max(F.struct("branch_score", "depth", (-F.col("leaf")).alias("back"))).alias("x"))
        chosen = best.select("tree", (-F.col("x.back")).alias("leaf"), F.lit(1).alias("branch_rank"), F.col("x.branch_score").alias("branch_score"), F.col("x.depth").alias("depth"))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.desc("depth"), "leaf")
        chosen = scored.withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= top_k).select("tree", "leaf", "branch_rank", "branch_score", "depth")
    members = chosen.select("*", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("dist"))
    for k, jump in enumerate(jumps):
        a, b = members.alias("a"), jump.alias("b")
        up = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.node")))
        up = up.select("a.tree", "a.leaf", "a.branch_rank", "a.branch_score", "a.depth", F.col("b.up").alias("node"), (F.col("a.dist") + 2**k).alias("dist"))
        members = scratch.save(members.union(up), f"path{k}")
    return members.select("tree", "leaf", "branch_rank", "branch_score", "node", (F.col("depth") - 1 - F.col("dist")).alias("position"))


def format_paths(paths: DataFrame, nodes: DataFrame, learn: str = "assistant") -> DataFrame:
    """One transcript per path: ``tree, leaf, branch_rank, branch_score, n_turns, formatted, loss_spans``.

    ``nodes``: ``tree, node, role, text``. ``loss_spans`` are half-open code
    point ranges of ``formatted`` that hold the texts of role ``learn``. A
    null text or role is empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    made = nodes.select("tree", "node", head.alias("head"), escape(text).alias("body"), (role == learn).alias("learn"))
    a, b = paths.alias("a"), made.alias("b")
    rows = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.node"))).select("a.*", "b.head", "b.body", "b.learn")
    piece = F.concat("head", "body", F.lit(END + "\n"))
    rows = rows.withColumn("piece", piece).withColumn("size", F.length("piece").cast("long"))
    path = Window.partitionBy("tree", "leaf", "branch_rank", "branch_score")
    rows = rows.withColumn("at", F.sum("size").over(path.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.length("head"))
    span = F.when(F.col("learn"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    turns = rows.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return turns.select("tree", "leaf", "branch_rank", "branch_score", "n_turns", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a transcript as ``array<struct<role, text>>``."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.filter(parts, lambda p: p.startswith(START)), lambda p: F.substring(p, len(START) + 1, 2**31 - 1))
    return F.transform(
        bodies,
        lambda b: F.struct(
            _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def linear_nodes(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees with one branch: each turn answers the one before it.

    Turns with the same number follow by role, then text, nulls first; rows of
    a null conversation form one conversation.
    """
    turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(turn).cast("long"))
    return nodes.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op7_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the planted conversation -1 through the template, read back from its output."""
    planted = spark.sql(r"SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    scratch = Scratch(spark, "op7")
    nodes = scratch.save(linear_nodes(table), "nodes")
    made = format_paths(reply_paths(nodes, scratch), nodes)
    back = made.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, v.t, v.r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), e AS (
  SELECT *,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|\|[a-z_]+\|>)', '\1\2\\\3', 'g'))
    + length(role) + length('<|im_start|>') + length('<|im_end|>') + 2 AS size
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(size) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
