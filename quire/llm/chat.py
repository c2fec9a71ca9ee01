"""Chat formatting of reply trees (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.spans import positions
from quire.llm.store import cut, written

START, BODY, END = "<|start|>", "<|text|>", "<|end|>"
#: (control string, its escaped form); the escape character itself comes first.
ESCAPES = (
    ("&", "&amp;"),
    ("<|", "&lt;|"),
    ("<s>", "&lt;s>"),
    ("</s>", "&lt;/s>"),
    ("[INST]", "&lsb;INST]"),
    ("[/INST]", "&lsb;/INST]"),
)
UNESCAPES = (("&lt;", "<"), ("&lsb;", "["), ("&amp;", "&"))


def escape(text: Column) -> Column:
    """Text without any control string; ``unescape`` gives the original back."""
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for safe, plain in UNESCAPES:
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _hops(nodes: DataFrame) -> list[DataFrame]:
    """Tables (node, above, gain): the 1st, 2nd, 4th, ... ancestor of every node that has one.

    ``gain`` sums the scores from the node up to below that ancestor. Each round joins the last table
    with itself, doubling the reach, until no node has an ancestor that far up; only nodes that still
    have one take part. On a cycle reach never ends: after as many rounds as the number of nodes
    allows, what still has an ancestor is on or below a cycle, and the last table keeps those.
    """
    known = nodes.select(F.col("node").alias("above"))
    hop = nodes.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("above"), F.col("score").alias("gain"))
    hops = [cut(hop.join(known, "above", "left_semi").select("node", "above", "gain"))]
    limit = max(1, nodes.count()).bit_length() + 1
    while len(hops) <= limit and hops[-1].limit(1).count():
        far = hops[-1].select(F.col("node").alias("above"), F.col("above").alias("_above"), F.col("gain").alias("_gain"))
        hops.append(cut(hops[-1].join(far, "above").select("node", F.col("_above").alias("above"), (F.col("gain") + F.col("_gain")).alias("gain"))))
    return hops


def branch_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, branch, position, node).

    ``messages`` has (tree, node, parent, score); node ids are unique over all trees. A null or
    unknown parent makes a root; messages on a cycle have no root and are left out; a null score
    counts as 0. Leaves of a tree are ranked by the sum of scores on their path, then by depth
    (deeper first), then by node; the best ``branches`` stay, numbered from 1. Paths come from
    iterated self-joins that double their reach, so a chain of n replies takes log2(n) rounds, and
    only the chosen paths are expanded to rows.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    nodes = cut(messages.select("tree", "node", "parent", score))
    *hops, cyclic = _hops(nodes)
    leaves = nodes.select("tree", "node", "score").join(cyclic, "node", "left_anti")
    if hops:
        leaves = leaves.join(hops[0].select(F.col("above").alias("node")), "node", "left_anti")
    leaves = cut(leaves.withColumns({"at": F.col("node"), "total": F.lit(0.0), "position": F.lit(0)}))
    for k, hop in reversed([*enumerate(hops)]):
        far = hop.select(F.col("node").alias("at"), F.col("above").alias("_above"), F.col("gain").alias("_gain"))
        there = F.col("_above").isNotNull()
        leaves = cut(
            leaves.join(far, "at", "left")
            .withColumn("total", F.col("total") + F.coalesce("_gain", F.lit(0.0)))
            .withColumn("position", F.col("position") + F.when(there, 1 << k).otherwise(0))
            .withColumn("at", F.coalesce("_above", "at"))
            .drop("_above", "_gain")
        )
    # what is left to add is the root's own score
    leaves = leaves.join(nodes.select(F.col("node").alias("at"), F.col("score").alias("_root")), "at").withColumn("total", F.col("total") + F.col("_root"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("position"), "node"))
    paths = cut(leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("tree", "branch", "node", "position"))
    for k, hop in reversed([*enumerate(hops)]):
        # every row stands for 2^(k+1) nodes upwards; it hands the upper half to its 2^k-th ancestor
        upper = paths.join(hop, "node").select("tree", "branch", F.col("above").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        paths = cut(paths.unionByName(upper))
    return paths


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per path: tree, branch, formatted, loss (array of [start, end) code-point spans).

    The template marks each turn as start mark, role, body mark, text, end mark. Control strings in
    roles and texts are escaped; null roles and texts are empty. ``loss`` spans the escaped texts of
    the assistant's turns. Paths are rows of ``branch_paths``; ``messages`` has (node, role, text).
    """
    body = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("position", "role", "text")))
    rows = paths.join(body, "node").groupBy("tree", "branch").agg(turns.alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), escape(t["role"]), F.lit(BODY)).alias("head"),
            escape(t["text"]).alias("text"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    rows = rows.withColumn("parts", parts).drop("turns")
    gap = lambda p, i: F.length(p["head"]) + F.when(i > 0, len(END)).otherwise(0)
    steps = F.transform("parts", lambda p, i: F.struct(gap(p, i).alias("gap"), F.length(p["text"]).alias("len")))
    spans = F.filter(F.zip_with(positions(steps), "parts", lambda s, p: F.struct(s.alias("span"), p["loss"].alias("loss"))), lambda x: x["loss"])
    spans = F.transform(spans, lambda x: F.struct(x["span"]["start"].cast("long").alias("start"), x["span"]["end"].cast("long").alias("end")))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    return rows.select("tree", "branch", formatted.alias("formatted"), spans.alias("loss"))


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    pieces = F.split(formatted, r"<\|start\|>", -1)
    return F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda p: F.struct(
            unescape(F.substring_index(p, BODY, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, BODY, -1), END, 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Each reply tree's best branches as formatted conversations, written out and read again.

    ``messages`` has (tree, node, parent, score, role, text); further columns are ignored. Result:
    see ``format_paths``. An empty table gives an empty result; empty texts give empty turns.
    """
    return written(format_paths(branch_paths(messages, branches), messages), "chat")


def linear_trees(turns: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Flat conversations as reply trees: each turn answers the one before, in order of turn.

    Null turns come last; ties and repeated turns follow role and text. Rows with a null
    conversation id form one conversation.
    """
    order = Window.partitionBy(tree_col).orderBy(F.col(turn_col).asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    rows = turns.withColumn("_n", F.row_number().over(order))
    node = lambda n: F.struct(F.col(tree_col).isNull().alias("no_tree"), F.coalesce(F.col(tree_col).cast("string"), F.lit("")).alias("tree"), n.alias("n"))
    return rows.select(
        F.col(tree_col).alias("tree"), node(F.col("_n")).alias("node"),
        F.when(F.col("_n") > 1, node(F.col("_n") - 1)).alias("parent"),
        F.lit(0.0).alias("score"), "role", "text",
    )
