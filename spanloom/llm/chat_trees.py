"""Reply trees to training conversations: every root-to-leaf path is found by iterative
self-joins, branches are ranked by score, and each chosen path becomes one formatted text.

DataFrame operations only. The joins double the distance they bridge, so a thread of n turns
needs log2(n) rounds; each round is checkpointed. A conversation's text is one output row, so the
turns of one conversation meet in one place by the nature of the result.

Template: ``<|role|>text<|end|>`` per turn. ``&``, ``<`` and ``>`` inside roles and texts become
``&amp;``, ``&lt;`` and ``&gt;``, so no text can hold a control string and reading back is exact.

Defined cases: a null role or text counts as empty; a null conversation id is a conversation of
its own; turns with equal numbers (repeated rows too) follow in the order of role, then text, null
turn numbers first; of rows with equal conversation and node the least stays; a reply to a node that is missing
starts a path; nodes on a ring (of one node, too) are missing, so a leaf below a ring has the path up to the ring. An
empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import columns
from spanloom.session import cut_lineage

END = "<|end|>"


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def chain(turns: DataFrame) -> DataFrame:
    """Threads without branches as trees: each turn replies to the one before it."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    turns = columns(turns, "conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    spot = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("bigint")
    score = F.length("text").cast("double")
    return turns.select("conv_id", spot.alias("node"), "role", "text", score.alias("score")).select(
        "*", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent")
    )


def one_row_each(nodes: DataFrame) -> DataFrame:
    """Of rows of one conversation and node the least by parent, role, text and score."""
    fields = ("parent", "role", "text", "score")
    least = nodes.groupBy("conv_id", "node").agg(F.min(F.struct(*fields)).alias("row"))
    return least.select("conv_id", "node", *[F.col(f"row.{f}").alias(f) for f in fields])


def _hops(edges: DataFrame, most: int) -> list[DataFrame]:
    """Tables (c, n, to) of the nodes 1, 2, 4, ... above each node, until there are none or ``most`` is reached."""
    known = edges.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    found = edges.alias("a").join(
        known.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.c")) & (F.col("a.parent") == F.col("b.n")), "left_semi"
    )
    hops = [cut_lineage(found.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("parent").alias("to")))]
    while 1 << (len(hops) - 1) < most and not hops[-1].isEmpty():
        last = hops[-1]
        further = last.alias("a").join(
            last.alias("b"), F.col("a.c").eqNullSafe(F.col("b.c")) & (F.col("a.to") == F.col("b.n"))
        )
        hops.append(cut_lineage(further.select("a.c", "a.n", "b.to")))
    return hops


def paths(nodes: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): each node above a leaf and its distance from it.

    A way of as many steps as a conversation has nodes can only lead round a ring, and all nodes of the ring
    are such ends. They are taken out, so what is left are trees and the rounds end by themselves.
    """
    edges = nodes.select("conv_id", "node", "parent")
    most = edges.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    hops = _hops(edges, most)
    if 1 << (len(hops) - 1) >= most and not hops[-1].isEmpty():
        ring = hops[-1].select("c", F.col("to").alias("n")).distinct()
        on_ring = F.col("a.conv_id").eqNullSafe(F.col("b.c")) & (F.col("a.node") == F.col("b.n"))
        off = edges.alias("a").join(ring.alias("b"), on_ring, "left_anti")
        hops = _hops(off, most)
    else:
        off = edges
    has_child = edges.select(F.col("conv_id").alias("c"), F.col("parent").alias("n")).distinct()
    leaves = off.alias("a").join(
        has_child.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.c")) & (F.col("a.node") == F.col("b.n")), "left_anti"
    )
    walk = leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    for k, hop in enumerate(hops[:-1]):  # the last one is empty
        higher = walk.alias("a").join(
            hop.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.c")) & (F.col("a.node") == F.col("b.n"))
        ).select("a.conv_id", "a.leaf", F.col("b.to").alias("node"), (F.col("a.up") + (1 << k)).alias("up"))
        walk = cut_lineage(walk.unionByName(higher))
    return walk


def format_trees(nodes: DataFrame, best: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """One row per chosen path: the ``best`` branches by mean score, or all of them.

    Returns conv_id, leaf, branch (rank from 1), formatted, and ``loss``: the (start, length)
    spans, in code points, of the text of the trained role.
    """
    nodes = one_row_each(nodes)
    found = paths(nodes).alias("p")
    turns = found.join(
        nodes.alias("n"),
        F.col("p.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("p.node") == F.col("n.node")),
    ).select("p.conv_id", "p.leaf", "p.up", "n.role", "n.text", "n.score")
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))
    body = escape(F.col("text"))
    turns = turns.select(
        "conv_id", "leaf", "up", "score", "role",
        F.concat(head, body, F.lit(END)).alias("piece"),
        F.length(head).alias("skip"),
        F.length(body).alias("size"),
    )
    before = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    turns = turns.withColumn(
        "start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("skip")
    )
    span = F.when(F.col("role") == trained_role, F.struct("start", "size"))
    rows = turns.groupBy("conv_id", "leaf").agg(
        F.avg("score").alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(span)).alias("loss"),
    )
    rank = F.row_number().over(
        Window.partitionBy("conv_id").orderBy(F.desc("score"), F.asc("leaf"))
    )
    rows = rows.withColumn("branch", rank)
    if best is not None:
        rows = rows.where(F.col("branch") <= best)
    return rows.select(
        "conv_id", "leaf", "branch", F.concat_ws("", F.col("pieces.piece")).alias("formatted"), "loss"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and the text under the loss mask, taken from the formatted text alone
    and its spans."""
    pieces = F.split("formatted", r"<\|end\|>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, 3, 2**31 - 1), "|>", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "|>") + 2, F.lit(2**31 - 1))).alias("text"),
    )
    masked = F.transform(
        "loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["size"]))
    )
    return formatted.select(
        "*", F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("loss_text")
    )
