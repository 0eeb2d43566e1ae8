"""Reply trees as chat text: one conversation per root-to-leaf path.

Messages name their parent; a message without one, or whose parent is missing, is
a root.  Paths are found by self-joins that double the reach of the ancestor
links each time, so a chain of n messages takes log2(n) joins.  The branches of a
conversation are ranked by the mean score of their messages, and each chosen
branch becomes one text::

    <|im_start|>role
    text<|im_end|>

Control strings inside texts and roles are escaped, so none can be taken for
markup: a backslash becomes ``\\b``, ``<|`` becomes ``<\\p``, and in roles a line
feed becomes ``\\n``.  Undoing it in the opposite order gives the text back.  The
loss mask is a list of spans, in code points of the formatted text: the escaped
texts of assistant turns, without markup.

Only DataFrame functions are used.

Defined cases: null roles and texts are empty; a null conversation id is a
conversation; a null score counts as zero; of rows that repeat a message id in a
conversation the first by parent, role and text stays, since a tree has one
message per id; messages whose ancestors form a ring have no root and so no path;
an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privaudit.llm.storage import materialize

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _key(column: Column) -> Column:
    """A text that differs for null and every value."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n"))


def paths(nodes: DataFrame) -> DataFrame:
    """``conv, leaf, node, above`` for every root-to-leaf path of ``conv, node, parent``.

    ``above`` counts the steps from the leaf up to the node.
    """
    parents = nodes.select("conv", F.col("parent").alias("node")).where("node is not null").distinct()
    known = nodes.select("conv", F.col("node").alias("parent"))
    links = materialize(nodes.join(known, ["conv", "parent"], "left_semi").select("conv", "node", F.col("parent").alias("up")), "chat-links")
    found = materialize(nodes.join(parents, ["conv", "node"], "left_anti").select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")), "chat-paths")
    largest = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= largest and not links.isEmpty():
        step = links.select("conv", "node", "up")
        further = found.join(step, ["conv", "node"]).select("conv", "leaf", F.col("up").alias("node"), (F.col("above") + reach).alias("above"))
        found = materialize(found.union(further), "chat-paths")
        ahead = links.select("conv", F.col("node").alias("up"), F.col("up").alias("next"))
        links = materialize(links.join(ahead, ["conv", "up"]).select("conv", "node", F.col("next").alias("up")), "chat-links")
        reach *= 2
    if not links.isEmpty():  # what still has an ancestor after so many steps goes round a ring
        rings = links.select("conv", F.col("node").alias("leaf")).distinct()
        found = found.join(rings, ["conv", "leaf"], "left_anti")
    return found


def format_conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Format ``conv_id, msg_id, parent_id, role, text, score``.

    One row per chosen path: ``conv_id, leaf_id, branch_rank, branch_score,
    n_turns, formatted, loss_spans``.  ``branches`` keeps that many best branches
    of each conversation; None keeps all.
    """
    rows = messages.select(
        _key(F.col("conv_id")).alias("conv"),
        _key(F.col("msg_id")).alias("node"),
        F.when(F.col("parent_id").isNotNull(), _key(F.col("parent_id"))).alias("parent"),
        "conv_id",
        "msg_id",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    first = Window.partitionBy("conv", "node").orderBy("parent", "role", "text")
    rows = rows.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")
    found = paths(rows.select("conv", "node", "parent"))

    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    pieces = rows.select("conv", "node", "conv_id", "msg_id", "score", (F.col("role") == "assistant").alias("learnt"), F.char_length(head).cast("long").alias("head"), F.char_length(body).cast("long").alias("body"), F.concat(head, body, F.lit(END + "\n")).alias("piece"))
    turns = found.join(pieces, ["conv", "node"])
    before = Window.partitionBy("conv", "leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.col("head")
    placed = turns.withColumn("start", start)
    grouped = placed.groupBy("conv", "leaf").agg(
        F.min("conv_id").alias("conv_id"),
        F.min(F.when(F.col("above") == 0, F.col("msg_id"))).alias("leaf_id"),
        F.avg("score").alias("branch_score"),
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("order"), "piece", "learnt", "start", (F.col("start") + F.col("body")).alias("end")))).alias("turns"),
    )
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("branch_score"), "leaf"))
    ranked = grouped.withColumn("branch_rank", rank)
    if branches is not None:
        ranked = ranked.where(F.col("branch_rank") <= branches)
    spans = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return ranked.select("conv_id", "leaf_id", "branch_rank", "branch_score", "n_turns", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: an array of ``role, text``."""
    parts = F.split(formatted, "<\\|im_end\\|>\n")

    def turn(part: Column) -> Column:
        own = F.substring(part, len(START) + 1, 1 << 30)
        at = F.instr(own, "\n")
        return F.struct(unescape_role(own.substr(F.lit(1), at - 1)).alias("role"), unescape(own.substr(at + 1, F.char_length(own))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
