"""Reply trees as conversations in one chat format, with a loss mask; DataFrame functions only.

Nodes have a number, their parent's number and a score. ``paths`` enumerates root-to-leaf paths by
iterative self-joins: each round joins every node's jump with the jump at its end, so jumps
double and a path of n nodes takes log2(n) rounds, each of them written out. The jumps carry the
sum of scores, by which the branches of a tree are ranked; the same jumps, from the longest to
the shortest, then list the nodes of the chosen branches.

``formatted`` writes each path as one conversation:

    ### role: text</turn>
    ### role: text</turn>

Inside texts and roles a backslash is put into every control string (``#\\## ``, ``<\\/turn>``, and ``:\\ ``
in roles) after its first letter, before backslashes that stand there already; so no text holds a
control string, and taking one backslash out again restores it. The mask has the spans of the
texts to be learned, in code points. A conversation of more than ``SEGMENT`` turns is several rows in
order, each of whole turns with its own mask, so none has to be put together from a single group
of all its turns.

Cases: null texts and roles are empty ones; texts of any length are formatted whole; turns with equal
place follow by the digest of role and text, repeated rows are turns each; rows without a
conversation's id are one conversation of their own; a node whose parent is missing or itself is a root, and in
a ring of parents the smallest node is; of rows that repeat an id the first by digest has the
replies and the others are siblings without; null scores count nothing, and equal branches rank by
their leaf's number; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pathweave.operators.report import numbered
from pathweave.session import cut_lineage, write_and_reread

SEGMENT = 256
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
#: First letter and rest of each control string; the last one divides a role from its text.
CONTROL = (("#", "## "), ("<", "/turn>"))
DIVIDER = ((":", " "),)


def escaped(text: Column, control: Sequence[tuple[str, str]] = CONTROL) -> Column:
    for first, rest in control:
        text = F.regexp_replace(text, rf"{first}(\\*){rest}", rf"{first}\\$1{rest}")
    return text


def unescaped(text: Column, control: Sequence[tuple[str, str]] = CONTROL) -> Column:
    for first, rest in control:
        text = F.regexp_replace(text, rf"{first}\\(\\*){rest}", rf"{first}$1{rest}")
    return text


def _digest(role: str, text: str) -> Column:
    return F.md5(F.concat_ws("\n", F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))))


def chain(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes ``node, parent, tag, role, text, score`` of conversations by turn: each turn replies to the one before."""
    d = rows.select(F.col(conv).alias("tag"), F.col(turn).alias("turn"), _digest(role, text).alias("tie"), F.col(role).alias("role"), F.col(text).alias("text"))
    d = numbered(d, "node", F.asc("tag"), F.asc("turn"), F.asc("tie"))
    before = d.select((F.col("node") + 1).alias("node"), F.lit(True).alias("has"), F.col("tag").alias("tag_before"))
    parent = F.when(F.col("has") & F.col("tag").eqNullSafe(F.col("tag_before")), F.col("node") - 1)
    return d.join(before, "node", "left").select("node", parent.alias("parent"), "tag", "role", "text", F.lit(0.0).alias("score"))


def tree(rows: DataFrame, *, id_col: str = "id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str = "score") -> DataFrame:
    """Nodes of replies that name their parent's id; ``tag`` is the id."""
    d = rows.select(F.col(id_col).alias("tag"), F.col(parent).alias("up"), _digest(role, text).alias("tie"), F.col(role).alias("role"), F.col(text).alias("text"), F.col(score).cast("double").alias("score"))
    d = numbered(d, "node", F.asc("tag"), F.asc("tie"), F.asc("up"), F.asc("score"))
    # nulls name nothing, and a row can't reply to its own id
    ids = d.filter(F.col("tag").isNotNull()).groupBy(F.col("tag").alias("up")).agg(F.min("node").alias("parent"))
    named = d.filter(F.col("up").isNotNull() & ~F.col("up").eqNullSafe(F.col("tag"))).join(ids, "up")
    linked = named.select("node", "parent", "tag", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    rest = d.join(linked.select("node"), "node", "left_anti")
    return linked.unionByName(rest.select("node", F.lit(None).cast("long").alias("parent"), "tag", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")))


def jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``node, root, depth, total`` of each node (nodes and scores from the root down to it), and the jumps
    ``node, at`` over 1, 2, 4, ... parents."""
    state = write_and_reread(nodes.select("node", F.col("parent").alias("at"), F.col("node").alias("root"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"), F.col("node").alias("least")), "chat-jumps")
    most, levels = state.count(), []
    while True:
        open_ = state.filter(F.col("at").isNotNull())
        if open_.isEmpty():
            return state.drop("at", "least"), levels
        if 1 << len(levels) > most:  # only rings of parents are that long
            return jumps(_without_rings(nodes, open_))
        levels.append(open_.select("node", "at"))
        end = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("total").alias("t"), F.col("least").alias("l"))
        further = open_.join(end, "at").select("node", F.col("next").alias("at"), F.col("r").alias("root"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total"), F.least("least", "l").alias("least"))
        state = write_and_reread(state.filter(F.col("at").isNull()).unionByName(further), "chat-jumps")


def _without_rings(nodes: DataFrame, stuck: DataFrame) -> DataFrame:
    """``nodes`` with the smallest node of each ring as a root. After so many parents every jump ends in a ring."""
    in_ring = stuck.select(F.col("at").alias("node")).distinct()
    roots = stuck.join(in_ring, "node", "left_semi").filter("node = least").select("node", F.lit(True).alias("cut"))
    return cut_lineage(nodes.join(roots, "node", "left").withColumn("parent", F.when(F.col("cut").isNull(), F.col("parent"))).drop("cut"))


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``branch, root, place, node``: the nodes, from place 0, of each tree's ``branches`` best leaves by the
    sum of scores (None: of all leaves). A branch is named by its leaf."""
    ends, levels = jumps(nodes)
    parents = nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    leaves = ends.join(parents, "node", "left_anti")
    if branches is not None:
        best = W.partitionBy("root").orderBy(F.desc("total"), "node")
        leaves = leaves.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= branches)
    found = write_and_reread(leaves.select(F.col("node").alias("branch"), "root", (F.col("depth") - 1).alias("place"), "node"), "chat-paths")
    for k in reversed(range(len(levels))):
        up = found.join(levels[k], "node").select("branch", "root", (F.col("place") - (1 << k)).alias("place"), F.col("at").alias("node"))
        found = write_and_reread(found.unionByName(up), "chat-paths")
    return found


def formatted(nodes: DataFrame, chosen: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """``branch, tag, segment, text, mask`` of the chosen paths; ``tag`` is the smallest of the path."""
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(HEAD), escaped(escaped(role), DIVIDER), F.lit(MIDDLE))
    turn = F.struct("place", head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"), role.isin(list(learn)).alias("learn"))
    turns = chosen.join(nodes.select("node", "tag", "role", "text"), "node").select("branch", F.floor(F.col("place") / SEGMENT).alias("segment"), "tag", turn.alias("turn"))
    whole = turns.groupBy("branch", "segment").agg(F.min("tag").alias("tag"), F.array_sort(F.collect_list("turn")).alias("turns"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(TAIL)).alias("at"), F.when(t["learn"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    return whole.select("branch", "tag", "segment", text.alias("text"), F.aggregate("turns", start, step, lambda acc: acc["mask"]).alias("mask"))


def read_back(segments: DataFrame) -> DataFrame:
    """``branch, tag, segment, turns, learned``: roles and texts, and the texts under the mask, from formatted rows."""
    parts = F.split("text", TAIL, -1)
    turns = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescaped(unescaped(F.substring_index(F.substring(p, len(HEAD) + 1, F.length(p)), MIDDLE, 1), DIVIDER)).alias("role"),
            unescaped(F.substring(p, F.locate(MIDDLE, p) + len(MIDDLE), F.length(p))).alias("text"),
        ),
    )
    learned = F.transform("mask", lambda m: unescaped(F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"])))
    return segments.select("branch", "tag", "segment", F.length("text").alias("chars"), turns.alias("turns"), learned.alias("learned"))


def digests(segments: DataFrame) -> DataFrame:
    """``tag, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of each conversation, as read back."""
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    d = read_back(segments).select("branch", "tag", "segment", "chars", F.size("turns").alias("n"), listing.alias("listing"), F.array_join("learned", "").alias("learned"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", c))), lambda x: x[c]), "")
    d = d.groupBy("branch").agg(F.min("tag").alias("tag"), F.sum("n").alias("n_turns"), joined("listing").alias("listing"), joined("learned").alias("learned"), F.sum("chars").alias("formatted_chars"))
    return d.select("tag", "n_turns", F.sha2("listing", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
