"""Chat conversations from trees of replies, by DataFrame functions only.

Paths: every node points to the node it replies to. Each round of self-joins doubles how far the
pointers reach and adds up the scores on the way, so a path of n nodes takes log2(n) rounds; trees
without longer paths leave the loop. That gives each leaf its branch's length and mean score.
Branches rank by score within their tree, and the chosen ones are listed by halving: a stretch of
a path is split at the pointer that reaches into it, until each row is one node.

Format: a turn is an opening mark, its text and a closing mark, which depend on the role. Marks
inside texts get a backslash after their first character (and one more for each that is there), so
no text holds a mark and texts can be read back. The loss mask lists the places of assistants'
texts in the formatted conversation.

Defined cases: a null role or text is the empty one, and a null score is 0. A parent that its tree
does not have counts as none, so its child is a root. Rows of one tree and node are one node: the
least (parent, score) and the least (role, text) stand. Nodes on a circle, and below it, have no
root and are left out. Null trees and null nodes count as a tree and a node. Equal scores rank by
the leaf's id. An empty table gives no rows. Columns but those named are not read; long texts and
long paths are one row of output, as the format asks for.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import checkpoint, table, written

#: Opening and closing mark of a turn, by role; of other roles, whose name stands between OTHER's first two.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: What separates turns.
BETWEEN = "\n"
CONTROLS = [m for pair in MARKS.values() for m in pair] + list(OTHER)
_RESTS = {first: "|".join(re.escape(m[1:]) for m in CONTROLS if m[0] == first) for first in "<["}
#: Trees with unfinished paths of which so many are sent to all tasks.
FEW_TREES = 100_000


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


# --- paths


def branches(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """tree, leaf, length and score (the mean of the nodes') of each root-to-leaf path, and the pointers by round.

    nodes: tree, node, parent, score. The pointers of round k have tree, node and up, the node 2 ** k replies above.
    """
    plain = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    one = written(plain.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("r")).select("tree", "node", "r.parent", "r.score"))
    ids = one.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    linked = one.filter("parent IS NOT NULL").join(ids, _same("tree", "t") & (F.col("parent") == F.col("n")))
    # Nodes without a pointer are done: their sums reach the root.
    state = written(
        linked.select("tree", "node", F.col("parent").alias("up"), F.lit(1).alias("length"), "score", F.lit(True).alias("open")).unionByName(
            one.join(linked.select(F.col("tree").alias("t"), F.col("node").alias("n")), _same("tree", "t") & _same("node", "n"), "left_anti").select(
                "tree", "node", F.lit(None).cast(one.schema["node"].dataType).alias("up"), F.lit(1).alias("length"), "score", F.lit(False).alias("open")
            )
        )
    )
    pointers, done, n_open = [], [], state.filter("open").count()
    while n_open:
        pointers.append(state.filter("open").select("tree", "node", "up"))
        # Only trees with open nodes go on.
        trees = checkpoint(state.filter("open").select(F.col("tree").alias("t")).distinct())
        few = F.broadcast(trees) if trees.count() <= FEW_TREES else trees
        done.append(state.join(few, _same("tree", "t"), "left_anti"))
        state = state.join(few, _same("tree", "t"), "left_semi")
        ahead = state.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("_up"), F.col("length").alias("_length"), F.col("score").alias("_score"), F.col("open").alias("_open"))
        moved = state.filter("open").join(ahead, _same("tree", "t") & (F.col("up") == F.col("n")))
        moved = moved.select("tree", "node", F.col("_up").alias("up"), (F.col("length") + F.col("_length")).alias("length"), (F.col("score") + F.col("_score")).alias("score"), F.col("_open").alias("open"))
        state = written(state.filter("NOT open").unionByName(moved))
        left = state.filter("open").count()
        if left == n_open:
            break  # Every open node is on a circle or below one.
        n_open = left
    done.append(state.filter("NOT open"))
    ends = functools.reduce(DataFrame.unionByName, done)
    parents = one.select(F.col("tree").alias("t"), F.col("parent").alias("p")).filter("p IS NOT NULL").distinct()
    leaves = ends.join(parents, _same("tree", "t") & (F.col("node") == F.col("p")), "left_anti")
    return leaves.select("tree", F.col("node").alias("leaf"), "length", (F.col("score") / F.col("length")).alias("score")), pointers


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """tree, leaf, rank, score, place (0 for the root) and node: the nodes of each tree's keep best branches."""
    if keep < 1:
        raise ValueError("keep must be positive")
    found, pointers = branches(nodes)
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.asc_nulls_last("leaf"))
    chosen = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    # A stretch is its lowest node, that node's place and the number of nodes.
    stretch = chosen.select("tree", "leaf", "rank", "score", F.col("leaf").alias("node"), (F.col("length") - 1).alias("place"), F.col("length").alias("n"))
    for k in reversed(range(len(pointers))):
        jump = pointers[k].select(F.col("tree").alias("t"), F.col("node").alias("at"), "up")
        joined = stretch.join(jump, _same("tree", "t") & _same("node", "at") & (F.col("n") > 2**k), "left")
        low = F.struct("node", "place", F.least("n", F.lit(2**k)).alias("n"))
        high = F.struct(F.col("up").alias("node"), (F.col("place") - 2**k).alias("place"), (F.col("n") - 2**k).alias("n"))
        parts = F.when(F.col("n") > 2**k, F.array(low, high)).otherwise(F.array(low))
        stretch = joined.select("tree", "leaf", "rank", "score", F.inline(parts))
    return stretch.drop("n")


# --- format


def escaped(text: Column) -> Column:
    """text with a further backslash in all that looks like a mark."""
    return _change(text, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return _change(text, r"$1$2", taken=r"\\")


def _change(text: Column, to: str, taken: str = "") -> Column:
    for first, rest in _RESTS.items():
        text = F.regexp_replace(text, F.lit(rf"({re.escape(first)}){taken}(\\*(?:{rest}))"), F.lit(to))
    return text


def _mark(role: Column, which: int, other: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, marks in MARKS.items():
        out = F.when(role == name, marks[which]).otherwise(out)
    return F.coalesce(out, other)


def formatted(turns: DataFrame, by: list[str]) -> DataFrame:
    """by, text and loss (places, from 0, where assistants' texts start and end), from rows of by, place, role and text.

    Rows of one place are one turn, the least one.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy(*by).orderBy("place", "_role", "_text")
    rows = turns.select(*by, "place", role.alias("_role"), text.alias("_text"))
    rows = rows.withColumn("_before", F.lag("place").over(order)).filter("_before IS NULL OR _before != place")
    name = F.concat(F.lit(OTHER[0]), escaped(F.col("_role")), F.lit(OTHER[1]))
    # inline: the escaped text is made once, and not again for each use.
    piece = F.struct(_mark(F.col("_role"), 0, name).alias("open"), escaped(F.col("_text")).alias("body"), F.concat(_mark(F.col("_role"), 1, F.lit(OTHER[2])), F.lit(BETWEEN)).alias("close"))
    rows = rows.select(*by, "place", "_role", "_text", F.inline(F.array(piece)))
    size = F.length("open") + F.length("body") + F.length("close")
    rows = rows.withColumn("end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("close"))
    span = F.when(F.col("_role") == "assistant", F.struct((F.col("end") - F.length("body")).alias("start"), F.col("end").alias("end")))
    pieces = F.sort_array(F.collect_list(F.struct("place", F.concat("open", "body", "close").alias("piece"), span.alias("span"))))
    out = rows.groupBy(*by).agg(pieces.alias("p"))
    return out.select(*by, F.array_join(F.col("p.piece"), "").alias("text"), F.filter(F.col("p.span"), lambda s: s.isNotNull()).alias("loss"))


def conversations(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """tree, leaf, rank, score, text and loss: the keep best branches of each tree, each formatted. nodes: tree, node, parent, role, text, score."""
    chosen = paths(nodes, keep).withColumnsRenamed({"tree": "t", "node": "n"})
    turns = nodes.select("tree", "node", "role", "text").join(chosen, _same("tree", "t") & _same("node", "n"))
    by = ["tree", "leaf", "rank", "score"]
    return formatted(turns.select(*by, "place", "role", "text"), by)


def read_back(text: Column) -> Column:
    """The turns (role and text) of a formatted conversation."""
    opening = "|".join(re.escape(m) for m in [*(a for a, _ in MARKS.values()), OTHER[0]])
    closing = "|".join(re.escape(m) for m in [*(b for _, b in MARKS.values()), OTHER[2]])
    # The closing mark that comes first is the turn's own, as texts hold none.
    turns = F.regexp_extract_all(text, F.lit(rf"(?s)((?:{opening}).*?)(?:{closing})"), F.lit(1))

    def turn(t: Column) -> Column:
        named = F.substring_index(t, OTHER[1], 1)
        role, body = named.substr(F.lit(len(OTHER[0]) + 1), F.length(named)), t.substr(F.length(named) + len(OTHER[1]) + 1, F.length(t))
        for name, (a, _) in MARKS.items():
            role = F.when(t.startswith(a), name).otherwise(role)
            body = F.when(t.startswith(a), t.substr(F.lit(len(a) + 1), F.length(t))).otherwise(body)
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, turn)


def under_mask(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(text.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


# --- the table of conversations


def chains(rows: DataFrame) -> DataFrame:
    """Nodes of conv_id, turn, role and text: each row replies to the one before it in order of turn, role and text; a repeated row is a turn too."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = rows.select(F.col("conv_id").alias("tree"), F.row_number().over(order).alias("node"), "role", "text")
    return numbered.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = conversations(written(chains(rows)))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = out.select(F.col("tree").alias("conv_id"), F.length("text").cast("long").alias("formatted_chars"), F.inline(F.array(F.struct(read_back(F.col("text")).alias("turns"), under_mask(F.col("text"), F.col("loss")).alias("said")))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2(F.col("said"), 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*(?:<SYS>>|</SYS>>|s>|/s>))', '<\\\1', 'g'), '\[(\\*(?:INST\]|/INST\]|ROLE\]|TEXT\]|/ROLE\]))', '[\\\1', 'g')) AS n,
length(regexp_replace(regexp_replace(role, '<(\\*(?:<SYS>>|</SYS>>|s>|/s>))', '<\\\1', 'g'), '\[(\\*(?:INST\]|/INST\]|ROLE\]|TEXT\]|/ROLE\]))', '[\\\1', 'g')) AS role_n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
sum(n + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 14 WHEN 'assistant' THEN 8 ELSE role_n + 20 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

QUERIES = {"op11_reply_trees": op11_reply_trees}
ORACLES = {"op11_reply_trees": ORACLE}
