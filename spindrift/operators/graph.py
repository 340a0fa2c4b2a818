"""Prerequisite graphs: closure, order, what comes next, progress.

Closures are loops over levels with a bound on depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .ordering import numbered

MOST_LEVELS = 90


def edges(nodes: DataFrame, node: str = "id", prerequisites: str = "prerequisites") -> DataFrame:
    """node and prerequisite, one row for each."""
    return nodes.select(F.col(node).alias("node"), F.explode(prerequisites).alias("prerequisite"))


def ancestors(edges_: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """node, ancestor and depth (the least) of all that lies above a node.

    A level at a time: only pairs that are new go on, so a pair is joined once however many ways lead to it, and a cycle ends by itself.
    """
    edges_ = checkpointed(edges_.select("node", "prerequisite").distinct())
    up = edges_.select(F.col("node").alias("ancestor"), F.col("prerequisite").alias("next"))
    found = edges_.select("node", F.col("prerequisite").alias("ancestor"), F.lit(1).alias("depth"))
    fresh = found
    for depth in range(2, levels + 1):
        step = fresh.join(up, "ancestor").select("node", F.col("next").alias("ancestor")).distinct()
        fresh = checkpointed(step.join(found, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


def topological(edges_: DataFrame, nodes: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """node and level: the longest way down to a node without prerequisites, at most levels. Order by level, node.

    A node's level is one above its highest prerequisite; levels rise until nothing changes.
    """
    edges_ = checkpointed(edges_.select("node", "prerequisite").distinct())
    known = nodes.select("node").union(edges_.select("node")).union(edges_.select("prerequisite")).distinct().withColumn("level", F.lit(0))
    known = checkpointed(known)
    for _ in range(levels):
        above = edges_.join(known.select(F.col("node").alias("prerequisite"), "level"), "prerequisite").groupBy("node").agg((F.max("level") + 1).alias("new"))
        new = checkpointed(known.join(above, "node", "left").select("node", F.greatest("level", F.coalesce("new", F.lit(0))).alias("level"), (F.coalesce("new", F.lit(0)) > F.col("level")).alias("moved")))
        known = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return nodes.select("node").distinct().join(known, "node")


def learning_paths(topics: DataFrame, edges_: DataFrame, completed: DataFrame, by: str = "student") -> DataFrame:
    """by, node, turn and step: the order in which each student takes topics when a list in order of place is gone through turn after turn,
    and a topic is taken as soon as all its prerequisites are completed or taken.

    topics: by, node and place (equal places go by node); completed: by and node. Topics with a prerequisite that is neither completed nor
    ever taken, as in a cycle or outside the list, are not in the path. A topic's turn is its latest prerequisite's, or the next one if that stands
    below it. The frontier of topics just taken meets the edges once, so there are as many rounds as the longest chain has topics.
    """
    own = topics.select(by, "node", "place").distinct()
    done = completed.select(by, F.col("node").alias("prerequisite")).distinct()
    waits = own.join(edges_.select("node", "prerequisite").distinct(), "node").join(done, [by, "prerequisite"], "left_anti")
    waits = checkpointed(waits.select(by, "node", "prerequisite", F.struct("place", "node").alias("at")))
    need = waits.groupBy(by, "node").agg(F.count("*").alias("need"))
    open_ = checkpointed(own.join(need, [by, "node"], "left").select(by, "node", "place", F.coalesce("need", F.lit(0)).alias("need"), F.lit(1).alias("turn")))
    taken = open_.filter("need = 0")
    fresh, open_ = taken, open_.filter("need > 0")
    while not fresh.isEmpty():
        last = fresh.select(by, F.col("node").alias("prerequisite"), F.struct("place", "node").alias("before"), F.col("turn").alias("then"))
        met = waits.join(last, [by, "prerequisite"]).groupBy(by, "node").agg(F.count("*").alias("met"), F.max(F.col("then") + (F.col("before") > F.col("at")).cast("int")).alias("then"))
        left = open_.join(met, [by, "node"], "left")
        open_ = checkpointed(left.select(by, "node", "place", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"), F.greatest("turn", F.coalesce("then", F.lit(1))).alias("turn")))
        fresh, open_ = open_.filter("need = 0"), open_.filter("need > 0")
        taken = taken.unionByName(fresh)
    # Steps are places in the order of all paths, less where a path begins: no path is sorted by one task.
    placed = numbered(taken.drop("need"), by, "turn", "place", "node", name="step")
    start = placed.groupBy(by).agg(F.min("step").alias("_start"))
    return placed.join(start, by).select(by, "node", "turn", (F.col("step") - F.col("_start") + 1).alias("step"))


def next_topics(nodes: DataFrame, completed: DataFrame) -> DataFrame:
    """Nodes (id, prerequisites) that are not completed (id) and whose prerequisites all are."""
    e = edges(nodes)
    unmet = e.join(completed.select(F.col("id").alias("prerequisite")), "prerequisite", "left_anti").select(F.col("node").alias("id")).distinct()
    return nodes.join(completed, "id", "left_anti").join(unmet, "id", "left_anti")


def induced(edges_: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges between kept nodes (node)."""
    ids = keep.select("node").distinct()
    return edges_.join(ids, "node", "left_semi").join(ids.withColumnRenamed("node", "prerequisite"), "prerequisite", "left_semi").select("node", "prerequisite")


def progress(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """One row: completed, in_progress, available and completion (per cent). states: id and status."""
    done = states.filter("status = 'completed'").select("id")
    open_ = next_topics(nodes, done)
    counted = nodes.select("id").join(states, "id", "left").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "in_progress").alias("in_progress")
    )
    available = open_.join(states.filter("status = 'in_progress'"), "id", "left_anti").agg(F.count("*").alias("available"))
    return counted.crossJoin(available).withColumn("completion", F.coalesce(F.try_divide(100 * F.col("completed"), F.col("total")), F.lit(0.0)))
