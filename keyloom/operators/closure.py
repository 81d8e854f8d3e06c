"""Closures over edge tables of any size, in rounds of joins: components, levels, what depends on what.

Each round is a grouping and joins by key over the edges that are left; tables between rounds are written
to the shared folder, so that plans don't grow with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that it is connected with), for all nodes of edges.

    A node takes the smallest label of its neighbours and then the label of that label, so chains halve with each
    round. Null ends and edges from a node to itself connect nothing; the latter's node is there.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    pairs = materialise(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialise(pairs.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        near = pairs.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        after = materialise(low.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        discard(labels)
        labels = after
        if labels.where("old <> label").isEmpty():
            discard(pairs)
            return labels.select("node", F.col("label").alias("component"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level: 0 without parents, else one more than the highest parent's; null on or behind a cycle.

    nodes: node; edges: child, parent. Edges from a node to itself and those with an end that isn't in nodes don't
    count. A round for each level.
    """
    left = materialise(nodes.select("node").where("node is not null").distinct(), "nodes")
    known = lambda end: left.select(F.col("node").alias(end))
    open_ = materialise(edges.select("child", "parent").where("child <> parent").distinct().join(known("child"), "child", "left_semi").join(known("parent"), "parent", "left_semi"), "edges")
    out, level = None, 0
    while True:
        ready = materialise(left.join(open_.select(F.col("child").alias("node")).distinct(), "node", "left_anti"), "ready")
        if ready.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if out is None else out.unionByName(rest)
        placed = ready.withColumn("level", F.lit(level))
        out = placed if out is None else out.unionByName(placed)
        fewer = materialise(open_.join(ready.select(F.col("node").alias("parent")), "parent", "left_anti"), "edges")
        rest = materialise(left.join(ready, "node", "left_anti"), "nodes")
        discard(open_, left)
        open_, left, level = fewer, rest, level + 1


def require_acyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """levels(), with an error that names a node where there is a cycle."""
    found = levels(nodes, edges)
    bad = found.where("level is null").agg(F.min("node").alias("n"), F.count("*").alias("c")).first()
    if bad["c"]:
        raise ValueError(f"cyclic dependencies among {bad['c']} nodes, {bad['n']} first")
    return found


def dependents(start: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, steps: all nodes that depend on one of start, directly (1) or through others; start itself isn't there unless it does too.

    start: node; edges: child, parent. With nodes only those count as children, and a parent that isn't one of
    them counts as a start. Each round takes only what the round before found, so cycles end.
    """
    pairs = edges.select("child", "parent").where("child <> parent").distinct()
    begin = start.select("node")
    if nodes is not None:
        pairs = pairs.join(nodes.select(F.col("node").alias("child")).distinct(), "child", "left_semi")
        begin = begin.unionByName(pairs.select(F.col("parent").alias("node")).join(nodes.select("node"), "node", "left_anti"))
    pairs = materialise(pairs, "edges")
    fresh = materialise(begin.distinct(), "fresh")
    seen, steps = None, 0
    while True:
        steps += 1
        found = pairs.join(fresh.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        if seen is not None:
            found = found.join(seen.select("node"), "node", "left_anti")
        fresh = materialise(found.withColumn("steps", F.lit(steps)), "fresh")
        if fresh.isEmpty():
            discard(pairs)
            return seen if seen is not None else fresh
        seen = fresh if seen is None else seen.unionByName(fresh)


def missing_parents(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """child, parent where the child is selected (node) and the parent isn't."""
    chosen = selected.select("node").distinct()
    found = edges.select("child", "parent").where("child <> parent").distinct().join(chosen.select(F.col("node").alias("child")), "child", "left_semi")
    return found.join(chosen.select(F.col("node").alias("parent")), "parent", "left_anti").select("child", "parent")
