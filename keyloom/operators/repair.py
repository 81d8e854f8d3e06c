"""Repairs that follow references and unique values as far as they lead, in rounds over sets of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators import closure
from keyloom.plans.spec import TableSpec
from keyloom.session import discard, materialise


def _grown(frontier: DataFrame, step) -> DataFrame:
    """All rows (node, …) that step(frontier) leads to from the first ones, each node once; a round takes only new nodes."""
    fresh = materialise(frontier, "frontier")
    seen, parts = fresh, [fresh]
    while True:
        new = materialise(step(fresh).dropDuplicates(["node"]).join(seen.select("node"), "node", "left_anti"), "frontier")
        if new.isEmpty():
            out = materialise(seen, "repair")
            discard(*parts, new)
            return out
        parts.append(new)
        seen, fresh = seen.unionByName(new), new


def recursive_parents(wanted: DataFrame, source: DataFrame, target: DataFrame, key: str, parent: str) -> DataFrame:
    """key, round, outcome: the rows to insert for wanted keys whose parents, in the same table, the target lacks too.

    Rows go by round: 0 first, then those whose parent a round before inserted, so no reference is ever open. Each
    key is met once, however many rows need it. outcome: `insert`, or without a round `cycle` (on a cycle of
    references or behind one), `lost` (the source has no such row) or `behind_lost`. Rows that the target has need
    nothing and are left out; a row that refers to itself or to nothing has no parent. Null keys are left out.
    """
    have = target.select(F.col(key).alias("node")).where("node is not null").distinct()
    rows = source.select(F.col(key).alias("node"), F.when(F.col(parent) != F.col(key), F.col(parent)).alias("parent"), F.lit(True).alias("there"))
    look = lambda keys: keys.where("node is not null").distinct().join(have, "node", "left_anti").join(rows, "node", "left")
    found = _grown(look(wanted.select(F.col(key).alias("node"))), lambda new: look(new.select(F.col("parent").alias("node"))))
    edges = materialise(found.where("parent is not null").select(F.col("node").alias("child"), "parent"), "edges")
    rounds = closure.levels(found, edges)
    lost = found.where("there is null").select("node")
    behind = closure.dependents(lost, edges).select("node", F.lit(True).alias("behind"))
    out = found.join(rounds, "node").join(behind, "node", "left")
    outcome = F.when(F.col("there").isNull(), "lost").when(F.col("behind"), "behind_lost").when(F.col("level").isNull(), "cycle").otherwise("insert")
    return out.select(F.col("node").alias(key), F.when(outcome == "insert", F.col("level")).alias("round"), outcome.alias("outcome"))


def unique_owners(wanted: DataFrame, source: DataFrame, target: DataFrame, spec: TableSpec, unique: list[str]) -> DataFrame:
    """node (struct of the key), action, round, parked, row: everything to write so that wanted keys get their source rows.

    A row's unique values (none null) may belong to another row of the target. That owner gets its own source row,
    or goes if it has none; its values may have an owner again, and so on. A row is written in the round behind
    that of the owner of its values (0: nobody has them). Rows on or behind a cycle of owners are parked: their
    unique values are cleared in the target before round 0, and then they go in round 0. action: insert,
    update or delete. Keys whose target row equals the source row need nothing, unless they are wanted.
    """
    node = lambda df: df.select(F.struct(*spec.key).alias("node"), F.struct(*spec.writable).alias("row"))
    s, t = node(source), node(target)
    full = reduce(lambda a, b: a & b, [F.col(f"row.{c}").isNotNull() for c in unique])
    values = F.struct(*[F.col(f"row.{c}").alias(c) for c in unique])
    # Both written once: rounds read them again, and would work out source and target anew.
    owners = materialise(t.where(full).select(values.alias("value"), F.col("node").alias("owner")), "owners")
    known = materialise(s.join(t.select("node", F.lit(True).alias("there")), "node", "full_outer").withColumn("value", F.when(full, values)), "known")
    look = lambda keys: keys.select("node").distinct().join(known, "node", "left")
    taken = lambda rows: rows.join(owners, "value").where(F.col("owner") != F.col("node"))
    found = _grown(look(wanted.select(F.struct(*spec.key).alias("node"))), lambda new: look(taken(new).select(F.col("owner").alias("node"))))
    edges = materialise(taken(found).select(F.col("node").alias("child"), F.col("owner").alias("parent")), "edges")
    discard(owners, known)
    out = found.join(closure.levels(found, edges), "node")
    action = F.when(F.col("row").isNull(), "delete").when(F.col("there"), "update").otherwise("insert")
    out = out.select("node", action.alias("action"), F.coalesce("level", F.lit(0)).alias("round"), F.col("level").isNull().alias("parked"), "row", "there")
    return out.where("row is not null or there").drop("there")


def apply_owners(target: DataFrame, plan: DataFrame, spec: TableSpec) -> DataFrame:
    """The target behind all rounds of a plan."""
    kept = target.withColumn("_n", F.struct(*spec.key)).join(plan.select(F.col("node").alias("_n")), "_n", "left_anti").select(*spec.writable)
    return kept.unionByName(plan.where("action <> 'delete'").select("row.*").select(*spec.writable))


def broken_rounds(target: DataFrame, plan: DataFrame, spec: TableSpec, unique: list[str]) -> DataFrame:
    """Plan rows whose unique values another row still has when their round comes: none, if the plan is right.

    A target row has its values until its round is done, or until it is parked.
    """
    value = lambda: F.struct(*[F.col(f"row.{c}").alias(c) for c in unique])
    full = reduce(lambda a, b: a & b, [F.col(f"row.{c}").isNotNull() for c in unique])
    old = target.select(F.struct(*spec.key).alias("node"), F.struct(*spec.writable).alias("row")).join(plan.select("node", "round", "parked"), "node", "left")
    held = old.where(full & ~F.coalesce("parked", F.lit(False))).select(value().alias("value"), F.col("node").alias("owner"), F.col("round").alias("until"))
    new = plan.where(F.col("action") != "delete").where(full).select("node", "round", value().alias("value"))
    return new.join(held, "value").where((F.col("owner") != F.col("node")) & (F.col("until").isNull() | (F.col("until") >= F.col("round")))).select("node", "round")
