"""Referential integrity and unique owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.spec import TableSpec


def _pairs(a: str, columns, b: str, others) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{d}") for c, d in zip(columns, others)])


def orphans(child: DataFrame, columns, parent: DataFrame, parent_columns) -> DataFrame:
    """Child rows whose reference, null in no column, has no parent."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    keys = parent.select(*parent_columns)
    return child.where(full).alias("c").join(keys.alias("p"), _pairs("c", columns, "p", parent_columns), "left_anti")


def parent_repair(child: DataFrame, columns, target_parent: DataFrame, source_parent: DataFrame, parent_columns) -> DataFrame:
    """Parents to copy from the source for children whose parent the target lacks; needs unique parent columns."""
    missing = orphans(child, columns, target_parent, parent_columns).select(*[F.col(c).alias(d) for c, d in zip(columns, parent_columns)]).distinct()
    return source_parent.join(missing, list(parent_columns), "left_semi")


def nested_repair(rows: DataFrame, chain: list[tuple], depth: int = 8) -> list[DataFrame]:
    """Parents to insert for rows, level by level along a chain of references, outermost ancestors first.

    chain: (columns, target parent, source parent, parent columns) from the child upwards. A set at each
    level, not a walk for each row. More levels than depth, or a table met twice, are refused.
    """
    if len(chain) > depth:
        raise ValueError(f"a repair of {len(chain)} levels is deeper than {depth}")
    out, child = [], rows
    for columns, target, source, parent_columns in chain:
        child = parent_repair(child, columns, target, source, parent_columns)
        out.insert(0, child)
    return out


def unique_conflicts(rows: DataFrame, target: DataFrame, spec: TableSpec, unique) -> DataFrame:
    """For each row to insert whose unique values (none null) another key of the target owns: both keys."""
    keys = [F.col(f"r.{c}").alias(c) for c in spec.key] + [F.col(f"t.{c}").alias(f"owner_{c}") for c in spec.key] + [F.col(f"r.{c}").alias(c) for c in unique if c not in spec.key]
    other = ~reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in spec.key])
    return rows.alias("r").join(target.alias("t"), _pairs("r", unique, "t", unique)).where(other).select(*keys)


def owner_actions(conflicts: DataFrame, source: DataFrame, spec: TableSpec) -> DataFrame:
    """What to do with each owner: update it to its source row, or delete it if the source has none."""
    s = source.select(*[F.col(c).alias(f"owner_{c}") for c in spec.key], F.struct(*spec.writable).alias("source_row"))
    owners = conflicts.select(*[f"owner_{c}" for c in spec.key]).distinct()
    return owners.join(s, [f"owner_{c}" for c in spec.key], "left").withColumn("action", F.when(F.col("source_row").isNull(), "delete").otherwise("update"))


def superseded(inserts: DataFrame, source: DataFrame, spec: TableSpec, columns) -> DataFrame:
    """Historical inserts whose parent is gone, judged by the current source row of the same key:
    `skip` if there is none, `fail` if its reference is still the same, `use_current` if it has changed."""
    s = source.select(*spec.key, F.struct(*spec.writable).alias("current"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"current.{c}")) for c in columns])
    out = inserts.join(s, list(spec.key), "left")
    return out.withColumn("decision", F.when(F.col("current").isNull(), "skip").when(same, "fail").otherwise("use_current"))


def conflict_resolution(ledger: DataFrame, source: DataFrame, target: DataFrame, spec: TableSpec, parents: list[tuple] = ()) -> DataFrame:
    """One row: unresolved conflicts, keys whose rows aren't equal on both sides (children, then parents),
    and whether all may be resolved. Text values compare without a trailing .000000.

    parents: (child columns, source parent, target parent, parent spec).
    """
    keys = ledger.where("status = 'unresolved'").select(*spec.key)
    again = keys.groupBy(*spec.key).count().where("count > 1")
    total = keys.agg(F.count("*").alias("unresolved"))
    bad = unequal(keys.distinct(), source, target, spec).agg(F.count("*").alias("unequal_children"))
    children = source.join(keys, list(spec.key), "left_semi")
    out = total.crossJoin(bad).crossJoin(again.agg(F.count("*").alias("repeated")))  # a row each
    counts = None
    for columns, s, t, parent in parents:
        wanted = children.select(*[F.col(c).alias(p) for c, p in zip(columns, parent.key)]).dropna().distinct()
        one = unequal(wanted, s, t, parent).agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.unionAll(one)
    out = out.crossJoin(counts.agg(F.sum("n").alias("unequal_parents"))) if counts is not None else out.withColumn("unequal_parents", F.lit(0).cast("long"))
    return out.withColumn("resolve", (F.col("unresolved") > 0) & (F.col("unequal_children") == 0) & (F.col("unequal_parents") == 0) & (F.col("repeated") == 0))


def unequal(keys: DataFrame, source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys that aren't on both sides with equal values."""
    text = lambda c: F.regexp_replace(c.cast("string"), r"\.000000$", "")
    image = lambda df, n: df.select(*spec.key, F.struct(*[text(F.col(c)).alias(c) for c in spec.writable]).alias(n))
    both = keys.join(image(source, "s"), list(spec.key), "left").join(image(target, "t"), list(spec.key), "left")
    return both.where(F.col("s").isNull() | F.col("t").isNull() | ~F.col("s").eqNullSafe(F.col("t"))).select(*spec.key)
