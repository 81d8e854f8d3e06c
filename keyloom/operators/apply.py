"""Apply ordered row changes to a keyed target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.diff import differing
from keyloom.plans.spec import TableSpec


def normalise(log: DataFrame, spec: TableSpec) -> DataFrame:
    """Log rows (coord, op, before, after) as single-key changes (key columns, coord, step, op, row).

    Updates without a changed column go. An update that changes the key becomes the delete of the old
    key and the insert of the new one, in this order.
    """
    moved = reduce(lambda a, b: a | b, [~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")) for c in spec.key])
    log = log.where((F.col("op") != "U") | (F.size(differing(spec.writable, "before", "after")) > 0))
    one = lambda step, op, image: F.struct(F.lit(step).alias("step"), F.lit(op).alias("op"), F.col(image).alias("row"))
    steps = (
        F.when(F.col("op") == "D", F.array(one(0, "D", "before")))
        .when(F.col("op") == "I", F.array(one(0, "I", "after")))
        .when(moved, F.array(one(0, "D", "before"), one(1, "I", "after")))
        .otherwise(F.array(one(0, "U", "after")))
    )
    out = log.select("coord", F.explode(steps).alias("s")).select("coord", "s.*")
    return out.select(*[F.col(f"row.{c}").alias(c) for c in spec.key], F.struct("coord", "step").alias("at"), "op", "row")


def apply_log(target: DataFrame, log: DataFrame, spec: TableSpec, on_duplicate: str = "ignore") -> DataFrame:
    """The target after all changes of the log, applied in order of coord.

    An insert of a present key keeps the present row (on_duplicate="ignore") or fails ("error"); updates
    and deletes of absent keys do nothing. Nothing is replayed row by row: for each key the last delete,
    the first insert behind it and the last update behind that decide, three aggregations that combine
    before their shuffle. Between them steps are joined with one row a key; where one key has very many
    steps, they meet in the tasks of that key, as many as adaptive execution splits it into.
    """
    if on_duplicate not in ("ignore", "error"):
        raise ValueError("on_duplicate is ignore or error")
    key = list(spec.key)
    steps = normalise(log, spec)
    cut = steps.groupBy(*key).agg(F.max(F.when(F.col("op") == "D", F.col("at"))).alias("cut"))
    live = steps.join(cut, key).where(F.col("cut").isNull() | (F.col("at") > F.col("cut")))
    born = live.where("op = 'I'").groupBy(*key).agg(F.min_by("row", "at").alias("first"), F.min("at").alias("born"), F.count("*").alias("inserts"))
    present = target.select(*key, F.struct(*spec.writable).alias("old"))
    base = cut.join(present, key, "left").join(born, key, "left")
    held = F.col("cut").isNull() & F.col("old").isNotNull()
    base = base.withColumns({"held": held, "start": F.when(~held, F.col("born"))})
    if on_duplicate == "error":
        again = (F.col("held") & (F.coalesce("inserts", F.lit(0)) > 0)) | (F.coalesce("inserts", F.lit(0)) > 1)
        base = base.withColumn("held", F.when(again, F.raise_error(F.lit("duplicate insert"))).otherwise(F.col("held")).cast("boolean"))
    edits = live.where("op = 'U'").join(base.select(*key, "held", "start"), key).where(F.col("held") | (F.col("at") > F.col("start")))
    last = edits.groupBy(*key).agg(F.max_by("row", "at").alias("last"))
    result = base.join(last, key, "left").select(*key, F.coalesce("last", F.when(F.col("held"), F.col("old")).otherwise(F.col("first"))).alias("row")).where("row is not null")
    untouched = target.select(*spec.writable).join(cut.select(*key), key, "left_anti")
    return untouched.select(*spec.writable).unionByName(result.select("row.*").select(*spec.writable))


def apply_changes(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """The target after unordered changes with one row a key, as diff.changes gives them."""
    key = list(spec.key)
    kept = target.select(*spec.writable).join(changes.select(*key), key, "left_anti").select(*spec.writable)
    return kept.unionByName(changes.where("op <> 'D'").select("after.*").select(*spec.writable))


def compact(log: DataFrame, spec: TableSpec) -> DataFrame:
    """Last change of each key: what is left to do if images are full."""
    return normalise(log, spec).groupBy(*spec.key).agg(F.max_by(F.struct("op", "row"), "at").alias("c"), F.count("*").alias("changes")).select(*spec.key, "c.op", "c.row", "changes")


def split_full_images(log: DataFrame, present: str = "present") -> tuple[DataFrame, DataFrame]:
    """(rows whose image has all columns, rows whose image misses one or doesn't say)."""
    full = F.coalesce(F.forall(F.col(present), lambda x: x), F.lit(False))
    return log.where(full), log.where(~full)


def require_full_images(log: DataFrame, present: str = "present") -> DataFrame:
    """Fail on a row whose image misses a column."""
    full = F.forall(F.col(present), lambda x: x)
    return log.where(F.when(full, F.lit(True)).otherwise(F.raise_error(F.lit("a row image lacks columns")).cast("boolean")))


def strict_inserts(target: DataFrame, rows: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(rows that can be inserted, rows whose key or whose unique values the target holds)."""
    taken = rows.join(target.select(*spec.key), list(spec.key), "left_semi")
    return rows.join(target.select(*spec.key), list(spec.key), "left_anti"), taken


def verify_rows(actual: DataFrame, expected: DataFrame, spec: TableSpec) -> DataFrame:
    """Expected rows that the actual relation lacks or holds with other values; empty if all are exact."""
    same: Column = reduce(lambda a, b: a & b, [F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")) for c in spec.writable])
    e, a = expected.select(*spec.writable).alias("e"), actual.select(*spec.writable).alias("a")
    return e.join(a, same, "left_anti")
