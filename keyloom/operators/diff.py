"""Three-way comparison of two keyed relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.keyset import key_order
from keyloom.plans.spec import TableSpec

EQUAL, MISSING_SOURCE, MISSING_TARGET, MISMATCH = "equal", "missing_source", "missing_target", "value_mismatch"


def differing(columns: list[str], a: str, b: str) -> Column:
    """Names of the columns whose values differ between two structs, nulls compared as values."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), F.lit(c)) for c in columns]).cast("array<string>"))


def compare(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """key, kind, source and target images (null where missing) and the differing columns of each key on either side.

    One full outer join on the key; a side that is missing is told by its marker, not by null values.
    Keys are unique on each side (see duplicate_keys) and a null key matches nothing.
    """
    side = lambda df, name: df.select(*spec.key, F.struct(*spec.writable).alias(name))
    both = side(source, "source").join(side(target, "target"), list(spec.key), "full_outer")
    changed = F.when(F.col("source").isNotNull() & F.col("target").isNotNull(), differing(spec.values, "source", "target")).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("changed", changed)
    kind = F.when(F.col("source").isNull(), MISSING_SOURCE).when(F.col("target").isNull(), MISSING_TARGET).when(F.size("changed") > 0, MISMATCH).otherwise(EQUAL)
    return both.withColumn("kind", kind)


def changes(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """Row changes that turn target into source: op I, U or D with before and after images."""
    op = F.when(F.col("kind") == MISSING_SOURCE, "D").when(F.col("kind") == MISSING_TARGET, "I").otherwise("U")
    d = compare(source, target, spec).where(F.col("kind") != EQUAL)
    return d.select(op.alias("op"), *spec.key, F.col("target").alias("before"), F.col("source").alias("after"), "changed")


def inserts(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    return source.join(target, list(spec.key), "left_anti")


def deletes(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    return target.join(source, list(spec.key), "left_anti").select(*spec.key)


def updates(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """Source rows whose key the target has with other values."""
    s, t = source.select(*spec.writable).alias("s"), target.select(*spec.writable).alias("t")
    same_key = [F.col(f"s.{c}") == F.col(f"t.{c}") for c in spec.key]
    other = reduce(lambda a, b: a | b, [~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in spec.values], F.lit(False))
    return s.join(t, same_key).where(other).select("s.*")


def windowed_compare(source: DataFrame, target: DataFrame, spec: TableSpec, limit: int) -> DataFrame:
    """Divergence of the first `limit` rows of each side on its own: rows past the other side's edge show as missing."""
    first = lambda df: df.orderBy(*key_order(spec)).limit(limit)
    return compare(first(source), first(target), spec)


def summary(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    return compare(source, target, spec).groupBy("kind").agg(F.count("*").alias("rows"))


def duplicate_keys(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.groupBy(*spec.key).agg(F.count("*").alias("copies")).where("copies > 1")


def same_key_set(expected: DataFrame, *sides: DataFrame) -> DataFrame:
    """Keys that one of the sides has too many or too few of; empty if all hold exactly the expected keys."""
    cols = expected.columns
    # One grouping of all sides with a bit for each; anti-joins would sort every side twice.
    flagged = [df.select(*cols, F.lit(1 << i).cast("long").alias("_in")) for i, df in enumerate((expected, *sides))]
    held = reduce(DataFrame.unionByName, flagged).groupBy(*cols).agg(F.bit_or("_in").alias("_in"))
    has = lambda i: F.col("_in").bitwiseAND(1 << i) != 0
    problem = lambda i: F.when(has(0) & ~has(i), "missing").when(~has(0) & has(i), "unexpected")
    found = F.array(*[F.struct(problem(i + 1).alias("problem"), F.lit(i).alias("side")) for i in range(len(sides))])
    return held.where(F.col("_in") != (2 << len(sides)) - 1).select(*cols, F.inline(found)).where("problem is not null")
