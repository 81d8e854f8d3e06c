"""Schema differences, compatibility, lossless-conversion checks and convergence plans over inventories."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import canonical as C

ATTRIBUTES = ["column_type", "nullable", "character_set", "collation", "default_value", "extra", "generated"]


def canonical_columns(inventory: DataFrame) -> DataFrame:
    return inventory.withColumns({
        "column_type": C.column_type(F.col("column_type")),
        "data_type": F.lower("data_type"),
        "default_value": C.default_value(F.col("default_value")),
        "extra": C.extra(F.col("extra")),
        "collation": C.collation(F.col("collation")),
        "generated": C.expression(F.col("generated")),
    })


def column_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(table_name, column_name, action, attributes): add, drop, modify or same, with what differs."""
    side = lambda df, n: canonical_columns(df).select("table_name", "column_name", F.struct("ordinal", *ATTRIBUTES).alias(n))
    both = side(source, "s").join(side(target, "t"), ["table_name", "column_name"], "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"s.{a}").eqNullSafe(F.col(f"t.{a}")), F.lit(a)) for a in ATTRIBUTES]).cast("array<string>"))
    action = F.when(F.col("t").isNull(), "add").when(F.col("s").isNull(), "drop").when(F.size(differs) > 0, "modify").otherwise("same")
    return both.select("table_name", "column_name", action.alias("action"), F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), F.array_join(differs, ",")).otherwise("").alias("attributes"))


def _number(t: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.lower(t), pattern, group).try_cast("int")


def needs_preflight(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns on both sides, and whether their data must be looked at before the target's is converted."""
    a, b = (df.select("table_name", "column_name", F.struct("column_type", "data_type", "nullable", "character_set", "collation", "generated", "default_value", "extra").alias(n)) for df, n in ((source, "s"), (target, "t")))
    canon = column_diff(source, target).select("table_name", "column_name", "action")
    both = a.join(b, ["table_name", "column_name"]).join(canon, ["table_name", "column_name"])
    s, t = (lambda f: F.col(f"s.{f}")), (lambda f: F.col(f"t.{f}"))
    ds, dt = C.data_type(s("data_type")), C.data_type(t("data_type"))
    rs, rt = C.integer_rank(ds), C.integer_rank(dt)
    sign = C.is_signed(s("column_type")) != C.is_signed(t("column_type"))
    length = lambda f: _number(f("column_type"), r"^varchar\((\d+)\)$")
    prec, scale = (lambda f: _number(f("column_type"), r"^decimal\((\d+),\s*(\d+)\)$")), (lambda f: _number(f("column_type"), r"^decimal\((\d+),\s*(\d+)\)$", 2))
    same_type = (
        F.when(~s("character_set").eqNullSafe(t("character_set")) | ~C.collation(s("collation")).eqNullSafe(C.collation(t("collation"))), True)
        .when(length(s).isNotNull() & length(t).isNotNull(), length(s) < length(t))
        .when(rs > 0, sign)
        .when(ds == "decimal", F.coalesce((prec(s) - scale(s) < prec(t) - scale(t)) | (scale(s) < scale(t)), F.lit(True)))
        .otherwise(~((F.lower(s("data_type")) == "timestamp") & (F.lower(t("data_type")) == "datetime")) & (F.lower(s("column_type")) != F.lower(t("column_type"))))
    )
    needed = (
        F.when(F.col("action") == "same", False)
        .when(~s("generated").eqNullSafe(t("generated")), True)
        .when(t("nullable") & ~s("nullable"), True)
        .when(ds == dt, same_type)
        .when((rs > 0) & (rt > 0), sign | (rs < rt))
        .otherwise(True)
    )
    return both.select("table_name", "column_name", needed.alias("needs_preflight"))


# --- conversions of data ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnType:
    """Declared type of a column, as in an inventory."""

    name: str
    type: str
    nullable: bool = True
    charset: str | None = None
    generated: str | None = None

    @property
    def base(self) -> str:
        t = re.match(r"\s*(\w+)", self.type.lower())[1]
        return {"timestamp": "datetime", "integer": "int"}.get(t, t)

    @property
    def unsigned(self) -> bool:
        return "unsigned" in self.type.lower().split()

    def params(self) -> list[int]:
        m = re.search(r"\(([\d, ]+)\)", self.type)
        return [int(x) for x in m[1].split(",")] if m else []


def integer_range(c: ColumnType) -> tuple[int, int]:
    bits = {"tinyint": 8, "smallint": 16, "mediumint": 24, "int": 32, "bigint": 64}[c.base]
    return (0, (1 << bits) - 1) if c.unsigned else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)


def blocker(source: ColumnType, target: ColumnType, col: Column | None = None) -> Column:
    """True for target values that the source's type can't hold; for conversions that can't be judged, true for all."""
    c = F.col(source.name) if col is None else col
    if source.generated != target.generated or source.charset != target.charset:
        return F.lit(True)
    tests = []
    if target.nullable and not source.nullable:
        tests.append(c.isNull())
    integers = ("tinyint", "smallint", "mediumint", "int", "bigint")
    if source.base == target.base == "varchar":
        if not source.params() or not target.params():
            return F.lit(True)
        if source.params()[0] < target.params()[0]:
            tests.append(F.char_length(c) > source.params()[0])
    elif source.base in integers and target.base in integers:
        low, high = (F.lit(str(x)).cast("decimal(20,0)") for x in integer_range(source))
        wide = c.cast("decimal(20,0)")
        tests.append((wide < low) | (wide > high))
    elif source.base == target.base == "decimal":
        if len(source.params()) != 2:
            return F.lit(True)
        p, s = source.params()
        top = F.lit("9" * (p - s) + ("." + "9" * s if s else "")).cast("decimal(38,10)")
        tests.append((c < -top) | (c > top) | (c != F.round(c, s)))
    elif source.base != target.base:
        return F.lit(True)
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(True)


def preflight(df: DataFrame, pairs: list[tuple[ColumnType, ColumnType]]) -> DataFrame:
    """(column_name, blockers, verdict) of all conversions in one pass over the data."""
    counts = df.agg(*[F.count_if(blocker(s, t)).alias(s.name) for s, t in pairs])
    cols = F.array(*[F.struct(F.lit(s.name).alias("column_name"), F.col(s.name).alias("blockers")) for s, _ in pairs])
    out = counts.select(F.inline(cols))
    return out.withColumn("verdict", F.when(F.col("blockers") > 0, "blocked").otherwise("passed"))


def samples(df: DataFrame, key: list[str], source: ColumnType, target: ColumnType, limit: int = 10) -> DataFrame:
    """Keys of the first rows that block a conversion."""
    return df.where(blocker(source, target)).select(*key).orderBy(*key).limit(limit)


# --- tables ------------------------------------------------------------------------------------------


def compatible(source: DataFrame, target: DataFrame, source_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """(table_name, compatible) of tables on both sides: equal keys, and written columns that pair up in order
    by name, each of which the target can hold."""
    from keyloom.sources.inventory import ordered_columns

    pos = lambda df: df.where("generated is null").withColumn("place", F.expr("row_number() over (partition by table_name order by ordinal)"))
    attrs = ["column_name", "column_type", "data_type", "nullable", "character_set", "collation"]
    s, t = (pos(df).select("table_name", "place", F.struct(*attrs).alias(n)) for df, n in ((source, "s"), (target, "t")))
    both_tables = source.select("table_name").distinct().join(target.select("table_name").distinct(), "table_name")
    cols = s.join(t, ["table_name", "place"], "full_outer").join(both_tables, "table_name", "left_semi")
    a, b = (lambda f: F.col(f"s.{f}")), (lambda f: F.col(f"t.{f}"))
    ra, rb = C.integer_rank(a("data_type")), C.integer_rank(b("data_type"))
    signs = C.is_signed(a("column_type")) == C.is_signed(b("column_type"))
    kind = (
        F.when(a("data_type") == b("data_type"), F.when(ra > 0, signs).when(a("data_type").isin("char", "varchar", "binary", "varbinary"), C.capacity(b("column_type")) >= C.capacity(a("column_type"))).otherwise(a("column_type") == b("column_type")))
        .otherwise((ra > 0) & (rb >= ra) & signs)
    )
    ok = (a("column_name") == b("column_name")) & ~(a("nullable") & ~b("nullable")) & a("character_set").eqNullSafe(b("character_set")) & C.collation(a("collation")).eqNullSafe(C.collation(b("collation"))) & kind
    fits = cols.groupBy("table_name").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("fit"))
    keys = ordered_columns(source_keys).withColumnRenamed("columns", "sk").join(ordered_columns(target_keys).withColumnRenamed("columns", "tk"), "table_name", "full_outer")
    out = fits.join(keys, "table_name", "left")
    return out.select("table_name", (F.col("fit") & F.col("sk").eqNullSafe(F.col("tk"))).alias("compatible"))


def object_diff(source: DataFrame, target: DataFrame, identity: list[str], shown: list[str]) -> DataFrame:
    """Objects to drop (the source has no equal one) and to create (the target has none), by value of all columns."""
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in identity])
    only = lambda x, y, action: x.select(*dict.fromkeys(identity + shown)).alias("a").join(y.select(*identity).alias("b"), same, "left_anti").select(F.lit(action).alias("action"), *shown)
    return only(target, source, "drop").unionByName(only(source, target, "create"))


def plan(columns: DataFrame, indexes: DataFrame, references: DataFrame, checks: DataFrame) -> DataFrame:
    """(phase, table_name, action, kind, name): constraint drops first, then columns, indexes, and constraints last.

    Inputs are diffs with action, table_name and name. Phases up to 2 are the prerequisite stage, 3 the final one.
    """
    kind = lambda df, k: df.select("table_name", "action", F.lit(k).alias("kind"), "name")
    all_ = kind(columns, "column").unionByName(kind(indexes, "index")).unionByName(kind(references, "foreign_key")).unionByName(kind(checks, "check")).where("action <> 'same'")
    constraint = F.col("kind").isin("foreign_key", "check")
    phase = F.when(constraint & (F.col("action") == "drop"), 0).when(F.col("kind") == "column", 1).when(F.col("kind") == "index", 2).otherwise(3)
    return all_.select(phase.alias("phase"), "table_name", "action", "kind", "name")


def prerequisite_stage(p: DataFrame) -> DataFrame:
    return p.where("phase <= 2")


def final_stage(p: DataFrame) -> DataFrame:
    return p.where("phase = 3")


def status(reports: DataFrame) -> DataFrame:
    """One row: converged if all tables are, failed if none is, else partial."""
    n, ok = F.count("*"), F.count_if(F.col("converged"))
    return reports.agg(F.when(ok == n, "converged").when(ok == 0, "failed").otherwise("partial").alias("status"), ok.alias("converged_tables"), n.alias("tables"))


def fingerprints(inventory: DataFrame) -> DataFrame:
    """SHA-256 of each table's canonical columns."""
    c = canonical_columns(inventory)
    parts = F.concat_ws("|", F.lpad(F.col("ordinal").cast("string"), 5, "0"), "column_name", "column_type", F.col("nullable").cast("string"), F.coalesce("collation", F.lit("-")), F.coalesce("default_value", F.lit("-")), "extra", F.coalesce("generated", F.lit("-")))
    return c.groupBy("table_name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256).alias("fingerprint"))


# --- states after a change ----------------------------------------------------------------------------


@dataclass(frozen=True)
class TableState:
    """Columns of a table in order, and its indexes by name."""

    columns: tuple[tuple[str, str], ...]
    indexes: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def _place(self, name: str) -> int:
        return next((i for i, (c, _) in enumerate(self.columns) if c.lower() == name.lower()), -1)

    def at(self, name: str) -> int:
        """Place of a column, found without regard to case; -1 if it isn't there."""
        return self._place(name)

    def move_column(self, name: str, after: str | None, first: bool) -> TableState:
        at = self._place(name)
        rest = (*self.columns[:at], *self.columns[at + 1 :])
        to = 0 if first else next((i for i, (c, _) in enumerate(rest) if c.lower() == after.lower()), -1) + 1
        if not first and to == 0:
            raise ValueError(f"no column {after}")
        return replace(self, columns=(*rest[:to], self.columns[at], *rest[to:]))

    def rename_index(self, old: str, new: str) -> TableState:
        return replace(self, indexes=tuple(sorted((new if n == old else n, c) for n, c in self.indexes)))

    def add_column(self, name: str, type_: str, after: str | None = None, first: bool = False) -> TableState:
        if self._place(name) >= 0:
            raise ValueError(f"column {name} is there already")
        at = 0 if first else len(self.columns) if after is None else self._place(after) + 1
        if after is not None and at == 0:
            raise ValueError(f"no column {after}")
        return replace(self, columns=(*self.columns[:at], (name, type_), *self.columns[at:]))

    def drop_column(self, name: str, if_exists: bool = False) -> TableState:
        at = self._place(name)
        if at < 0:
            if if_exists:
                return self
            raise ValueError(f"no column {name}")
        kept = tuple((n, rest) for n, c in self.indexes if (rest := tuple(x for x in c if x.lower() != name.lower())))
        return TableState((*self.columns[:at], *self.columns[at + 1 :]), kept)

    def rename_column(self, old: str, new: str, if_exists: bool = False) -> TableState:
        at, there = self._place(old), self._place(new)
        if at < 0:
            if if_exists:
                return self
            raise ValueError(f"no column {old}")
        if there >= 0 and there != at:
            raise ValueError(f"both {old} and {new} are there")
        fix = lambda c: new if c.lower() == old.lower() else c
        return TableState(tuple((fix(c), t) for c, t in self.columns), tuple((n, tuple(map(fix, c))) for n, c in self.indexes))

    def modify_column(self, name: str, type_: str) -> TableState:
        at = self._place(name)
        if at < 0:
            raise ValueError(f"no column {name}")
        return replace(self, columns=(*self.columns[:at], (self.columns[at][0], type_), *self.columns[at + 1 :]))

    def create_index(self, name: str, columns: tuple[str, ...]) -> TableState:
        if any(n == name for n, _ in self.indexes) or any(self._place(c) < 0 for c in columns):
            raise ValueError(f"index {name} can't be made")
        return replace(self, indexes=tuple(sorted((*self.indexes, (name, columns)))))

    def drop_index(self, name: str, references: tuple[tuple[str, ...], ...] = ()) -> TableState:
        found = dict(self.indexes).get(name)
        if found is None:
            raise ValueError(f"no index {name}")
        rest = [c for n, c in self.indexes if n != name]
        if any(found[: len(r)] == r and not any(c[: len(r)] == r for c in rest) for r in references):
            raise ValueError(f"index {name} supports a foreign key")
        return replace(self, indexes=tuple(x for x in self.indexes if x[0] != name))

    def rows(self, table: str) -> list[tuple]:
        return [(table, i + 1, c, t) for i, (c, t) in enumerate(self.columns)]
