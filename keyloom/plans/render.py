"""Statements that turn one schema into another, rendered from inventories.

A row a statement: phase, table_name, object, statement, and needs, the objects that must be there first.
Objects are named by kind and name (`table:t`, `column:t.c`, `index:t.i`, `foreign_key:t.f`). Tables that only
the target has are left alone; columns that only it has are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.scalars import quote_literal, quote_name
from keyloom.plans.schema_plan import column_diff

DROP_CONSTRAINT, TABLE, COLUMN, INDEX, CONSTRAINT = range(5)


def _object(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.array_join(F.array(*parts), "."))


def _quoted(names: Column) -> Column:
    """A list of names (array of strings) in parentheses."""
    return F.concat(F.lit("("), F.array_join(F.transform(names, quote_name), ", "), F.lit(")"))


def column_definition(prefix: str = "") -> Column:
    """Name, type, character set, generation or default, nullability and extra of an inventory row."""
    c = lambda n: F.col(prefix + n)
    opt = lambda name, text: F.when(c(name).isNotNull() & (c(name) != ""), text).otherwise("")
    now = F.lower(c("default_value")).startswith("current_timestamp")
    default = F.when(c("default_value").isNull(), "").otherwise(F.concat(F.lit(" DEFAULT "), F.when(now, c("default_value")).otherwise(quote_literal(c("default_value")))))
    extra = F.btrim(F.regexp_replace(F.upper(F.coalesce(c("extra"), F.lit(""))), "DEFAULT_GENERATED", ""))
    stored = F.when(extra.contains("STORED"), " STORED").otherwise(" VIRTUAL")
    generated = c("generated").isNotNull() & (c("generated") != "")
    null = F.when(c("nullable"), " NULL").otherwise(" NOT NULL")
    own = F.concat(null, default, F.when(extra == "", "").otherwise(F.concat(F.lit(" "), extra)))
    charset = F.concat(opt("character_set", F.concat(F.lit(" CHARACTER SET "), c("character_set"))), opt("collation", F.concat(F.lit(" COLLATE "), c("collation"))))
    made = F.concat(F.lit(" GENERATED ALWAYS AS ("), c("generated"), F.lit(")"), stored, null)
    return F.concat(quote_name(c("column_name")), F.lit(" "), c("column_type"), charset, F.when(generated, made).otherwise(own))


def create_tables(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """A CREATE TABLE statement a table: its columns in order, then its key if it has one."""
    ordered = lambda df, value, name: df.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", value.alias("_v")))), lambda x: x["_v"]).alias(name))
    both = ordered(columns, column_definition(), "defs").join(ordered(keys, F.col("column_name"), "key"), "table_name", "left")
    parts = F.concat(F.col("defs"), F.when(F.col("key").isNotNull(), F.array(F.concat(F.lit("PRIMARY KEY "), _quoted(F.col("key"))))).otherwise(F.array().cast("array<string>")))
    text = F.concat(F.lit("CREATE TABLE "), quote_name(F.col("table_name")), F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))
    return both.select(F.lit(TABLE).alias("phase"), "table_name", _object("table", F.col("table_name")).alias("object"), text.alias("statement"), F.array().cast("array<string>").alias("needs"))


def column_statements(source: DataFrame, target: DataFrame, keys: DataFrame) -> DataFrame:
    """Tables to create, and columns to add, change or drop in tables that are there."""
    there = target.select("table_name").distinct()
    wanted = source.select("table_name").distinct()
    new = create_tables(source.join(there, "table_name", "left_anti"), keys)
    old = source.join(there, "table_name", "left_semi")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"])
    before = old.groupBy("table_name").agg(pairs.alias("names")).select("table_name", F.posexplode("names").alias("place", "column_name"), "names")
    before = before.select("table_name", "column_name", F.when(F.col("place") > 0, F.get("names", F.col("place") - 1)).alias("before"))
    change = column_diff(old, target.join(wanted, "table_name", "left_semi")).where("action <> 'same'").select("table_name", "column_name", "action")
    rows = change.join(old, ["table_name", "column_name"], "left").join(before, ["table_name", "column_name"], "left")
    place = F.when(F.col("before").isNull(), " FIRST").otherwise(F.concat(F.lit(" AFTER "), quote_name(F.col("before"))))
    what = (
        F.when(F.col("action") == "drop", F.concat(F.lit("DROP COLUMN "), quote_name(F.col("column_name"))))
        .when(F.col("action") == "add", F.concat(F.lit("ADD COLUMN "), column_definition(), place))
        .otherwise(F.concat(F.lit("MODIFY COLUMN "), column_definition()))
    )
    text = F.concat(F.lit("ALTER TABLE "), quote_name(F.col("table_name")), F.lit(" "), what)
    behind = (F.col("action") == "add") & F.col("before").isNotNull()
    needs = F.when(behind, F.array(_object("column", F.col("table_name"), F.col("before")))).otherwise(F.array().cast("array<string>"))
    return new.unionByName(rows.select(F.lit(COLUMN).alias("phase"), "table_name", _object("column", F.col("table_name"), F.col("column_name")).alias("object"), text.alias("statement"), needs.alias("needs")))


def index_statements(diff: DataFrame) -> DataFrame:
    """diff: table_name, action (drop or create), index_name, is_unique, columns (array of column_name, prefix_length)."""
    part = lambda x: F.concat(quote_name(x["column_name"]), F.when(x["prefix_length"].isNotNull(), F.concat(F.lit("("), x["prefix_length"].cast("string"), F.lit(")"))).otherwise(""))
    kind = F.when(F.col("is_unique"), "ADD UNIQUE INDEX ").otherwise("ADD INDEX ")
    add = F.concat(kind, quote_name(F.col("index_name")), F.lit(" ("), F.array_join(F.transform("columns", part), ", "), F.lit(")"))
    what = F.when(F.col("action") == "drop", F.concat(F.lit("DROP INDEX "), quote_name(F.col("index_name")))).otherwise(add)
    needs = F.when(F.col("action") == "create", F.transform("columns", lambda x: F.concat(F.lit("column:"), F.col("table_name"), F.lit("."), x["column_name"]))).otherwise(F.array().cast("array<string>"))
    return diff.select(F.lit(INDEX).alias("phase"), "table_name", _object("index", F.col("table_name"), F.col("index_name")).alias("object"), F.concat(F.lit("ALTER TABLE "), quote_name(F.col("table_name")), F.lit(" "), what).alias("statement"), needs.alias("needs"))


def reference_statements(diff: DataFrame) -> DataFrame:
    """diff: table_name, action, constraint_name, child_columns, parent_table, parent_columns (arrays), update_rule, delete_rule."""
    add = F.concat(
        F.lit("ADD CONSTRAINT "), quote_name(F.col("constraint_name")), F.lit(" FOREIGN KEY "), _quoted(F.col("child_columns")), F.lit(" REFERENCES "), quote_name(F.col("parent_table")), F.lit(" "), _quoted(F.col("parent_columns")),
        F.lit(" ON UPDATE "), F.col("update_rule"), F.lit(" ON DELETE "), F.col("delete_rule"),
    )
    drop = F.col("action") == "drop"
    what = F.when(drop, F.concat(F.lit("DROP FOREIGN KEY "), quote_name(F.col("constraint_name")))).otherwise(add)
    needs = F.when(drop, F.array().cast("array<string>")).otherwise(F.array(_object("table", F.col("parent_table"))))
    return diff.select(F.when(drop, DROP_CONSTRAINT).otherwise(CONSTRAINT).alias("phase"), "table_name", _object("foreign_key", F.col("table_name"), F.col("constraint_name")).alias("object"), F.concat(F.lit("ALTER TABLE "), quote_name(F.col("table_name")), F.lit(" "), what).alias("statement"), needs.alias("needs"))


def statements(*parts: DataFrame) -> DataFrame:
    """All statements with their place: by phase, then table and object."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("place", F.struct("phase", "table_name", "object"))
