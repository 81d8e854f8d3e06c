"""Schema inventories as DataFrames: columns, keys, indexes, references, checks of a schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "table_name string, ordinal int, column_name string, column_type string, data_type string, nullable boolean, character_set string, collation string, default_value string, extra string, generated string"
KEYS = "table_name string, ordinal int, column_name string"
INDEXES = "table_name string, index_name string, is_unique boolean, index_type string, visible boolean, sequence int, column_name string, prefix_length int"
REFERENCES = "constraint_name string, child_schema string, child_table string, ordinal int, child_column string, parent_schema string, parent_table string, parent_column string"
RULES = "child_schema string, constraint_name string, child_table string, update_rule string, delete_rule string, match_option string"
CHECKS = "table_name string, check_name string, clause string"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def columns_of(df: DataFrame, table: str) -> DataFrame:
    """The columns of a relation from its schema; no data is read."""
    rows = [(table, i + 1, f.name, f.dataType.simpleString(), f.dataType.typeName(), f.nullable, None, None, None, "", None) for i, f in enumerate(df.schema.fields)]
    return frame(df.sparkSession, rows, COLUMNS)


def of_table(inventory: DataFrame, table: str | None) -> DataFrame:
    """An inventory scan, narrowed to one table if one is named."""
    return inventory if table is None else inventory.where(F.col("table_name") == table)


def ordered_columns(inventory: DataFrame) -> DataFrame:
    """Column names of each table in order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"])
    return inventory.groupBy("table_name").agg(names.alias("columns"))


def writable_columns(inventory: DataFrame) -> DataFrame:
    return ordered_columns(inventory.where("generated is null"))


def grouped_indexes(indexes: DataFrame) -> DataFrame:
    """A row an index with its columns in order; `consistent` is false if its rows disagree on kind or visibility, or leave a gap."""
    cols = F.array_sort(F.collect_list(F.struct("sequence", "column_name", "prefix_length")))
    g = indexes.groupBy("table_name", "index_name").agg(F.first("is_unique").alias("is_unique"), F.first("index_type").alias("index_type"), F.first("visible").alias("visible"), F.count_distinct("is_unique", "index_type", "visible").alias("kinds"), cols.alias("columns"))
    return g.withColumn("consistent", (F.col("kinds") == 1) & (F.element_at("columns", -1)["sequence"] == F.size("columns"))).drop("kinds")


def grouped_references(references: DataFrame, rules: DataFrame) -> DataFrame:
    """A row a reference, with update and delete rules (RESTRICT if none is known; NO ACTION is RESTRICT)."""
    from keyloom.functions.canonical import reference_rule

    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "child_column", "parent_column")))
    g = references.groupBy("child_schema", "child_table", "constraint_name").agg(pairs.alias("p"), F.first("parent_schema").alias("parent_schema"), F.first("parent_table").alias("parent_table"), F.count_distinct("parent_schema", "parent_table").alias("parents"))
    g = g.join(rules, ["child_schema", "child_table", "constraint_name"], "left")
    list_ = lambda f: F.array_join(F.transform("p", lambda x: x[f]), ",")
    return g.select("child_schema", "child_table", "constraint_name", list_("child_column").alias("child_columns"), "parent_schema", "parent_table", list_("parent_column").alias("parent_columns"),
                    reference_rule(F.coalesce("update_rule", F.lit("RESTRICT"))).alias("update_rule"), reference_rule(F.coalesce("delete_rule", F.lit("RESTRICT"))).alias("delete_rule"), F.coalesce("match_option", F.lit("NONE")).alias("match_option"), (F.col("parents") == 1).alias("consistent"))


def relative(schema, own: str):
    """A schema's name, with the inventory's own one under a common name."""
    return F.when(schema == own, F.lit("(own)")).otherwise(schema)


def dependency_edges(source: DataFrame, target: DataFrame, own_source: str, own_target: str) -> DataFrame:
    """(child, parent, cross_schema): references of both sides, each pair of tables once."""
    side = lambda df, own: df.select(F.col("child_table").alias("child"), F.col("parent_table").alias("parent"), (F.col("parent_schema") != own).alias("cross_schema"))
    return side(source, own_source).unionByName(side(target, own_target)).distinct()
