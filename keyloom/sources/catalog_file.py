"""Catalogs of tables as JSON files, the faults they can have, and what is run from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import closure

SCHEMA = "table_name string, syncable boolean, reasons array<string>, parents array<string>, fingerprint string"


def write_catalog(catalog: DataFrame, path: str) -> None:
    """One JSON object a table, in files that grow with the catalog. A folder that is there is never replaced."""
    catalog.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.option("ignoreNullFields", "false").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog that write_catalog wrote; a line that isn't one of its objects is an error."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def _edges(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.col("table_name").alias("child"), F.explode("parents").alias("parent")).where("child <> parent").distinct()


def faults(catalog: DataFrame) -> DataFrame:
    """table_name, fault: listed_twice, no_reason, reason_on_syncable, unknown_parent or parent_not_syncable; null names are `unnamed`.

    A table that is listed as syncable and as not, or repeated, is listed twice. Null reasons and parents count as none.
    """
    c = catalog.withColumns({"reasons": F.coalesce("reasons", F.array().cast("array<string>")), "parents": F.coalesce("parents", F.array().cast("array<string>"))})
    named = c.where("table_name is not null")
    twice = named.groupBy("table_name").agg(F.count("*").alias("n")).where("n > 1").select("table_name", F.lit("listed_twice").alias("fault"))
    own = F.array_compact(F.array(F.when(~F.col("syncable") & (F.size("reasons") == 0), "no_reason"), F.when(F.col("syncable") & (F.size("reasons") > 0), "reason_on_syncable")))
    own = named.select("table_name", F.explode(own).alias("fault"))
    state = named.groupBy(F.col("table_name").alias("parent")).agg(F.bool_and("syncable").alias("ok"))
    up = _edges(named).join(state, "parent", "left").join(named.groupBy(F.col("table_name").alias("child")).agg(F.bool_or("syncable").alias("mine")), "child")
    up = up.select(F.col("child").alias("table_name"), F.when(F.col("ok").isNull(), "unknown_parent").when(~F.col("ok") & F.col("mine"), "parent_not_syncable").alias("fault")).where("fault is not null").distinct()
    unnamed = c.where("table_name is null").select("table_name", F.lit("unnamed").alias("fault"))
    return twice.unionByName(own).unionByName(up).unionByName(unnamed)


def selection_faults(catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    """table_name, fault of chosen tables (table_name): unknown, not_syncable, or missing_parent if a parent isn't chosen too."""
    picked = chosen.select("table_name").distinct()
    state = catalog.groupBy("table_name").agg(F.bool_and("syncable").alias("ok"))
    found = picked.join(state, "table_name", "left")
    own = found.select("table_name", F.when(F.col("ok").isNull(), "unknown").when(~F.col("ok"), "not_syncable").alias("fault")).where("fault is not null")
    missing = closure.missing_parents(picked.select(F.col("table_name").alias("node")), _edges(catalog))
    return own.unionByName(missing.select(F.col("child").alias("table_name"), F.lit("missing_parent").alias("fault")).distinct())


def run_tables(catalog: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """table_name, round, spec: the syncable tables, parents in earlier rounds than their children, with each run's settings as JSON.

    The catalog must have no faults that touch syncable tables; a cycle of references is an error.
    """
    ok = catalog.where("syncable").select("table_name", "fingerprint")
    rounds = closure.require_acyclic(ok.select(F.col("table_name").alias("node")), _edges(catalog))
    spec = F.to_json(F.struct(F.col("table_name").alias("table"), F.lit(chunk_rows).alias("chunk_rows"), "fingerprint"))
    return ok.join(rounds.withColumnRenamed("node", "table_name"), "table_name").select("table_name", F.col("level").alias("round"), spec.alias("spec"))
