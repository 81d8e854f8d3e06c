"""Runtime figures of tables from the footers of their Parquet files: rows, least and largest key, bytes. No data is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets the Parquet source answer counts, minima and maxima from footers.
_PUSHED = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": ""}


def footer_plan(spark: SparkSession, name: str, path: str, key: str) -> DataFrame:
    """One row: table_name, rows, least, largest. Only under the settings of table_runtime it is answered by footers."""
    t = spark.read.parquet(path).agg(F.count("*").alias("rows"), F.min(key).alias("least"), F.max(key).alias("largest"))
    return t.select(F.lit(name).alias("table_name"), "rows", F.col("least").cast("string").alias("least"), F.col("largest").cast("string").alias("largest"))


def table_runtime(spark: SparkSession, tables: dict[str, tuple[str, str]]) -> DataFrame:
    """table_name, rows, least, largest, bytes of each table (name: (path, key)); the key is a number or a date.

    Executors read the footers. Rows are exact where every file has its count, as Parquet files do; minima and
    maxima are null for an empty table. bytes is the size of the table's files, from their listing. The result is a
    row a table and complete on return.
    """
    before = {k: spark.conf.get(k, None) for k in _PUSHED}
    try:
        for k, v in _PUSHED.items():
            spark.conf.set(k, v)
        plans = [footer_plan(spark, name, path, key) for name, (path, key) in tables.items()]
        rows = [tuple(r) for r in reduce(DataFrame.unionByName, plans).collect()] if plans else []  # a row a table
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    size = {name: _bytes(spark, path) for name, (path, _) in tables.items()}
    # A table without row groups has no count in any footer.
    return spark.createDataFrame([(r[0], r[1] or 0, r[2], r[3], size[r[0]]) for r in rows], "table_name string, rows long, least string, largest string, bytes long")


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
