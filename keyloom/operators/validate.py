"""Counts, checksums and gates over two relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.encode import checksum, row_text
from keyloom.operators import diff
from keyloom.plans.spec import TableSpec


def table_checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: row_count and checksum. The order of rows doesn't matter; an empty relation gives 0 and 0."""
    return df.agg(F.count("*").alias("row_count"), checksum(row_text(df, columns)).alias("checksum"))


def bucket_checksums(df: DataFrame, columns: list[str], bucket: Column) -> DataFrame:
    """Row count and checksum of each bucket; partial folds are combined before the shuffle."""
    return df.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("row_count"), checksum(row_text(df, columns)).alias("checksum"))


def checksum_diff(source: DataFrame, target: DataFrame, columns: list[str], bucket: Column) -> DataFrame:
    """Buckets that one side lacks, or whose count or checksum differs."""
    s, t = (bucket_checksums(df, columns, bucket).withColumnsRenamed({"row_count": f"{n}_rows", "checksum": f"{n}_checksum"}) for df, n in ((source, "source"), (target, "target")))
    both = s.join(t, "bucket", "full_outer")
    return both.where(~(F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_checksum").eqNullSafe(F.col("target_checksum"))))


def count_compare(pairs: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(table_name, source_rows, target_rows, matches) for each named pair."""
    out = None
    for name, s, t in pairs:
        one = s.agg(F.count("*").alias("source_rows")).crossJoin(t.agg(F.count("*").alias("target_rows")))  # a row each
        one = one.select(F.lit(name).alias("table_name"), "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("matches"))
        out = one if out is None else out.unionByName(one)
    return out


def report(source: DataFrame, target: DataFrame, spec: TableSpec, columns: list[str], bucket: Column) -> DataFrame:
    """One row a table: do counts, bucket checksums and rows match, and do all of them."""
    counts = count_compare([(spec.name, source, target)])
    sums = checksum_diff(source, target, columns, bucket).agg(F.count("*").alias("checksum_diffs"))
    rows = diff.compare(source, target, spec).agg(F.count_if(F.col("kind") != diff.EQUAL).alias("divergences"))
    out = counts.crossJoin(sums).crossJoin(rows)  # a row each
    return out.withColumn("passed", F.col("matches") & (F.col("checksum_diffs") == 0) & (F.col("divergences") == 0))


def reports(tables: list[tuple]) -> DataFrame:
    out = None
    for t in tables:
        r = report(*t)
        out = r if out is None else out.unionByName(r)
    return out


def cutover_gate(validation: DataFrame, lag: Column, allowed_lag: int, quarantined: Column) -> DataFrame:
    """One row: may the switch start (lag within what is allowed), and did it pass (no lag at all)."""
    v = validation.agg(F.bool_and("passed").alias("validated"), F.count("*").alias("tables"))
    v = v.withColumns({"lag": lag, "quarantined": quarantined})
    clear = F.col("quarantined") == 0
    return v.withColumns({"may_switch": F.coalesce("validated", F.lit(False)) & clear & (F.col("lag") <= allowed_lag), "passed": F.coalesce("validated", F.lit(False)) & clear & (F.col("lag") == 0)})
