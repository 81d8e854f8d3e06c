"""Decoded log text as a source: lines with their event class and coordinate, and the statements in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.classify import line_class
from keyloom.session import materialise


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, n, line) of text files: n is the line's number in its file."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return raw


def _position() -> Column:
    return F.when(F.col("line").rlike(r"^\s*# at \d+"), F.regexp_extract("line", r"# at (\d+)", 1).cast("long"))


def _rotation() -> Column:
    return F.when(F.col("line").rlike("Rotate to ."), F.regexp_extract("line", r"Rotate to [\"'`]?([^\s,\"'`]+)", 1))


def classified(lines: DataFrame, first_file: str, first_pos: int = 4) -> DataFrame:
    """(source, n, line, class, file, pos): the class of each event line, the log file and position it belongs to.

    Positions and file names are carried forward within a source.
    """
    w = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumns({"_at": _position(), "_to": _rotation(), "class": line_class(F.col("line"))})
    return df.withColumns({"pos": F.coalesce(F.last("_at", True).over(w), F.lit(first_pos).cast("long")), "file": F.coalesce(F.last("_to", True).over(w), F.lit(first_file))}).drop("_at", "_to")


def events(lines: DataFrame, first_file: str) -> DataFrame:
    return classified(lines, first_file).where("class is not null")


def totals(lines: DataFrame, first_file: str) -> DataFrame:
    return events(lines, first_file).groupBy("class").agg(F.count("*").alias("events"))


def statements(lines: DataFrame, first_file: str) -> DataFrame:
    """(source, statement, file, pos, sql): lines that aren't comments, joined up to one that ends in a semicolon."""
    df = classified(lines, first_file).where(~F.col("line").rlike(r"^\s*(#|$)"))
    before = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("line").rlike(r";\s*$").cast("long")
    df = df.withColumn("statement", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return df.groupBy("source", "statement").agg(F.min_by("file", "n").alias("file"), F.min_by("pos", "n").alias("pos"), text.alias("sql"))


# --- files of any size -----------------------------------------------------------------------------------------------


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, n, line) of text files, read in splits: in a file, lines are in order of (block, n).

    block is where the line's split starts in the file; n grows within it, with gaps. A file may be as large as
    one likes, and spark.sql.files.maxPartitionBytes bounds a split. Lines end in \\n or \\r\\n.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return materialise(raw.select("source", "block", "n", F.regexp_replace("value", "\r$", "").alias("line")), "lines")


def carried(lines: DataFrame, **values: Column) -> DataFrame:
    """lines with the last non-null value of each expression at or before each line, across splits.

    A split is a window of its own; what it starts with comes from one row a split.
    """
    df = lines.withColumns({f"_v_{k}": v for k, v in values.items()})
    last = df.groupBy("source", "block").agg(*[F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col("n"))).alias(f"_l_{k}") for k in values])
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("source", "block", *[F.last(f"_l_{k}", True).over(before).alias(f"_b_{k}") for k in values])
    here = Window.partitionBy("source", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_h_{k}": F.last(f"_v_{k}", True).over(here) for k in values}).join(last, ["source", "block"])
    return df.withColumns({k: F.coalesce(f"_h_{k}", f"_b_{k}") for k in values}).drop(*[f"{p}{k}" for k in values for p in ("_v_", "_h_", "_b_")])


def split_classified(lines: DataFrame, first_file: str, first_pos: int = 4) -> DataFrame:
    """classified() for lines of split_lines."""
    df = carried(lines, _at=_position(), _to=_rotation()).withColumn("class", line_class(F.col("line")))
    return df.withColumns({"pos": F.coalesce("_at", F.lit(first_pos).cast("long")), "file": F.coalesce("_to", F.lit(first_file))}).drop("_at", "_to")


def split_statements(lines: DataFrame, first_file: str) -> DataFrame:
    """statements() for lines of split_lines: a statement may lie across any number of splits."""
    df = split_classified(lines, first_file).where(~F.col("line").rlike(r"^\s*(#|$)"))
    df = df.withColumn("_end", F.col("line").rlike(r";\s*$").cast("long"))
    ends = df.groupBy("source", "block").agg(F.sum("_end").alias("_ends"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("source", "block", F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy("source", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_here", F.coalesce(F.sum("_end").over(here), F.lit(0))).join(ends, ["source", "block"]).withColumn("statement", F.col("_here") + F.col("_before"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "line"))), lambda x: x["line"]), "\n")
    at = F.struct("block", "n")
    return df.groupBy("source", "statement").agg(F.min_by("file", at).alias("file"), F.min_by("pos", at).alias("pos"), text.alias("sql"))
