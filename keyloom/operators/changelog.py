"""Order in a change log: coordinates, running values, transactions, schemas as of a position, bounded stops.

A log is rows (file, pos, ...) whose order is (number of the file, pos). Running values are computed
within each file and carried over from the files before, whose totals are one row a file, so a long log
isn't sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_number(file: Column) -> Column:
    """Numeric suffix of a log file's name; null without one."""
    return F.when(file.rlike(r"\.\d+$"), F.regexp_extract(file, r"\.(\d+)$", 1).cast("long"))


def coordinate(file: Column, pos: Column) -> Column:
    return F.struct(file_number(file).alias("file"), pos.cast("long").alias("pos"))


def _files(df: DataFrame, **totals: Column) -> DataFrame:
    return df.groupBy("_f").agg(*[c.alias(n) for n, c in totals.items()])


def transaction_ids(log: DataFrame, closes: Column) -> DataFrame:
    """txn: one more than the number of closing events before a row; the closing event belongs to its transaction."""
    df = log.withColumns({"_f": file_number(F.col("file")), "_x": closes.cast("long")})
    total = _files(df, _t=F.sum("_x")).withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = F.coalesce(F.sum("_x").over(Window.partitionBy("_f").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_r", running).join(total.select("_f", "_before"), "_f").withColumn("txn", F.col("_r") + F.col("_before") + 1).drop("_f", "_x", "_r", "_before")


def transaction_groups(df: DataFrame, size: int) -> DataFrame:
    """group: transactions in groups of `size` that are committed together."""
    if size < 1:
        raise ValueError("a group has a transaction or more")
    return df.withColumn("group", F.floor((F.col("txn") - 1) / size).cast("long"))


def group_cut(log: DataFrame, closes: str, rotates: str, size: int) -> DataFrame:
    """One row, cut: the coordinate up to which whole groups of `size` transactions lie; null if none is whole.

    log: file, pos, coord and two flags. A row with closes ends its transaction, one with rotates ends a group
    however many transactions it has, and counting starts again behind it.
    """
    turn = log.agg(F.max(F.when(F.col(rotates), F.col("coord"))).alias("_turn"))  # a row
    ends = log.where(closes).select("file", "pos", "coord").join(F.broadcast(turn), F.col("_turn").isNull() | (F.col("coord") > F.col("_turn")))
    whole = transaction_ids(ends, F.lit(True)).where(F.col("txn") % size == 0).agg(F.max("coord").alias("_whole"))
    return whole.join(F.broadcast(turn)).select(F.greatest("_whole", "_turn").alias("cut"))


def carried(log: DataFrame, value: Column, name: str) -> DataFrame:
    """name: the last non-null value at or before each row, across files."""
    df = log.withColumns({"_f": file_number(F.col("file")), "_v": value})
    last = _files(df, _l=F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("pos")))).withColumn("_before", F.last("_l", True).over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)))
    here = F.last("_v", True).over(Window.partitionBy("_f").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_h", here).join(last.select("_f", "_before"), "_f").withColumn(name, F.coalesce("_h", "_before")).drop("_f", "_v", "_h", "_before")


def previous_end(log: DataFrame) -> DataFrame:
    """start_pos: end of the event before in the same file, 4 at a file's start."""
    return log.withColumn("start_pos", F.coalesce(F.lag("pos").over(Window.partitionBy("file").orderBy("pos")), F.lit(4).cast("long")))


def schema_as_of(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """rows with the latest map of their table_id at or before their coordinate (null if there is none).

    Both are laid in one stream and the last map is carried forward, by table and log file; what a file
    starts with comes from the last maps of the files before, one row a table and file. So neither a
    range join nor a task that holds all of a busy table is needed.
    """
    both = rows.withColumn("_map", F.lit(None).cast(maps.schema["map"].dataType)).withColumn("_row", F.lit(True)).unionByName(maps.select("table_id", "coord", F.col("map").alias("_map")).withColumn("_row", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_f", F.col("coord.file"))
    w = Window.partitionBy("table_id", "_f").orderBy("coord", "_row").rowsBetween(Window.unboundedPreceding, 0)
    files = both.groupBy("table_id", "_f").agg(F.max_by("_map", F.when(~F.col("_row"), F.col("coord"))).alias("_l"))
    before = files.withColumn("_before", F.last("_l", True).over(Window.partitionBy("table_id").orderBy("_f").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("table_id").alias("_t"), F.col("_f").alias("_g"), "_before")
    here = both.withColumn("_h", F.last("_map", True).over(w)).where("_row")
    joined = here.join(before, F.col("table_id").eqNullSafe(F.col("_t")) & F.col("_f").eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("map", F.coalesce("_h", "_before")).drop("_map", "_row", "_f", "_h", "_t", "_g", "_before")


def split_known(rows: DataFrame, width: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose map has as many columns as the row, rows that are skipped: no map or another width)."""
    ok = F.col("map").isNotNull() & (F.size("map") == width)
    return rows.where(ok), rows.where(~F.coalesce(ok, F.lit(False)))


def bounded_stop(log: DataFrame, stop: int, file: int | None = None) -> DataFrame:
    """One row with the decision on an inclusive stop position: events applied and `outcome`:
    reached, inside_event, inside_transaction or not_reached. log: pos (end), start_pos, event_type.
    With the number of a file the stop lies in that file, and log has file too and may hold many files."""
    here = F.lit(True) if file is None else file_number(F.col("file")) == file
    at = F.col("pos") if file is None else coordinate(F.col("file"), F.col("pos"))
    end = F.lit(stop) if file is None else F.struct(F.lit(file).cast("long").alias("file"), F.lit(stop).cast("long").alias("pos"))
    facts = log.agg(
        F.count_if(at <= end).alias("applied"),
        F.bool_or(at == end).alias("hit"),
        F.bool_or(here & (F.col("start_pos") < stop) & (F.col("pos") > stop)).alias("inside"),
        F.max_by(F.when(F.col("event_type").isin("rows", "commit"), F.col("event_type")), F.when(F.col("event_type").isin("rows", "commit") & (at <= end), at)).alias("last"),
    )
    outcome = F.when(F.col("hit") & (F.coalesce("last", F.lit("commit")) == "rows"), "inside_transaction").when(F.col("hit"), "reached").when(F.col("inside"), "inside_event").otherwise("not_reached")
    return facts.select("applied", outcome.alias("outcome"))


def no_overtake(log: DataFrame, barrier: DataFrame) -> DataFrame:
    """Log rows up to the earliest barrier coordinate, that one included; all of them without barriers."""
    first = barrier.agg(F.min("coord").alias("_b"))  # a row
    return log.crossJoin(F.broadcast(first)).where(F.col("_b").isNull() | (F.col("coord") <= F.col("_b"))).drop("_b")


def must_advance(log: DataFrame) -> DataFrame:
    """Rows of a file that don't lie behind the row read before them (by `seq`)."""
    return log.withColumn("_p", F.lag("pos").over(Window.partitionBy("file").orderBy("seq"))).where(F.col("pos") <= F.col("_p")).drop("_p")


def event_policy(event_type: Column, closes: str = "commit") -> Column:
    """What the stream does with an event."""
    return (
        F.when(event_type == "table_map", "apply_table_map")
        .when(event_type.isin("insert", "update", "delete", "rows"), "apply_rows")
        .when(event_type == closes, "commit_transaction")
        .when(event_type == "annotation", "ignore_annotation")
        .otherwise("ignore")
    )


def resume_coordinate(event_type: Column, start: Column, end: Column) -> Column:
    """Where to go on after an event: behind commits, statements and rotations; nowhere new after others."""
    return F.when(event_type.isin("commit", "query", "rotate"), end)


def lag_after(log: DataFrame, checkpoint: Column) -> DataFrame:
    """Rows behind the checkpoint: what is left to drain."""
    return log.agg(F.count_if(F.col("coord") > checkpoint).alias("lag"))
