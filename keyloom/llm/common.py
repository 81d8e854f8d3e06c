"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.session import discard, materialise, read_table, shared_dir, work_path  # noqa: F401

#: White space that separates words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip_spaces(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; null or blank: an empty array."""
    t = strip_spaces(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+"))


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once for each row.

    A plain projection may be folded into each later expression, a lambda body included, and then
    runs again for each element; a generator of one struct can't be folded.
    """
    one = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", one)


def with_window_hashes(df: DataFrame, words: str, size: int, name: str) -> DataFrame:
    """Add the 64-bit hashes of all runs of `size` words of an array column, none if it has fewer.

    Each word is hashed once; runs are joined from two shorter ones, next to each other.
    """
    df = pinned(df, _one=F.transform(words, lambda w: F.xxhash64(w)))
    df, have = df.withColumn("_runs", F.col("_one")), 1
    joined = lambda other, step: F.zip_with("_runs", F.slice(other, F.lit(step + 1), F.size(other)), lambda x, y: F.xxhash64(x, y))
    for bit in bin(size)[3:]:
        df, have = pinned(df, _next=joined("_runs", have)).drop("_runs").withColumnRenamed("_next", "_runs"), 2 * have
        if bit == "1":
            df, have = pinned(df, _next=joined("_one", have)).drop("_runs").withColumnRenamed("_next", "_runs"), have + 1
    return pinned(df, **{name: F.slice("_runs", F.lit(1), F.greatest(F.lit(0), F.size("_runs") - (size - 1)))}).drop("_one", "_runs")


def _bucket(n: Column) -> Column:
    """n rounded down to three digits, so that there are few different values at any size."""
    unit = F.pow(F.lit(10), F.greatest(F.lit(0), F.length(n.cast("string")) - 3)).cast("long")
    return n - F.pmod(n, unit)


#: Parts that a run of equal counts is broken into, by hash.
PARTS = 4096


def most_frequent(counts: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Rows of counts with a count `n` among the highest of their group in `by`, at most limit of each group.

    Those are the rows from the lowest count on, rounded down to three digits, that at most limit rows reach, and of
    the next lower count as many as there is room for: those with the lowest hash of their other columns, in
    steps of 1/4,096 of that count's rows. Histograms find both, without a ranking of rows.
    """
    key = [c for c in counts.columns if c not in (*by, "n")]
    placed = counts.withColumns({"_cut": _bucket(F.col("n")), "_part": F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int")})
    reached = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.desc("_cut")))
    runs = placed.groupBy(*by, "_cut").agg(F.count("*").alias("_c")).withColumn("_r", reached)
    fits = F.col("_r") <= limit
    cuts = runs.groupBy(*by).agg(F.min(F.when(fits, F.col("_cut"))).alias("_low"), F.max(F.when(~fits, F.col("_cut"))).alias("_broken"), (F.lit(limit) - F.coalesce(F.max(F.when(fits, F.col("_r"))), F.lit(0))).alias("_room"))
    broken = placed.join(F.broadcast(cuts), by).where(F.col("_cut") == F.col("_broken"))  # a row a group
    reached = F.sum("_c").over(Window.partitionBy(*by).orderBy("_part"))
    parts = broken.groupBy(*by, "_part", "_room").agg(F.count("*").alias("_c")).withColumn("_r", reached).where(F.col("_r") <= F.col("_room"))
    cuts = cuts.join(parts.groupBy(*by).agg(F.max("_part").alias("_last")), by, "left")
    kept = (F.col("n") >= F.col("_low")) | ((F.col("_cut") == F.col("_broken")) & (F.col("_part") <= F.col("_last")))
    return placed.join(F.broadcast(cuts), by).where(kept).select(*counts.columns)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file, named after its content, to any folder Spark can write, unless it is there already."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return
    half = at.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(half)
    out.write(bytearray(data))
    out.close()
    if not fs.rename(half, at):
        fs.delete(half, False)


def slices(texts: pa.Array, size: int):
    """Cuts of a column that hold about size bytes each, or one longer text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(texts):
        past = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, past + size, side="right")))
        yield texts.slice(at, end - at)
        at = end


#: DuckDB: the table of CRC-32 as column t of a one-row table named crc.
CRC_TABLE_SQL = "crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"


def crc32_sql(text: str) -> str:
    """DuckDB: unsigned CRC-32 of an expression's UTF-8 bytes, code points below 2,048; crc (CRC_TABLE_SQL) must be in scope."""
    points = f"flatten(list_transform(string_split({text}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + (unicode(x) >> 6)::bigint, 128 + (unicode(x) & 63)::bigint] end))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {points}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"
