"""Canonical text, row encoding, order-insensitive checksums and framed identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_text(c: Column, kind: T.DataType) -> Column:
    """The text that stands for a value in a checksum; floats and nested values have none."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        raise ValueError("floating point values have no stable text; cast to decimal first")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ValueError(f"{kind.simpleString()} can't be part of a checksum")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    return c.cast("string")


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """Each value as its length in bytes, a colon and its text, or N for null, one after the other."""
    if not columns:
        raise ValueError("a checksum needs a column")
    parts = []
    for name in columns:
        t = canonical_text(F.col(name), df.schema[name].dataType)
        parts.append(F.when(F.col(name).isNull(), F.lit("N")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)))
    return F.concat(*parts)


def checksum(text: Column) -> Column:
    """XOR over a group of the first 64 bits of MD5, as decimal(20,0); 0 for no rows.

    Spark's bit_xor is signed, so the halves are folded apart. Equal rows cancel: keep the count beside it.
    """
    half = lambda at: F.coalesce(F.bit_xor(F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long")), F.lit(0))
    return (half(1).cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + half(9).cast("decimal(20,0)")).cast("decimal(20,0)")


def framed(*fields: Column) -> Column:
    """Fields as bytes, each behind its length in 8 bytes, big end first."""
    parts = []
    for f in fields:
        b = f.cast("string").cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b]
    return reduce(lambda a, b: F.concat(a, b), parts)


def identity(*fields: Column) -> Column:
    """SHA-256 over framed fields: no two lists of fields share it by moving a border."""
    return F.sha2(framed(*fields), 256)
