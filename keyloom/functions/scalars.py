"""Scalar column functions of the reconciliation engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_extend_24(v: Column) -> Column:
    return F.when(v.bitwiseAND(0x800000) == 0, v).otherwise(v - 0x1000000)


def as_signed(v: Column, bits: int) -> Column:
    """The signed value of an unsigned integer of so many bits; 64 bits come as decimal(20,0)."""
    if bits == 64:
        d = v.cast("decimal(20,0)")
        return F.when(d >= F.lit("9223372036854775808").cast("decimal(20,0)"), d - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)").cast("long")
    return F.when(v >= 1 << (bits - 1), v - (1 << bits)).otherwise(v).cast("long")


def pack_bits(bits: Column) -> Column:
    """Number of an array of booleans, first bit highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("long"))


def pack_bytes(bits: Column) -> Column:
    """The same as bytes, hex text: bits fill up from the right to whole bytes."""
    digits = F.hex(pack_bits(bits))
    whole = F.greatest(F.lit(1), F.ceil(F.size(bits) / 8).cast("int")) * 2
    return F.substring(F.concat(F.repeat(F.lit("0"), whole), digits), F.length(digits) + 1, whole)


def enum_label(ordinal: Column, labels: list[str] | None) -> Column:
    """Label of an ordinal: 0 is the empty label, one past the end an error, without labels the ordinal."""
    if not labels:
        return ordinal.cast("string")
    bad = F.raise_error(F.concat(F.lit("ordinal out of range: "), ordinal.cast("string"))).cast("string")
    return F.when(ordinal == 0, "").when(ordinal.between(1, len(labels)), F.element_at(F.array(*map(F.lit, labels)), ordinal.cast("int"))).when(ordinal.isNull(), F.lit(None)).otherwise(bad)


def parse_labels(column_type: str, kind: str = "enum") -> list[str] | None:
    """Labels of enum('a','b''c') or set(...); None if it isn't one. Quotes are doubled or escaped by a backslash."""
    m = re.fullmatch(rf"\s*{kind}\s*\((.*)\)\s*", column_type, re.I | re.S)
    if not m:
        return None
    body = r"'((?:[^'\\]|''|\\.)*)'"
    if not re.fullmatch(rf"\s*{body}\s*(?:,\s*{body}\s*)*", m[1], re.S):
        return None
    return [re.sub(r"''|\\(.)", lambda x: x[1] or "'", s, flags=re.S) for s in re.findall(body, m[1], re.S)]


def date_text(epoch_days: Column) -> Column:
    return F.date_format(F.date_from_unix_date(epoch_days), "yyyy-MM-dd")


def datetime_text(micros: Column) -> Column:
    """Text of microseconds since 1970 in UTC; three digits of a second, none if they are zero."""
    t = F.timestamp_micros(micros)
    return F.when(F.pmod(micros, F.lit(1_000_000)) < 1000, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS"))


def timestamp_text(millis: Column) -> Column:
    """Text of milliseconds since 1970 in UTC, whole seconds."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss")


def value_text(c: Column) -> Column:
    """Inventory text: empty for null, a midnight timestamp as its date."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r" 00:00:00(\.0+)?$", "")


def duration_text(days: Column, hours: Column, minutes: Column, seconds: Column, negative: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    total = days * 24 + hours
    return F.concat(F.when(negative, "-").otherwise(""), F.when(total < 100, two(total)).otherwise(total.cast("string")), F.lit(":"), two(minutes), F.lit(":"), two(seconds))


def quote_name(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def quote_literal(text: Column) -> Column:
    """A string literal of the source dialect: backslashes and quotes doubled; NULL for null."""
    inner = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.coalesce(F.concat(F.lit("'"), inner, F.lit("'")), F.lit("NULL"))


def log_number(file: Column) -> Column:
    return F.when(file.rlike(r"\.\d+$"), F.regexp_extract(file, r"\.(\d+)$", 1).cast("long"))


def short_name(kind: Column, table: Column, name: Column, limit: int = 64, digits: int = 16) -> Column:
    """A constraint's name behind its table's; past the limit the front of it and a hash of all three."""
    full = F.when(F.startswith(name, F.concat(table, F.lit("_"))), name).otherwise(F.concat(table, F.lit("_"), name))
    mark = F.sha2(F.concat(kind, F.lit("\0"), table, F.lit("\0"), name), 256)
    return F.when(F.char_length(full) <= limit, full).otherwise(F.concat(F.left(full, F.lit(limit - digits - 1)), F.lit("_"), F.left(mark, F.lit(digits))))


def fnv1a(data: bytes, seed: int = 0x811C9DC5) -> int:
    """32-bit FNV-1a, for ids that are made on the driver."""
    for b in data:
        seed = (seed ^ b) * 0x01000193 & 0xFFFFFFFF
    return seed


def log_word(text: Column) -> Column:
    """Text without white space, for a line of log."""
    return F.regexp_replace(text, r"\s", "_")


def duplicate_index(error: Column) -> Column:
    """The index that a duplicate-key error names; null if it names none."""
    return F.when(error.rlike("for key '[^']+'"), F.regexp_extract(error, "for key '([^']+)'", 1))


def failed_constraint(error: Column) -> Column:
    return F.when(error.rlike("CONSTRAINT `[^`]+`"), F.regexp_extract(error, "CONSTRAINT `([^`]+)`", 1))


def evidence_value(text: Column) -> Column:
    return F.regexp_replace(text, r"\.000000$", "")
