"""Classifiers of log lines, statements and schema changes as ordered CASE ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statement prefixes and patterns that decide about a statement.
DML = ["DELETE FROM", "INSERT INTO", "REPLACE INTO", "UPDATE"]
DDL = [
    "ALTER DATABASE", "ALTER EVENT", "ALTER FUNCTION", "ALTER PROCEDURE", "ALTER SCHEMA", "ALTER TABLE", "ALTER VIEW",
    "CREATE DATABASE", "CREATE EVENT", "CREATE FUNCTION", "CREATE INDEX", "CREATE OR REPLACE VIEW", "CREATE PROCEDURE", "CREATE SCHEMA", "CREATE TABLE", "CREATE TRIGGER", "CREATE UNIQUE INDEX", "CREATE VIEW",
    "DROP DATABASE", "DROP EVENT", "DROP FUNCTION", "DROP INDEX", "DROP PROCEDURE", "DROP SCHEMA", "DROP TABLE", "DROP TRIGGER", "DROP VIEW",
    "RENAME TABLE", "TRUNCATE",
]
ADMIN = [
    "ALTER RESOURCE GROUP", "ALTER ROLE", "ALTER SERVER", "ALTER TABLESPACE", "ALTER USER",
    "CREATE RESOURCE GROUP", "CREATE ROLE", "CREATE SERVER", "CREATE TABLESPACE", "CREATE USER",
    "DROP RESOURCE GROUP", "DROP ROLE", "DROP SERVER", "DROP TABLESPACE", "DROP USER",
    "GRANT", "RENAME USER", "REVOKE",
]
COMPOUND = ["ALTER EVENT", "CREATE EVENT", "CREATE FUNCTION", "CREATE PROCEDURE", "CREATE TRIGGER"]
VENDOR_ONLY = ["RETURNING", "SEQUENCE", "SYSTEM VERSIONING", "VERSIONING", "DELETE HISTORY", "INSERT DELAYED"]
UNSAFE = ["LOAD_FILE(", "INTO OUTFILE", "INTO DUMPFILE", "LOAD DATA", "DEFINER", "SQL SECURITY DEFINER"]
GUARDS = ["IF NOT EXISTS", "IF EXISTS"]
GUARDED = ["ALTER TABLE", "CREATE INDEX", "CREATE UNIQUE INDEX", "DROP INDEX"]

#: A quoted literal (quotes doubled or escaped inside), a line comment, a block comment.
LITERAL = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\""
LEADING = r"(?s)^(?:\s*(?:(?:--|#)[^\n]*(?:\n|$)|/\*(?!!).*?\*/))*+"
COMMENT = r"--[^\n\r]*|/\*(?s:.*?)(?:\*/|$)"


def starts(sql: Column, prefixes: list[str]) -> Column:
    return sql.rlike(f"(?i)^(?:{'|'.join(p + ' ' for p in prefixes)})")


def normalise(sql: Column) -> Column:
    """Without leading comments, however many, surrounding white space and final semicolons."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(sql, LEADING, ""), r"^\s+|\s+$", ""), r"\s*;+\s*$", ""))


def outside_literals(sql: Column) -> Column:
    """Upper case, with each quoted literal blanked."""
    return F.upper(F.regexp_replace(sql, LITERAL, " "))


def has_pattern(upper: Column, pattern: str) -> Column:
    """The pattern stands there, not as a part of longer words."""
    word = "[A-Za-z0-9_]"
    before = f"(?<!{word})" if pattern[0].isalnum() else ""
    behind = f"(?!{word})" if pattern[-1].isalnum() else ""
    return upper.rlike(before + r"\Q" + pattern + r"\E" + behind)


def first_pattern(upper: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.when(has_pattern(upper, p), F.lit(p)) for p in patterns])


def is_multi(sql: Column) -> Column:
    """A semicolon outside literals and comments with something behind it."""
    return F.regexp_replace(sql, f"{LITERAL}|{COMMENT}", " ").rlike(r";\s*\S")


def statement_decision(sql: Column) -> Column:
    """struct(decision, reason, detail) of a normalised statement: replay, skip or quarantine."""
    upper = outside_literals(sql)
    vendor, unsafe, guard = first_pattern(upper, VENDOR_ONLY), first_pattern(upper, UNSAFE), first_pattern(upper, GUARDS)
    out = lambda d, r=None, x=None: F.struct(F.lit(d).alias("decision"), F.lit(r).cast("string").alias("reason"), (x if x is not None else F.lit(None)).cast("string").alias("detail"))
    known = starts(sql, DML) | starts(sql, DDL)
    return (
        F.when(sql == "", out("quarantine", "empty"))
        .when(is_multi(sql) & ~starts(sql, COMPOUND), out("quarantine", "multi_statement"))
        .when(vendor.isNotNull(), out("quarantine", "vendor_only", vendor))
        .when(unsafe.isNotNull(), out("quarantine", "unsafe", unsafe))
        .when(starts(upper, GUARDED) & guard.isNotNull(), out("quarantine", "vendor_only", guard))
        .when(known, out("replay"))
        .when(starts(sql, ADMIN), out("skip"))
        .otherwise(out("quarantine", "unsupported", F.regexp_extract(sql, r"^(\S+)", 1)))
    )


def changes_schema(sql: Column) -> Column:
    return F.upper(F.regexp_extract(sql, r"^(\S+)", 1)).isin("ALTER", "CREATE", "DROP", "RENAME", "TRUNCATE")


def changes_data(sql: Column) -> Column:
    return starts(F.regexp_replace(sql, r"\s+", " "), DML)


def is_transaction_control(sql: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(sql), r"\s*;$", "")).isin("BEGIN", "COMMIT", "ROLLBACK")


def ddl_family(sql: Column) -> Column:
    """Kind of object that a schema change is about."""
    first, second = F.upper(F.regexp_extract(sql, r"^(\S+)", 1)), F.upper(F.regexp_extract(sql, r"(?i)^\S+\s+(?:OR\s+REPLACE\s+)?(?:UNIQUE\s+)?(\w+)", 1))
    return F.when(first == "RENAME", "rename").when(first == "TRUNCATE", "truncate").when(second.isin("TABLE", "INDEX", "VIEW", "PROCEDURE", "FUNCTION", "EVENT", "TRIGGER"), F.lower(second)).otherwise("other")


def query_policy(sql: Column, schema: Column, source_schema: str) -> Column:
    """What a statement event in a row-format log means: row changes must not come as statements."""
    return (
        F.when(is_transaction_control(sql), "transaction_control")
        .when(schema != source_schema, "ignore")
        .when(changes_data(sql), "contract_violation")
        .when(changes_schema(sql), "schema_change")
        .otherwise("ignore")
    )


def line_class(line: Column) -> Column:
    """Class of a line of decoded log text; null for lines that are no event."""
    # The markers of the text format. A line can hold several, and the first one here counts.
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    u = F.upper(t)
    comment = F.startswith(t, F.lit("#")) & ~F.startswith(t, F.lit("###"))
    return (
        F.when(t == "", F.lit(None))
        .when(F.contains(t, F.lit("Rotate to ")), "rotate")
        .when(comment & t.rlike(r"^# at \d+"), F.lit(None))
        .when(comment & F.contains(t, F.lit("Rotate to")), "rotate")
        .when(comment & F.startswith(u, F.lit("# QUERY")), "query")
        .when(comment & F.contains(t, F.lit("GTID")), "gtid")
        .when(comment & F.contains(t, F.lit("Table_map:")), "table_map")
        .when(comment, F.lit(None))
        .when(F.startswith(u, F.lit("### INSERT INTO")), "rows_insert")
        .when(F.startswith(u, F.lit("### UPDATE")), "rows_update")
        .when(F.startswith(u, F.lit("### DELETE")), "rows_delete")
        .when(u.rlike(r"^(?:INSERT INTO|UPDATE |DELETE FROM|CREATE |ALTER |DROP |TRUNCATE )"), "statement")
        .when(F.startswith(t, F.lit("### @")), F.lit(None))
        .otherwise("unknown")
    )


def is_retryable(error: Column) -> Column:
    """Lost connections and time-outs are tried again; a purged or missing log never."""
    e = F.lower(error)
    return ~is_stale(error) & e.rlike("lost connection|gone away|connection (?:reset|refused|aborted)|broken pipe|timed? ?out|unexpected eof|too many connections")


def is_stale(error: Column) -> Column:
    return F.lower(error).rlike("purged|could not find first log|log file.*not found|missing (?:log|binary)")
