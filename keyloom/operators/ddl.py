"""Schema-changing statements as typed operations, and the tables that they leave behind.

A statement column is cut into tokens by one pattern (quotes, comments, words), tokens are cut at their
outer commas, and each clause becomes one line of single-spaced tokens that a list of patterns reads. Statements stay rows throughout. States are a fold over operations in
order, by groups of tables that renames connect: a task streams the operations of its groups and holds
the columns of one group's tables, not its statements.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from keyloom.operators import closure
from keyloom.plans.schema_plan import TableState
from keyloom.session import materialise

_WORD = r"[\p{L}\p{N}_$]+"
#: Comments, quoted names, strings, words, and any other character.
TOKEN = r"(?s)/\*.*?\*/|--(?=\s|\p{Cntrl}|$)[^\n]*|#[^\n]*|`[^`]*(?:``[^`]*)*+`|\"[^\"\\]*(?:(?:\\.|\"\")[^\"\\]*)*+\"|'[^'\\]*(?:(?:\\.|'')[^'\\]*)*+'|" + _WORD + r"|\S"
_NAME = rf"(`[^`]+(?:``[^`]*)*`|{_WORD})"
_PLACE = rf"(?: (FIRST)| AFTER {_NAME})?"
_NOT_COLUMNS = r"(?!(?:INDEX|KEY|UNIQUE|FULLTEXT|SPATIAL|PRIMARY|CONSTRAINT|FOREIGN|CHECK|PARTITION|COLUMN)\b)"
_CONSTRAINT = rf"(?:CONSTRAINT {_NAME} )?"

#: Whole statements: operation, pattern, and which groups are guard, object, name, new name, columns.
STATEMENTS = [
    ("create_table", rf"^CREATE TABLE (IF NOT EXISTS )?{_NAME} \(", dict(guard=1, object=2)),
    ("alter_table", rf"^ALTER TABLE (IF EXISTS )?{_NAME} (?!\.)", dict(guard=1, object=2)),
    ("drop_table", rf"^DROP TABLE (IF EXISTS )?{_NAME}$", dict(guard=1, object=2)),
    ("truncate_table", rf"^TRUNCATE (?:TABLE )?{_NAME}$", dict(object=1)),
    ("rename_table", rf"^RENAME TABLE {_NAME} TO {_NAME}$", dict(object=1, new=2)),
    ("add_index", rf"^CREATE (?:UNIQUE |FULLTEXT |SPATIAL )?INDEX (IF NOT EXISTS )?{_NAME} (?:USING \w+ )?ON {_NAME} \( (.*) \)", dict(guard=1, name=2, object=3, columns=4)),
    ("drop_index", rf"^DROP INDEX (IF EXISTS )?{_NAME} ON {_NAME}$", dict(guard=1, name=2, object=3)),
    ("create_object", rf"^CREATE (?:OR REPLACE )?(?:VIEW|PROCEDURE|FUNCTION|EVENT|TRIGGER) (IF NOT EXISTS )?{_NAME}(?! \.)", dict(guard=1, object=2)),
    ("alter_object", rf"^ALTER (?:VIEW|PROCEDURE|FUNCTION|EVENT) {_NAME} (?!\.)", dict(object=1)),
    ("drop_object", rf"^DROP (?:VIEW|PROCEDURE|FUNCTION|EVENT|TRIGGER) (IF EXISTS )?{_NAME}$", dict(guard=1, object=2)),
]
#: Clauses of ALTER TABLE.
CLAUSES = [
    ("add_column", rf"^ADD (?:COLUMN )?(IF NOT EXISTS )?{_NOT_COLUMNS}{_NAME} ([^.,(].*?){_PLACE}$", dict(guard=1, name=2, definition=3, first=4, after=5)),
    ("drop_column", rf"^DROP (?:COLUMN )?(IF EXISTS )?{_NOT_COLUMNS}{_NAME}(?: RESTRICT| CASCADE)?$", dict(guard=1, name=2)),
    ("rename_column", rf"^RENAME COLUMN (IF EXISTS )?{_NAME} TO {_NAME}$", dict(guard=1, name=2, new=3)),
    ("change_column", rf"^CHANGE (?:COLUMN )?(IF EXISTS )?{_NAME} {_NAME} ([^.,(].*?){_PLACE}$", dict(guard=1, name=2, new=3, definition=4, first=5, after=6)),
    ("modify_column", rf"^MODIFY (?:COLUMN )?(IF EXISTS )?{_NAME} ([^.,(].*?){_PLACE}$", dict(guard=1, name=2, definition=3, first=4, after=5)),
    ("rename_table", rf"^RENAME (?:TO |AS )?(?!(?:COLUMN|INDEX|KEY)\b){_NAME}$", dict(new=1)),
    ("add_primary_key", rf"^ADD {_CONSTRAINT}PRIMARY KEY (?:USING \w+ )?\( (.*) \)", dict(columns=2)),
    ("drop_primary_key", r"^DROP PRIMARY KEY$", {}),
    ("add_foreign_key", rf"^ADD {_CONSTRAINT}FOREIGN KEY (.*)$", dict(name=1, definition=2)),
    ("drop_foreign_key", rf"^DROP FOREIGN KEY (IF EXISTS )?{_NAME}$", dict(guard=1, name=2)),
    ("add_check", rf"^ADD {_CONSTRAINT}CHECK (\( .*)$", dict(name=1, definition=2)),
    ("drop_check", rf"^DROP (?:CHECK|CONSTRAINT) (IF EXISTS )?{_NAME}$", dict(guard=1, name=2)),
    ("add_index", rf"^ADD (?:(?:UNIQUE |FULLTEXT |SPATIAL )?(?:INDEX|KEY)|UNIQUE) (IF NOT EXISTS )?{_NAME} (?:USING \w+ )?\( (.*) \)", dict(guard=1, name=2, columns=3)),
    ("drop_index", rf"^DROP (?:INDEX|KEY) (IF EXISTS )?{_NAME}$", dict(guard=1, name=2)),
    ("rename_index", rf"^RENAME (?:INDEX|KEY) {_NAME} TO {_NAME}$", dict(name=1, new=2)),
    ("table_option", r"^(?:ENGINE|COMMENT|AUTO_INCREMENT|DEFAULT|CHARACTER SET|CHARSET|COLLATE|ROW_FORMAT|ALGORITHM|LOCK)\b(.*)$", dict(definition=1)),
]
#: Items in the parentheses of CREATE TABLE.
ITEMS = [
    ("add_primary_key", rf"^{_CONSTRAINT}PRIMARY KEY (?:USING \w+ )?\( (.*) \)", dict(columns=2)),
    ("add_foreign_key", rf"^{_CONSTRAINT}FOREIGN KEY (.*)$", dict(name=1, definition=2)),
    ("add_check", rf"^{_CONSTRAINT}CHECK (\( .*)$", dict(name=1, definition=2)),
    ("add_index", rf"^(?:(?:UNIQUE |FULLTEXT |SPATIAL )?(?:INDEX|KEY)|UNIQUE) {_NAME} (?:USING \w+ )?\( (.*) \)", dict(name=1, columns=2)),
    ("add_column", rf"^{_NOT_COLUMNS}{_NAME} ([^.,(].*)$", dict(name=1, definition=2)),
]
_FIELDS = ("object", "name", "new", "definition", "after")


def unquoted(name: Column) -> Column:
    """A name without its quotes; null if there is none."""
    inner = F.regexp_replace(F.substring(name, F.lit(2), F.length(name) - 2), "``", "`")
    return F.when(name != "", F.when(F.startswith(name, F.lit("`")), inner).otherwise(name))


def _classified(df: DataFrame, line: str, tables: list[tuple[Column, list]], out: str) -> DataFrame:
    """df with out: struct(operation, guarded, object, name, new, definition, after, first, columns) by the first pattern that fits, or null.

    tables: patterns, and the rows that they are for. The pattern's number is found first; its text and groups
    are then looked up, so that each field is one extraction, whatever the number of patterns. Rows go by that
    number meanwhile: an expression holds its last pattern, and would compile one for each row otherwise.
    """
    table = [row for _, rows in tables for row in rows]
    fits = [f"(?is){pattern}" for _, pattern, _ in table]
    number = iter(range(1, len(table) + 1))
    which = F.coalesce(*[F.when(when, F.coalesce(*[F.when(F.col(line).rlike(fits[n - 1]), F.lit(n)) for _, n in zip(rows, number)])) for when, rows in tables])
    df = df.withColumn("_which", which).sortWithinPartitions("_which")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_which"))
    df = df.withColumn("_pattern", pick(fits))
    group = lambda field: pick([groups.get(field, -1) for _, _, groups in table])
    part = lambda field: F.when(group(field) >= 0, F.call_function("regexp_extract", F.col(line), F.col("_pattern"), group(field))).otherwise("")
    df = df.withColumns({f"_x_{field}": part(field) for field in ("guard", *_FIELDS, "first", "columns")})
    columns = F.transform(F.filter(F.split("_x_columns", " , "), lambda c: c != ""), lambda c: unquoted(F.regexp_extract(c, rf"^{_NAME}", 1)))
    row = F.struct(
        pick([operation for operation, _, _ in table]).alias("operation"),
        (F.col("_x_guard") != "").alias("guarded"),
        *[(F.when(F.col(f"_x_{f}") != "", F.col(f"_x_{f}")) if f == "definition" else unquoted(F.col(f"_x_{f}"))).alias(f) for f in _FIELDS],
        (F.col("_x_first") != "").alias("first"),
        columns.alias("columns"),
    )
    return df.withColumn(out, F.when(F.col("_which").isNotNull(), row)).drop("_which", "_pattern", "_x_guard", "_x_first", "_x_columns", *[f"_x_{f}" for f in _FIELDS])


_COMMENT = r"(?s)^(?:/\*.*\*/|--.*|#.*)$"


def _raw(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))


def _kept(raw: Column) -> Column:
    """Tokens that aren't comments; names in double quotes get backticks."""
    name = lambda t: F.concat(F.lit("`"), F.replace(F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), '""', '"'), F.lit("`"), F.lit("``")), F.lit("`"))
    return F.transform(F.filter(raw, lambda t: ~t.rlike(_COMMENT)), lambda t: F.when(t.rlike('(?s)^".+"$'), name(t)).otherwise(t))


def tokens(sql: Column) -> Column:
    """The tokens of a statement, without comments; names in double quotes get backticks."""
    return _kept(_raw(sql))


def _fault() -> Column:
    """Why the tokens of a statement (_raw, _toks, _line) can't be read, or null."""
    toks, line, next_ = F.col("_toks"), F.col("_line"), F.slice("_toks", F.lit(2), F.greatest(F.lit(0), F.size("_toks") - 1))
    objects = r"(?:VIEW|PROCEDURE|FUNCTION|EVENT|TRIGGER)"
    # What looks at each token, or goes back and forth in the line, only runs where a plain search finds a reason.
    active = F.col("_marked") & F.exists("_raw", lambda t: t.rlike(r"(?i)^/\*(?:!|\+|M!)"))
    return (
        F.when(F.size(toks) == 0, F.when(active, "active_comment").otherwise("empty"))
        .when(active, "active_comment")
        .when(F.array_contains(toks, "'") | F.array_contains(toks, '"') | F.array_contains(toks, "`"), "unterminated_quote")
        .when(F.array_contains(toks, "/") & F.array_contains(F.zip_with(toks, next_, lambda x, y: F.concat(x, y)), "/*"), "unterminated_comment")
        .when(F.array_contains(toks, ";"), "several_statements")
        .when(F.contains(line, F.lit(" . ")) & line.rlike(rf"(?i)^(?:CREATE|ALTER|DROP|TRUNCATE|RENAME) .*?{_NAME} \. {_NAME}") & ~line.rlike(rf"(?i)^(?:CREATE|ALTER) (?:OR REPLACE )?{objects} (?:IF NOT EXISTS )?{_NAME} (?!\.)"), "qualified_name")
        .when(line.rlike(rf"(?i)^(?:DROP TABLE (?:IF EXISTS )?{_NAME} ,|RENAME TABLE {_NAME} TO {_NAME} ,)"), "several_objects")
    )


def clauses(tokens: list[str], alter: bool):
    """item, text and whether parentheses are unbalanced, of each clause or item: the tokens between outer commas.

    CREATE TABLE's tokens begin with the parenthesis around its items and count up to the one that closes it.
    """
    deep, item, low, words, found, closed = 0, 1, 0, [], [], False
    for i, t in enumerate(tokens):
        deep += 1 if t == "(" else -1 if t == ")" else 0
        closed = closed or (not alter and deep <= 0)
        if t == "," and deep == (0 if alter else 1):
            if words:
                found.append((item, " ".join(words), low < 0))
            item, low, words = item + 1, 0, []
        elif not closed and (alter or i > 0):
            words.append(t)
            low = min(low, deep)
    if words:
        found.append((item, " ".join(words), low < 0))
    return [(n, text, bad or deep != 0) for n, text, bad in found]


def _cut(batches):
    """A row for each clause of the statements of a batch, with their other columns."""
    for b in batches:
        at, rows = [], []
        for i, (tokens, alter) in enumerate(zip(b.column("_toks").to_pylist(), b.column("_alter").to_pylist())):
            for row in clauses(tokens, alter):
                at.append(i)
                rows.append(row)
        kept = b.drop_columns(["_toks"]).take(pa.array(at, pa.int32()))
        new = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*kept.columns, *new], [*kept.schema.names, "item", "clause", "_bad"])


def parse(statements: DataFrame, key: list[str], sql: str = "sql") -> DataFrame:
    """A row for each operation: key, item (from 0), operation, guarded, object, name, new, definition, after, first, columns, clause, error.

    key names each statement once. CREATE TABLE gives create_table and an operation for each of its
    items, ALTER TABLE one for each clause. `clause` is the operation's text in single-spaced tokens. What
    isn't in the grammar is a row with an error and no operation: empty (null too), active_comment (versioned
    comments and hints, which aren't comments), unterminated_quote, unterminated_comment,
    several_statements, several_objects, qualified_name, unbalanced, statement or clause (unknown). A statement with an
    error in one clause has it in that row; apply_all() refuses the whole statement.
    """
    sql = F.coalesce(F.col(sql), F.lit(""))
    marked = sql.rlike('--|/\\*|[#"]')
    base = statements.select(*key, _raw(sql).alias("_raw"), marked.alias("_marked"))
    base = base.withColumn("_toks", F.when(F.col("_marked"), _kept(F.col("_raw"))).otherwise(F.col("_raw")))
    # Semicolons at the end don't separate statements.
    ends = F.size("_toks") - F.coalesce(F.nullif(F.array_position(F.transform(F.reverse("_toks"), lambda t: t == ";"), False).cast("int"), F.lit(0)), F.size("_toks") + 1) + 1
    base = base.withColumn("_n", F.when(F.get("_toks", F.size("_toks") - 1) == ";", ends).otherwise(F.size("_toks")))
    base = base.withColumn("_toks", F.slice("_toks", F.lit(1), F.greatest(F.col("_n"), F.lit(0)))).withColumn("_line", F.array_join("_toks", " "))
    base = _classified(base.withColumn("_fault", _fault()), "_line", [(F.col("_fault").isNull(), STATEMENTS)], "_head")
    # Written once: two branches read it, and their filters aren't pushed into the classification.
    base = materialise(base.drop("_raw", "_n", "_marked"), "ddl_statements")
    inner = F.col("_head.operation").isin("create_table", "alter_table")
    whole = base.where(F.col("_head").isNull() | (F.col("_head.operation") != "alter_table")).select(*key, F.lit(0).alias("item"), F.col("_head").alias("op"), F.col("_line").alias("clause"), F.coalesce("_fault", F.when(F.col("_head").isNull(), "statement")).alias("error"))
    # Tokens behind the head of ALTER TABLE, or from the first parenthesis of CREATE TABLE on.
    altered = F.col("_head.operation") == "alter_table"
    skip = F.when(altered, F.when(F.col("_head.guarded"), 5).otherwise(3)).otherwise(F.array_position("_toks", "(").cast("int") - 1)
    each = base.where(inner).select(*key, F.col("_head.object").alias("_object"), altered.alias("_alter"), F.slice("_toks", skip + 1, F.size("_toks")).alias("_toks"))
    kept = StructType([f for f in each.schema if f.name != "_toks"] + [StructField("item", IntegerType()), StructField("clause", StringType()), StructField("_bad", BooleanType())])
    lines = each.mapInArrow(_cut, kept)
    # Written too, so that no filter on the result runs the patterns again.
    lines = materialise(_classified(lines, "clause", [(F.col("_alter"), CLAUSES), (~F.col("_alter"), ITEMS)], "op"), "ddl_clauses")
    error = F.when(F.col("_bad"), "unbalanced").when(F.col("op").isNull(), "clause")
    items = lines.select(*key, "item", "op", "clause", error.alias("error"), "_object")
    out = whole.withColumn("_object", F.lit(None).cast("string")).unionByName(items)
    fields = [F.coalesce("op.object", "_object").alias("object"), *[F.col(f"op.{f}").alias(f) for f in ("name", "new", "definition", "after", "first", "columns")]]
    kept = out.withColumn("op", F.when(F.col("error").isNull(), F.col("op")))
    return kept.select(*key, "item", F.col("op.operation").alias("operation"), F.col("op.guarded").alias("guarded"), *fields, "clause", "error")


# --- states --------------------------------------------------------------------------------------------


class Refused(ValueError):
    pass


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column_clause(verb: str, op: dict) -> str:
    place = " FIRST" if op["first"] else f" AFTER {_quoted(op['after'])}" if op["after"] else ""
    return f"{verb} {_quoted(op['name'])} {op['definition']}{place}"


def _edit(tables: dict[str, TableState], op: dict) -> str | None:
    """Apply one operation to the tables of a group; what has to be said to the target, or None if nothing has."""
    kind, at, guarded = op["operation"], op["object"], op["guarded"]
    if kind == "create_table":
        if at in tables and guarded:
            return None
        if at in tables:
            raise Refused(f"table {at} is there already")
        tables[at] = TableState(())
        return op["clause"]
    if at not in tables:
        if guarded and kind == "drop_table":
            return None
        raise Refused(f"no table {at}")
    t = tables[at]
    if kind == "drop_table":
        del tables[at]
    elif kind == "rename_table":
        if op["new"] in tables and op["new"] != at:
            raise Refused(f"table {op['new']} is there already")
        tables[op["new"]] = tables.pop(at)
    elif kind == "add_column":
        place = next((i for i, (c, _) in enumerate(t.columns) if c == op["name"]), -1)
        if place >= 0:
            want = 0 if op["first"] else t.at(op["after"]) + 1 if op["after"] else len(t.columns) - 1
            if t.columns[place][1] != op["definition"] or place != want:
                raise Refused(f"column {op['name']} is there with another definition or place")
            return None
        tables[at] = t.add_column(op["name"], op["definition"], op["after"], op["first"])
        return _column_clause("ADD COLUMN", op) if op["clause"][:4].upper() == "ADD " else op["clause"]
    elif kind == "drop_column":
        tables[at] = t.drop_column(op["name"], guarded)
        return None if tables[at] is t else f"DROP COLUMN {_quoted(t.columns[t.at(op['name'])][0])}"
    elif kind == "rename_column":
        tables[at] = t.rename_column(op["name"], op["new"], guarded)
        return None if t.at(op["name"]) < 0 else f"RENAME COLUMN {_quoted(op['name'])} TO {_quoted(op['new'])}"
    elif kind in ("change_column", "modify_column"):
        if t.at(op["name"]) < 0 and guarded:
            return None
        new = op["new"] if kind == "change_column" else t.columns[t.at(op["name"])][0] if t.at(op["name"]) >= 0 else op["name"]
        t = t.rename_column(op["name"], new).modify_column(new, op["definition"])
        tables[at] = t.move_column(new, op["after"], op["first"]) if op["first"] or op["after"] else t
    elif kind == "add_index":
        if guarded and op["name"] in dict(t.indexes):
            return None
        tables[at] = t.create_index(op["name"], tuple(op["columns"]))
    elif kind == "add_primary_key":
        tables[at] = t.create_index("PRIMARY", tuple(op["columns"]))
    elif kind in ("drop_index", "drop_primary_key"):
        name = op["name"] or "PRIMARY"
        if guarded and name not in dict(t.indexes):
            return None
        tables[at] = t.drop_index(name)
    elif kind == "rename_index":
        if op["name"] not in dict(t.indexes) or op["new"] in dict(t.indexes):
            raise Refused(f"index {op['name']} can't be renamed")
        tables[at] = t.rename_index(op["name"], op["new"])
    return op["clause"]


_STATE = "grp string, kind string, stmt string, item int, said string, outcome string, reason string, table_name string, ordinal int, name string, definition string"


def _fold(batches):
    """Operations in order of group, statement and item: a row for each operation, and the group's tables behind its last."""
    out: list[tuple] = []
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = [x.split()[0] for x in _STATE.split(", ")]
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    group, stmt, ops, tables = None, None, [], {}

    def run_statement():
        """All operations of a statement, or none."""
        nonlocal tables
        if not ops:
            return
        after, said, why = dict(tables), [], next((o["error"] for o in ops if o["error"]), None)
        if why is None:
            try:
                guarded = [o["operation"] == "add_column" and o["guarded"] for o in ops]
                there = [o["object"] in tables and tables[o["object"]].at(o["name"]) >= 0 for o, g in zip(ops, guarded) if g]
                if any(there) and not all(there):
                    raise Refused("some of the guarded columns are there, some aren't")
                # A table that is there already makes a guarded CREATE TABLE nothing as a whole.
                skip = ops[0]["operation"] == "create_table" and ops[0]["guarded"] and ops[0]["object"] in tables
                said = [None if skip else _edit(after, o) for o in ops]
            except (Refused, ValueError) as e:
                why = str(e)
        if why is None:
            tables = after
        for n, o in enumerate(ops):
            outcome = "refused" if why is not None else "no_op" if said[n] is None else "applied"
            out.append((group, "op", stmt, o["item"], None if why is not None else said[n], outcome, why, o["object"], None, None, None))

    def end_group():
        for name, t in sorted(tables.items()):
            out.extend((group, "column", None, None, None, None, None, name, i + 1, c, d) for i, (c, d) in enumerate(t.columns))
            out.extend((group, "index", None, None, None, None, None, name, None, n, ",".join(c)) for n, c in t.indexes)

    for b in batches:
        for o in b.to_pylist():
            if o["stmt"] != stmt or o["grp"] != group:
                run_statement()
                ops = []
                if o["grp"] != group:
                    end_group()
                    tables = {}
                group, stmt = o["grp"], o["stmt"]
                if len(out) > 20_000:
                    yield flush()
                    out.clear()
            ops.append(o)
    run_statement()
    end_group()
    if out:
        yield flush()


def apply_all(operations: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what became of each operation, the tables behind all of them), from operations of parse(), in order of key.

    First: key, item, table_name, outcome (applied, no_op, refused), reason, said (what the target must be
    told: guards that the state decides are gone). A statement with an error or with an operation that can't be is
    refused as a whole and changes nothing. Columns are found without regard to case; a column that is
    there with the same definition and place, a guarded drop of an absent one and the like are no-ops.
    Second: table_name, kind (column or index), ordinal, name, definition. Operations on views and other objects and rows
    without an object are left out. Tables that renames connect are folded together, in one task; it
    holds their columns only.
    """
    table_ops = operations.where(F.col("object").isNotNull() & ~F.coalesce(F.endswith("operation", F.lit("_object")), F.lit(False)))
    table_ops = materialise(table_ops.withColumn("stmt", F.to_json(F.struct(*key))), "ddl_operations")
    renames = table_ops.where("operation = 'rename_table' and new <> object").select(F.col("object").alias("a"), F.col("new").alias("b"))
    names = closure.components(renames).select(F.col("node").alias("object"), F.col("component"))
    rows = table_ops.join(names, "object", "left").withColumn("grp", F.coalesce("component", "object"))
    fields = ["grp", "stmt", "item", "operation", "guarded", "object", "name", "new", "definition", "after", "first", "columns", "clause", "error"]
    dealt = rows.repartition("grp").sortWithinPartitions("grp", *key, "item").select(*fields)
    done = materialise(dealt.mapInArrow(_fold, _STATE), "ddl_states")
    back = table_ops.select("stmt", "item", *key)
    ops = done.where("kind = 'op'").select("stmt", "item", "table_name", "outcome", "reason", "said").join(back, ["stmt", "item"]).select(*key, "item", "table_name", "outcome", "reason", "said")
    return ops, done.where("kind <> 'op'").select("table_name", "kind", "ordinal", "name", "definition")


def fingerprints(state: DataFrame) -> DataFrame:
    """SHA-256 of each table's columns in order and indexes by name."""
    part = F.to_json(F.struct("kind", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "name", "definition"))
    return state.groupBy("table_name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n"), 256).alias("fingerprint"))
