"""Statements as typed operations and the states they leave."""

import pytest
from pyspark.sql import functions as F

from keyloom.operators import closure, ddl


def parsed(spark, *sqls):
    df = spark.createDataFrame(list(enumerate(sqls)), "id int, sql string").withColumn("item", F.lit("mine"))
    return [r.asDict() for r in ddl.parse(df, ["id"]).orderBy("id", "item").collect()]


HEADS = [
    ("CREATE TABLE `a` (`id` INT)", "create_table", "a", None, None),
    ("drop table if exists a;", "drop_table", "a", None, None),
    ("TRUNCATE TABLE accounts", "truncate_table", "accounts", None, None),
    ("TRUNCATE accounts", "truncate_table", "accounts", None, None),
    ("RENAME TABLE accounts TO archived_accounts", "rename_table", "accounts", None, "archived_accounts"),
    ("CREATE UNIQUE INDEX i ON accounts (handle, id) USING BTREE", "add_index", "accounts", "i", None),
    ("DROP INDEX i ON accounts", "drop_index", "accounts", "i", None),
    ("CREATE OR REPLACE VIEW v AS SELECT a.b FROM a", "create_object", "v", None, None),
    ("ALTER EVENT expire_accounts DISABLE", "alter_object", "expire_accounts", None, None),
    ("DROP TRIGGER accounts_bi", "drop_object", "accounts_bi", None, None),
    ("/* migration 7.2 */ DROP TABLE `account.history`", "drop_table", "account.history", None, None),
    ('DROP TABLE "a`b"', "drop_table", "a`b", None, None),
]


def test_whole_statements(spark):
    rows = [r for r in parsed(spark, *[h[0] for h in HEADS]) if r["item"] == 0]
    assert [(r["operation"], r["object"], r["name"], r["new"], r["error"]) for r in rows] == [(*h[1:], None) for h in HEADS]
    assert rows[1]["guarded"] and not rows[0]["guarded"] and rows[5]["columns"] == ["handle", "id"]


ERRORS = [
    (None, "empty"), ("", "empty"), ("-- nothing\n", "empty"),
    ("ALTER TABLE other_db.accounts ADD COLUMN handle varchar(64)", "qualified_name"),
    ("CREATE INDEX i ON other.accounts (a)", "qualified_name"),
    ("RENAME TABLE accounts TO archived_accounts, users TO archived_users", "several_objects"),
    ("DROP TABLE accounts, users", "several_objects"),
    ("DROP TABLE a; DROP TABLE b", "several_statements"),
    ("ALTER TABLE a ADD COLUMN b TEXT COMMENT 'open", "unterminated_quote"),
    ("ALTER TABLE a ADD COLUMN b TEXT /* open", "unterminated_comment"),
    ("ALTER TABLE a /*!50100 ADD COLUMN b INT */", "active_comment"),
    ("ALTER /*+ hint */ TABLE a DROP b", "active_comment"), ("ALTER TABLE a DROP b /*M!100 x */", "active_comment"),
    ("SELECT 1", "statement"), ("CREATE TABLE a LIKE b", "statement"),
]


def test_what_is_not_in_the_grammar_has_an_error(spark):
    rows = parsed(spark, *[sql for sql, _ in ERRORS])
    assert [(r["error"], r["operation"]) for r in rows] == [(error, None) for _, error in ERRORS]


def test_comments_end_where_the_dialect_says(spark):
    """A double dash without white space behind it is no comment; the three forms are."""
    tokens = lambda sql: spark.createDataFrame([(sql,)], "s string").select(ddl.tokens(F.col("s"))).first()[0]
    got = tokens("CREATE INDEX idx ON accounts (handle) --not-a-comment.other")
    assert any(got[i : i + 2] == ["-", "-"] for i in range(len(got))) and "." in got
    assert "valid" not in tokens("CREATE INDEX idx ON accounts (handle) -- valid comment\n")
    assert tokens("CREATE /* block */ INDEX idx ON accounts (handle) # hash comment\n -- line comment\n") == ["CREATE", "INDEX", "idx", "ON", "accounts", "(", "handle", ")"]
    assert tokens("a 'it''s -- \\' `x`' \"q\"\"r\" `b``c`") == ["a", "'it''s -- \\' `x`'", '`q"r`', "`b``c`"]
    assert tokens("'" + "x" * 200_000 + "'" + "''" * 0) == ["'" + "x" * 200_000 + "'"]


def test_clauses_and_items(spark):
    rows = parsed(
        spark,
        "ALTER TABLE `t` ADD COLUMN IF NOT EXISTS `a` DECIMAL(10,2) NOT NULL DEFAULT '(,' AFTER `id`, ADD b ENUM('x','y') FIRST, DROP COLUMN c, DROP COLUMN IF EXISTS `d`, "
        "RENAME COLUMN e TO f, CHANGE g h INT(11) UNSIGNED, MODIFY COLUMN i TEXT AFTER h, ADD UNIQUE KEY `u` (`a`(10), b DESC), DROP INDEX u, ADD CONSTRAINT `fk` FOREIGN KEY (`a`) REFERENCES `p` (`x`, `y`) ON DELETE CASCADE, "
        "ADD CONSTRAINT `pos` CHECK (`id` > 0 AND (a, b) IN ((1, 2))), DROP CHECK pos, ADD PRIMARY KEY (`id`, a), DROP PRIMARY KEY, DROP FOREIGN KEY fk, RENAME TO `t2`, ENGINE=InnoDB",
    )
    assert [r["operation"] for r in rows] == ["add_column", "add_column", "drop_column", "drop_column", "rename_column", "change_column", "modify_column", "add_index", "drop_index", "add_foreign_key", "add_check", "drop_check", "add_primary_key", "drop_primary_key", "drop_foreign_key", "rename_table", "table_option"]
    assert {r["object"] for r in rows} == {"t"} and not any(r["error"] for r in rows)
    a, b = rows[:2]
    assert (a["name"], a["definition"], a["after"], a["guarded"], a["first"]) == ("a", "DECIMAL ( 10 , 2 ) NOT NULL DEFAULT '(,'", "id", True, False)
    assert (b["definition"], b["first"], b["after"]) == ("ENUM ( 'x' , 'y' )", True, None)
    assert rows[7]["columns"] == ["a", "b"] and rows[12]["columns"] == ["id", "a"] and rows[15]["new"] == "t2"
    made = parsed(spark, "CREATE TABLE IF NOT EXISTS m (`id` INT(11) NOT NULL, n VARCHAR(5) DEFAULT ',', total INT GENERATED ALWAYS AS ((id + 1) * 2) STORED, PRIMARY KEY (`id`), KEY k (n, id), CONSTRAINT c CHECK (n <> '')) ENGINE=InnoDB, COMMENT='a, b'")
    assert [(r["item"], r["operation"], r["name"]) for r in made] == [(0, "create_table", None), (1, "add_column", "id"), (2, "add_column", "n"), (3, "add_column", "total"), (4, "add_primary_key", None), (5, "add_index", "k"), (6, "add_check", "c")]
    bad = parsed(spark, "ALTER TABLE t ADD COLUMN a INT, ADD COLUMN (b INT, c INT), WHATEVER x", "ALTER TABLE t ADD COLUMN a DECIMAL(1,2")
    assert [r["error"] for r in bad] == [None, "clause", "clause", "unbalanced"]


def states(spark, *sqls):
    df = spark.createDataFrame(list(enumerate(sqls)), "id int, sql string")
    ops, state = ddl.apply_all(ddl.parse(df, ["id"]), ["id"])
    tables = {}
    for r in sorted(state.collect(), key=lambda r: (r["kind"], r["ordinal"] or 0)):
        if r["kind"] == "column":
            tables.setdefault(r["table_name"], []).append((r["name"], r["definition"]))
    return {(r["id"], r["item"]): (r["outcome"], r["said"], r["reason"]) for r in ops.collect()}, tables


BASE = "CREATE TABLE t (id INT, name TEXT, old INT, KEY by_old (old))"


def test_post_states(spark):
    ops, tables = states(spark, BASE, "ALTER TABLE t ADD COLUMN handle VARCHAR(64) AFTER id, DROP COLUMN IF EXISTS OLD, RENAME COLUMN name TO title, MODIFY id BIGINT, DROP COLUMN IF EXISTS gone")
    assert tables == {"t": [("id", "BIGINT"), ("handle", "VARCHAR ( 64 )"), ("title", "TEXT")]}
    assert [ops[1, i][:2] for i in range(1, 6)] == [("applied", "ADD COLUMN `handle` VARCHAR ( 64 ) AFTER `id`"), ("applied", "DROP COLUMN `old`"), ("applied", "RENAME COLUMN `name` TO `title`"), ("applied", "MODIFY id BIGINT"), ("no_op", None)]


def test_rename_chains_and_refusals(spark):
    ops, tables = states(
        spark,
        BASE,
        "ALTER TABLE t RENAME COLUMN name TO a, RENAME COLUMN a TO b, RENAME COLUMN IF EXISTS name TO c",
        "ALTER TABLE t ADD COLUMN x INT, RENAME COLUMN id TO old",  # both are there: nothing of it happens
        "RENAME TABLE t TO u",
        "ALTER TABLE t ADD COLUMN lost INT",  # t isn't there any more
        "ALTER TABLE u ADD COLUMN id INT",  # another place
        "ALTER TABLE u ADD COLUMN b TEXT AFTER id",  # the same column at its place
        "ALTER TABLE u ADD COLUMN IF NOT EXISTS b TEXT AFTER id, ADD COLUMN IF NOT EXISTS z INT",  # some there, some not
        "ALTER TABLE u DROP COLUMN gone",
        "RENAME TABLE u TO v",
        "CREATE TABLE t (k INT)",
        "CREATE TABLE IF NOT EXISTS v (k INT)",
        "ALTER TABLE v CHANGE old new BIGINT FIRST",
        "DROP TABLE t",
        "DROP TABLE IF EXISTS t",
    )
    outcome = {k[0]: v[0] for k, v in ops.items()}
    assert outcome == {0: "applied", 1: outcome[1], 2: "refused", 3: "applied", 4: "refused", 5: "refused", 6: "no_op", 7: "refused", 8: "refused", 9: "applied", 10: "applied", 11: "no_op", 12: "applied", 13: "applied", 14: "no_op"}
    assert [ops[1, i][0] for i in (1, 2, 3)] == ["applied", "applied", "no_op"] and "both" in ops[2, 2][2]
    assert tables == {"v": [("new", "BIGINT"), ("id", "INT"), ("b", "TEXT")]}


def test_states_follow_an_ordered_fold(spark):
    """Hundreds of tables with renames, against one fold in Python."""
    sqls, want = [], {}
    for t in range(40):
        name, cols = f"t{t}", ["id"]
        sqls.append(f"CREATE TABLE `{name}` (`id` INT)")
        for n in range(12):
            if (t + n) % 4 == 0:
                sqls.append(f"RENAME TABLE `{name}` TO `{name}x`")
                name += "x"
            elif (t + n) % 4 == 1:
                sqls.append(f"ALTER TABLE `{name}` RENAME COLUMN `{cols[-1]}` TO `r{n}`")
                cols[-1] = f"r{n}"
            else:
                sqls.append(f"ALTER TABLE `{name}` ADD COLUMN `c{n}` INT FIRST")
                cols.insert(0, f"c{n}")
        want[name] = [(c, "INT") for c in cols]
    assert states(spark, *sqls)[1] == want


def test_fingerprints_and_empty_tables(spark):
    df = spark.createDataFrame([(0, BASE), (1, "CREATE TABLE s (id INT, name TEXT, old INT, KEY by_old (old))"), (2, "CREATE TABLE d (id INT)")], "id int, sql string")
    ops, state = ddl.apply_all(ddl.parse(df, ["id"]), ["id"])
    prints = {r["table_name"]: r["fingerprint"] for r in ddl.fingerprints(state).collect()}
    assert prints["t"] == prints["s"] != prints["d"]
    none = ddl.parse(df.limit(0), ["id"])
    assert none.count() == 0 and ddl.apply_all(none, ["id"])[1].count() == 0


def test_closures(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s"), ("q", "gone"), (None, "a")], "child string, parent string")
    nodes = spark.createDataFrame([(c,) for c in "abcdxyzsq"], "node string")
    assert {r["node"]: r["level"] for r in closure.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "s": 0, "q": 0, "x": None, "y": None, "z": None}
    with pytest.raises(ValueError, match="x first"):
        closure.require_acyclic(nodes, edges)
    found = closure.dependents(spark.createDataFrame([("b",), ("x",)], "node string"), edges, nodes)
    assert {r["node"]: r["steps"] for r in found.collect()} == {"c": 1, "d": 2, "y": 1, "x": 2, "z": 2, "q": 1}
    lone = {r["node"]: r["component"] for r in closure.components(edges, "child", "parent").collect()}
    assert lone == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("xyz", "x"), "s": "s", "q": "gone", "gone": "gone"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a int, b int")
    assert {r["component"] for r in closure.components(chain).collect()} == {0}
    assert [tuple(r) for r in closure.missing_parents(nodes, edges).collect()] == [("q", "gone")]
    assert closure.levels(nodes.limit(0), edges).count() == 0 and closure.dependents(nodes.limit(0), edges).count() == 0
