"""Queries over schema inventories, dependency graphs, scalar functions and control tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import canonical as C
from keyloom.functions import scalars as fn
from keyloom.operators import graph
from keyloom.plans import control, render, schema_plan
from keyloom.plans.log_queries import values
from keyloom.plans.registry import query
from keyloom.session import read_table
from keyloom.sources import inventory as inv

# --- two inventories of a small schema: the source's and the target's -----------------------------------------------

U8, M8 = "utf8mb4_uca1400_ai_ci", "utf8mb4_0900_ai_ci"
COLUMN_NAMES = "table_name, ordinal, column_name, column_type, data_type, nullable, character_set, \"collation\", default_value, extra, generated"
SOURCE = [
    ("users", 1, "id", "bigint(20) unsigned", "bigint", False, None, None, None, "auto_increment", None),
    ("users", 2, "name", "varchar(64)", "varchar", False, "utf8mb4", U8, "''", "", None),
    ("users", 3, "status", "ENUM('Live','off')", "enum", True, "utf8mb4", U8, "'Live'", "", None),
    ("users", 4, "made", "timestamp", "timestamp", False, None, None, "current_timestamp()", "on update current_timestamp()", None),
    ("orders", 1, "id", "bigint(20)", "bigint", False, None, None, None, "", None),
    ("orders", 2, "user_id", "bigint(20) unsigned", "bigint", True, None, None, None, "", None),
    ("orders", 3, "price", "decimal(10,2)", "decimal", False, None, None, "0.00", "", None),
    ("orders", 4, "note", "varchar(20)", "varchar", True, "utf8mb4", U8, "NULL", "", None),
    ("orders", 5, "total", "decimal(12,2)", "decimal", True, None, None, None, "STORED GENERATED", "(`price` * 2)"),
    ("log", 1, "line", "text", "text", True, "utf8mb4", U8, None, "", None),
    ("items", 1, "id", "int(11)", "int", False, None, None, None, "", None),
    ("items", 2, "order_id", "int(11)", "int", False, None, None, None, "", None),
    ("tags", 1, "id", "smallint(6)", "smallint", False, None, None, None, "", None),
    ("tags", 2, "label", "varchar(10)", "varchar", True, "utf8mb4", U8, None, "", None),
    ("lonely", 1, "id", "int(11)", "int", False, None, None, None, "", None),
]
TARGET = [
    ("users", 1, "id", "bigint unsigned", "bigint", False, None, None, None, "auto_increment", None),
    ("users", 2, "name", "varchar(64)", "varchar", False, "utf8mb4", M8, "", "", None),
    ("users", 3, "status", "enum('Live','off')", "enum", True, "utf8mb4", M8, "Live", "", None),
    ("users", 4, "made", "datetime", "datetime", False, None, None, "CURRENT_TIMESTAMP", "DEFAULT_GENERATED on update CURRENT_TIMESTAMP", None),
    ("orders", 1, "id", "bigint", "bigint", False, None, None, None, "", None),
    ("orders", 2, "user_id", "bigint unsigned", "bigint", True, None, None, None, "", None),
    ("orders", 3, "price", "decimal(18,4)", "decimal", True, None, None, "0.00", "", None),
    ("orders", 4, "note", "varchar(80)", "varchar", True, "utf8mb4", M8, None, "", None),
    ("orders", 5, "total", "decimal(12,2)", "decimal", True, None, None, None, "STORED GENERATED", "`price`*2"),
    ("orders", 6, "old", "int", "int", True, None, None, None, "", None),
    ("log", 1, "line", "text", "text", True, "utf8mb4", M8, None, "", None),
    ("items", 1, "id", "bigint", "bigint", False, None, None, None, "", None),
    ("items", 2, "order_id", "int unsigned", "int", False, None, None, None, "", None),
    ("tags", 1, "id", "int", "int", False, None, None, None, "", None),
    ("tags", 2, "label", "varchar(40)", "varchar", True, "utf8mb4", M8, None, "", None),
]
KEYS = [("users", 1, "id"), ("orders", 1, "id"), ("items", 1, "id"), ("tags", 1, "id"), ("lonely", 1, "id")]
SRC, TGT = values(SOURCE, COLUMN_NAMES), values(TARGET, COLUMN_NAMES)
BOTH = f"s as (select * from {SRC}), t as (select * from {TGT})"


def _inv(spark):
    return inv.frame(spark, SOURCE, inv.COLUMNS), inv.frame(spark, TARGET, inv.COLUMNS)


def _canon(t: str) -> str:
    kind = r"regexp_replace(regexp_replace(case when strpos(column_type, '(') > 0 then lower(regexp_extract(column_type, '^([^(]*)', 1)) || regexp_extract(column_type, '(\(.*\))', 1) || lower(regexp_extract(column_type, '\)([^)]*)$', 1)) else lower(column_type) end, '^(tinyint|smallint|mediumint|int|integer|bigint)\([^)]*\) *', '\1 '), '^(\w+) +$', '\1')"
    return f"""(select table_name, ordinal, column_name, {kind} as column_type, nullable, character_set,
  case lower("collation") when 'utf8mb4_uca1400_ai_ci' then 'utf8mb4_0900_ai_ci' when 'utf8mb4_uca1400_as_cs' then 'utf8mb4_0900_as_cs' when 'utf8mb3_uca1400_ai_ci' then 'utf8mb3_general_ci' else lower("collation") end as "collation",
  case when lower(default_value) = 'null' then null when default_value like '''%''' and length(default_value) > 1 then replace(default_value[2:-2], '''''', '''') when lower(default_value) = 'current_timestamp()' then 'current_timestamp' when lower(default_value) like 'current_timestamp%' then lower(default_value) else default_value end as default_value,
  trim(regexp_replace(replace(replace(lower(extra), 'default_generated', ''), 'current_timestamp()', 'current_timestamp'), '\\s+', ' ', 'g')) as extra,
  translate(replace(replace(lower(generated), '_utf8mb4', ''), '_utf8mb3', ''), '() ' || chr(9) || chr(10) || chr(92), '') as generated from {t})"""


CANON = f"with {BOTH}, a as {_canon('s')}, b as {_canon('t')}"
ATTR = ["column_type", "nullable", "character_set", "collation", "default_value", "extra", "generated"]
DIFFERS = "concat_ws(',', " + ", ".join(f"case when a.\"{x}\" is distinct from b.\"{x}\" then '{x}' end" for x in ATTR) + ")"
ACTION = f"case when b.table_name is null then 'add' when a.table_name is null then 'drop' when {DIFFERS} <> '' then 'modify' else 'same' end"


@query("inventory_columns", "select 'orders' as table_name, 6::bigint as columns, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' as names")
def inventory_columns(spark, d):
    c = inv.ordered_columns(inv.columns_of(read_table(spark, d, "orders"), "orders"))
    return c.select("table_name", F.size("columns").cast("long").alias("columns"), F.array_join("columns", ",").alias("names"))


@query("inventory_grouped", f"with {BOTH} select table_name, string_agg(column_name, ',' order by ordinal) as names, string_agg(column_name, ',' order by ordinal) filter (where generated is null) as writable from s group by 1")
def inventory_grouped(spark, d):
    s, _ = _inv(spark)
    w = inv.writable_columns(s).withColumnRenamed("columns", "w")
    return inv.ordered_columns(s).join(w, "table_name").select("table_name", F.array_join("columns", ",").alias("names"), F.array_join("w", ",").alias("writable"))


@query("inventory_of_table", f"with {BOTH} select column_name, ordinal::int as ordinal from s where table_name = 'orders'")
def inventory_of_table(spark, d):
    return inv.of_table(_inv(spark)[0], "orders").select("column_name", "ordinal")


@query("estimated_rows", "select 'orders' as table_name, count(*) as rows from orders union all select 'customer', count(*) from customer union all select 'nation', count(*) from nation")
def estimated_rows(spark, d):
    out = None
    for t in ("orders", "customer", "nation"):
        part = read_table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("canonical_columns", f"{CANON} select table_name, column_name, column_type, \"collation\", default_value, extra, generated from a")
def canonical_columns(spark, d):
    return schema_plan.canonical_columns(_inv(spark)[0]).select("table_name", "column_name", "column_type", "collation", "default_value", "extra", "generated")


@query("schema_diff", f"{CANON} select coalesce(a.table_name, b.table_name) as table_name, coalesce(a.column_name, b.column_name) as column_name, {ACTION} as action, case when a.table_name is null or b.table_name is null then '' else {DIFFERS} end as attributes from a full join b on a.table_name = b.table_name and a.column_name = b.column_name")
def schema_diff(spark, d):
    return schema_plan.column_diff(*_inv(spark))


PREFLIGHT = [("users", "id", False), ("users", "name", False), ("users", "status", False), ("users", "made", False), ("orders", "id", False), ("orders", "user_id", False), ("orders", "price", True), ("orders", "note", True), ("orders", "total", False), ("log", "line", False), ("items", "id", True), ("items", "order_id", True), ("tags", "id", True), ("tags", "label", True)]


@query("schema_needs_preflight", f"select * from {values(PREFLIGHT, 'table_name, column_name, needs_preflight')}")
def schema_needs_preflight(spark, d):
    return schema_plan.needs_preflight(*_inv(spark))


COMPATIBLE = [("users", False), ("orders", False), ("log", True), ("items", False), ("tags", True)]


@query("schema_compatibility", f"select * from {values(COMPATIBLE, 'table_name, compatible')}")
def schema_compatibility(spark, d):
    s, t = _inv(spark)
    keys = inv.frame(spark, KEYS, inv.KEYS)
    return schema_plan.compatible(s, t, keys, keys.where("table_name <> 'lonely'"))


@query("schema_fingerprints", f"""{CANON} select table_name, sha256(string_agg(lpad(ordinal::varchar, 5, '0') || '|' || column_name || '|' || column_type || '|' || nullable::varchar || '|' || coalesce("collation", '-') || '|' || coalesce(default_value, '-') || '|' || extra || '|' || coalesce(generated, '-'), chr(10) order by ordinal)) as fingerprint from a group by 1""")
def schema_fingerprints(spark, d):
    return schema_plan.fingerprints(_inv(spark)[0])


INDEX_NAMES = "table_name, index_name, is_unique, index_type, visible, sequence, column_name, prefix_length"
SOURCE_INDEXES = [("users", "PRIMARY", True, "BTREE", True, 1, "id", None), ("users", "by_name", True, "BTREE", True, 1, "name", None), ("orders", "PRIMARY", True, "BTREE", True, 1, "id", None), ("orders", "by_user", False, "BTREE", True, 1, "user_id", None), ("orders", "by_user", False, "BTREE", True, 2, "note", 5)]
TARGET_INDEXES = [("users", "PRIMARY", True, "BTREE", True, 1, "id", None), ("users", "by_name", False, "BTREE", True, 1, "name", None), ("orders", "PRIMARY", True, "BTREE", True, 1, "id", None), ("orders", "by_user", False, "BTREE", True, 1, "user_id", None), ("orders", "by_user", False, "BTREE", True, 2, "note", 5), ("orders", "spare", False, "BTREE", True, 1, "old", None), ("orders", "gap", False, "BTREE", True, 1, "old", None), ("orders", "gap", True, "BTREE", True, 3, "id", None)]
INDEX_SQL = "select table_name, index_name, min(is_unique::int) as u, string_agg(column_name || coalesce(':' || prefix_length, ''), ',' order by sequence) as cols from {} group by 1, 2"


def _indexes(spark):
    both = [inv.grouped_indexes(inv.frame(spark, x, inv.INDEXES)) for x in (SOURCE_INDEXES, TARGET_INDEXES)]
    return [x.withColumn("name", F.col("index_name")).withColumn("cols", F.to_json("columns")) for x in both]


def _index_diff(spark):
    s, t = _indexes(spark)
    return schema_plan.object_diff(s, t.where("consistent"), ["table_name", "name", "is_unique", "index_type", "visible", "cols"], ["table_name", "name"])


@query("index_groups", f"select table_name, index_name, string_agg(column_name, ',' order by sequence) as columns, count(distinct (is_unique, index_type, visible)) = 1 and max(sequence) = count(*) as consistent from {values(TARGET_INDEXES, INDEX_NAMES)} group by 1, 2")
def index_groups(spark, d):
    g = inv.grouped_indexes(inv.frame(spark, TARGET_INDEXES, inv.INDEXES))
    return g.select("table_name", "index_name", F.array_join(F.transform("columns", lambda x: x["column_name"]), ",").alias("columns"), "consistent")


@query("index_diff", f"with a as ({INDEX_SQL.format(values(SOURCE_INDEXES, INDEX_NAMES))}), b as ({INDEX_SQL.format(values(TARGET_INDEXES, INDEX_NAMES))}) select 'drop' as action, table_name, index_name as name from (select * from b except select * from a) where index_name <> 'gap' union all select 'create', table_name, index_name from (select * from a except select * from b)")
def index_diff(spark, d):
    return _index_diff(spark)


REFERENCE_NAMES = "constraint_name, child_schema, child_table, ordinal, child_column, parent_schema, parent_table, parent_column"
SOURCE_REFERENCES = [("fk_user", "src", "orders", 1, "user_id", "src", "users", "id"), ("fk_pair", "src", "items", 1, "order_id", "src", "orders", "id"), ("fk_pair", "src", "items", 2, "id", "src", "orders", "user_id"), ("fk_out", "src", "tags", 1, "id", "other", "words", "id"), ("fk_self", "src", "users", 1, "id", "src", "users", "id")]
TARGET_REFERENCES = [("fk_user", "tgt", "orders", 1, "user_id", "tgt", "users", "id"), ("fk_old", "tgt", "orders", 1, "old", "tgt", "tags", "id"), ("fk_self", "tgt", "users", 1, "id", "tgt", "users", "id")]
RULE_NAMES = "child_schema, constraint_name, child_table, update_rule, delete_rule, match_option"
RULES = [("src", "fk_user", "orders", "NO ACTION", "cascade", "NONE"), ("src", "fk_pair", "items", "RESTRICT", "NO ACTION", "NONE"), ("tgt", "fk_user", "orders", "RESTRICT", "CASCADE", "NONE"), ("tgt", "fk_old", "orders", "SET NULL", "RESTRICT", "NONE")]


def _references(spark):
    rules = inv.frame(spark, RULES, inv.RULES)
    return [inv.grouped_references(inv.frame(spark, x, inv.REFERENCES), rules) for x in (SOURCE_REFERENCES, TARGET_REFERENCES)]


def _reference_sql(rows):
    rule = lambda c: f"case when upper(coalesce({c}, 'RESTRICT')) = 'NO ACTION' then 'RESTRICT' else upper(coalesce({c}, 'RESTRICT')) end"
    return f"""select child_schema, child_table, constraint_name, child_columns, parent_schema, parent_table, parent_columns, {rule('update_rule')} as update_rule, {rule('delete_rule')} as delete_rule from (
  select child_schema, child_table, constraint_name, string_agg(child_column, ',' order by ordinal) as child_columns, min(parent_schema) as parent_schema, min(parent_table) as parent_table, string_agg(parent_column, ',' order by ordinal) as parent_columns from {values(rows, REFERENCE_NAMES)} group by 1, 2, 3)
  left join (select * from {values(RULES, RULE_NAMES)}) using (child_schema, child_table, constraint_name)"""


@query("canonical_references", _reference_sql(SOURCE_REFERENCES))
def canonical_references(spark, d):
    return _references(spark)[0].drop("match_option", "consistent")


REFERENCE_KEY = ["table_name", "name", "child_columns", "parent", "parent_table", "parent_columns", "update_rule", "delete_rule"]


def _reference_diff(spark):
    s, t = _references(spark)
    name = lambda df, own: df.withColumns({"table_name": F.col("child_table"), "name": F.col("constraint_name"), "parent": inv.relative(F.col("parent_schema"), own)})
    return schema_plan.object_diff(name(s, "src"), name(t, "tgt"), REFERENCE_KEY, ["table_name", "name"])


@query("reference_diff", "select * from (values ('drop', 'orders', 'fk_old'), ('create', 'items', 'fk_pair'), ('create', 'tags', 'fk_out')) v(action, table_name, name)")
def reference_diff(spark, d):
    return _reference_diff(spark)


SOURCE_CHECKS = [("orders", "c_price", "(`price` >= 0)"), ("users", "c_name", "length(`name`) > 0"), ("tags", "c_label", "`label` <> _utf8mb4'x'")]
TARGET_CHECKS = [("orders", "c_price", "(`price`>=0)"), ("users", "c_name", "length(`name`) > 1"), ("tags", "c_label", "(`label` <> 'x')"), ("tags", "c_old", "1 = 1")]


def _check_diff(spark):
    s, t = (inv.frame(spark, x, inv.CHECKS).withColumns({"name": F.col("check_name"), "canonical": C.expression(F.col("clause"))}) for x in (SOURCE_CHECKS, TARGET_CHECKS))
    return schema_plan.object_diff(s, t, ["table_name", "name", "canonical"], ["table_name", "name"])


@query("check_diff", "select * from (values ('drop', 'users', 'c_name'), ('create', 'users', 'c_name'), ('drop', 'tags', 'c_old')) v(action, table_name, name)")
def check_diff(spark, d):
    return _check_diff(spark)


def _plan(spark):
    cols = schema_plan.column_diff(*_inv(spark)).withColumnRenamed("column_name", "name")
    return schema_plan.plan(cols, _index_diff(spark), _reference_diff(spark), _check_diff(spark))


PLAN_SQL = f"""{CANON}, c as (select coalesce(a.table_name, b.table_name) as table_name, coalesce(a.column_name, b.column_name) as name, {ACTION} as action from a full join b on a.table_name = b.table_name and a.column_name = b.column_name),
  o as (select * from (values ('index', 'drop', 'users', 'by_name'), ('index', 'create', 'users', 'by_name'), ('index', 'drop', 'orders', 'spare'), ('foreign_key', 'drop', 'orders', 'fk_old'), ('foreign_key', 'create', 'items', 'fk_pair'), ('foreign_key', 'create', 'tags', 'fk_out'),
    ('check', 'drop', 'users', 'c_name'), ('check', 'create', 'users', 'c_name'), ('check', 'drop', 'tags', 'c_old')) v(kind, action, table_name, name)),
  p as (select 1 as phase, table_name, action, 'column' as kind, name from c where action <> 'same' union all select case when kind = 'index' then 2 when action = 'drop' then 0 else 3 end, table_name, action, kind, name from o)"""


@query("schema_plan", f"{PLAN_SQL} select * from p")
def schema_plan_query(spark, d):
    return _plan(spark)


#: A catalog with a table for each customer. The target lacks some tables and columns, has one more, or a shorter type.
CUSTOMER_TABLES_SQL = """k as (select c_custkey as k, 't' || c_custkey as table_name, 'varchar(' || 10 + c_nationkey || ')' as wide from customer),
  src as (select k, table_name, 1 as ordinal, 'id' as column_name, 'bigint NOT NULL AUTO_INCREMENT' as def from k
    union all select k, table_name, 2, 'name', wide || ' CHARACTER SET utf8mb4 COLLATE utf8mb4_bin NULL' from k
    union all select k, table_name, 3, 'amount', 'decimal(10,2) NOT NULL DEFAULT ''0.00''' from k
    union all select k, table_name, 4, 'made', 'timestamp NOT NULL DEFAULT CURRENT_TIMESTAMP' from k)"""


def _customer_tables(spark, d):
    k = read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("table_name"), F.concat(F.lit("varchar("), (F.col("c_nationkey") + 10).cast("string"), F.lit(")")).alias("wide"))
    own = [(1, "id", "bigint", "bigint", False, None, None, None, "auto_increment"), (2, "name", None, "varchar", True, "utf8mb4", "utf8mb4_bin", None, ""), (3, "amount", "decimal(10,2)", "decimal", False, None, None, "0.00", ""), (4, "made", "timestamp", "timestamp", False, None, None, "CURRENT_TIMESTAMP", "DEFAULT_GENERATED")]
    names = "ordinal int, column_name string, column_type string, data_type string, nullable boolean, character_set string, collation string, default_value string, extra string"
    rows = lambda cols: k.join(F.broadcast(spark.createDataFrame(cols, names))).withColumns({"column_type": F.coalesce("column_type", "wide"), "generated": F.lit(None).cast("string")}).drop("wide")
    source = rows(own)
    target = source.where("k % 7 <> 0 and not (k % 5 = 0 and column_name = 'amount')")
    target = target.withColumn("column_type", F.when((F.col("column_name") == "name") & (F.col("k") % 3 == 0), "varchar(5)").otherwise(F.col("column_type")))
    more = rows([(5, "old", "int", "int", True, None, None, None, "")]).where("k % 7 <> 0 and k % 11 = 0")
    return source.drop("k"), target.unionByName(more).drop("k")


@query("schema_statements", f"""with {CUSTOMER_TABLES_SQL}
  select 1 as phase, table_name, 'table:' || table_name as object, 'CREATE TABLE `' || table_name || '` (' || string_agg('`' || column_name || '` ' || def, ', ' order by ordinal) || ', PRIMARY KEY (`id`))' as statement, '' as needs from src where k % 7 = 0 group by table_name
  union all select 2, table_name, 'column:' || table_name || '.amount', 'ALTER TABLE `' || table_name || '` ADD COLUMN `amount` ' || def || ' AFTER `name`', 'column:' || table_name || '.name' from src where k % 7 <> 0 and k % 5 = 0 and column_name = 'amount'
  union all select 2, table_name, 'column:' || table_name || '.name', 'ALTER TABLE `' || table_name || '` MODIFY COLUMN `name` ' || def, '' from src where k % 7 <> 0 and k % 3 = 0 and column_name = 'name'
  union all select 2, table_name, 'column:' || table_name || '.old', 'ALTER TABLE `' || table_name || '` DROP COLUMN `old`', '' from k where k % 7 <> 0 and k % 11 = 0""")
def schema_statements(spark, d):
    """Statements for a catalog with a table for each customer."""
    source, target = _customer_tables(spark, d)
    keys = source.where("column_name = 'id'").select("table_name", "ordinal", "column_name")
    out = render.statements(render.column_statements(source, target, keys))
    return out.select("phase", "table_name", "object", "statement", F.array_join("needs", ",").alias("needs"))


@query("schema_plan_stages", f"{PLAN_SQL} select case when phase <= 2 then 'prerequisite_schema' else 'final_constraints' end as stage, count(*) as statements from p group by 1")
def schema_plan_stages(spark, d):
    p = _plan(spark)
    one = lambda df, n: df.agg(F.lit(n).alias("stage"), F.count("*").alias("statements"))
    return one(schema_plan.prerequisite_stage(p), "prerequisite_schema").unionByName(one(schema_plan.final_stage(p), "final_constraints"))


@query("schema_status", "select 'partial' as status, 2::bigint as converged_tables, 3::bigint as tables")
def schema_status(spark, d):
    return schema_plan.status(spark.createDataFrame([("a", True), ("b", False), ("c", True)], "table_name string, converged boolean"))


@query("schema_post_state", "select * from (values ('t', 1, 'id', 'bigint'), ('t', 2, 'handle', 'varchar(64)'), ('t', 3, 'title', 'text')) v(table_name, ordinal, column_name, column_type)")
def schema_post_state(spark, d):
    t = schema_plan.TableState((("id", "int"), ("name", "text"), ("old", "int")), (("by_old", ("old",)),))
    t = t.add_column("handle", "varchar(64)", after="id").drop_column("OLD").rename_column("name", "title").modify_column("id", "bigint").drop_column("gone", if_exists=True)
    return spark.createDataFrame(t.rows("t"), "table_name string, ordinal int, column_name string, column_type string")


# --- graph -----------------------------------------------------------------------------------------------------------


def _edges(spark):
    s, t = (inv.frame(spark, x, inv.REFERENCES) for x in (SOURCE_REFERENCES, TARGET_REFERENCES))
    return inv.dependency_edges(s, t, "src", "tgt")


EDGES = "with recursive e as (select distinct * from (values ('orders', 'users', false), ('items', 'orders', false), ('tags', 'words', true), ('users', 'users', false), ('orders', 'tags', false)) v(child, parent, cross_schema))"


@query("dependency_edges", f"{EDGES} select * from e")
def dependency_edges(spark, d):
    return _edges(spark)


TABLES = ["users", "orders", "items", "tags", "log", "lonely"]


@query("topological_levels", f"{EDGES}, n as (select unnest({TABLES}) as t), r as (select t, 0 as l from n union all select e.child, r.l + 1 from r join e on e.parent = r.t and e.child <> e.parent) select t as table_name, max(l)::int as level from r group by 1")
def topological_levels(spark, d):
    local = [(r["child"], r["parent"]) for r in _edges(spark).where("not cross_schema").collect()]  # one row a reference of the schema
    return spark.createDataFrame(sorted(graph.require_acyclic(TABLES, local).items()), "table_name string, level int")


def _reasons(spark):
    """Why tables can't be synchronised: rows (table_name, reason) of the tables' own faults."""
    s, t = _inv(spark)
    keys = inv.frame(spark, KEYS, inv.KEYS)
    ok = schema_plan.compatible(s, t, keys, keys.where("table_name <> 'lonely'"))
    tables = s.select("table_name").distinct()
    facts = tables.join(ok, "table_name", "left").join(keys.select("table_name", F.lit(True).alias("keyed")).distinct(), "table_name", "left")
    facts = facts.join(s.where("generated is not null").select("table_name", F.lit(True).alias("computed")).distinct(), "table_name", "left").join(t.select("table_name", F.lit(True).alias("there")).distinct(), "table_name", "left")
    facts = facts.join(_edges(spark).where("cross_schema").select(F.col("child").alias("table_name"), F.lit(True).alias("abroad")).distinct(), "table_name", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = F.array_compact(F.array(F.when(~no("keyed"), "missing_primary_key"), F.when(~no("there"), "missing_target_table"), F.when(no("there") & ~no("compatible"), "incompatible_schema"), F.when(no("computed"), "unsupported_generated_columns"), F.when(no("abroad"), "cross_schema_dependency")))
    return facts.select("table_name", reasons.alias("reasons"))


REASON_ORDER = ["missing_primary_key", "missing_target_table", "incompatible_schema", "unsupported_generated_columns", "cross_schema_dependency", "dependency_on_non_syncable"]


def _catalog(spark):
    own = {r["table_name"]: set(r["reasons"]) for r in _reasons(spark).collect()}  # one row a table of the schema
    local = [(r["child"], r["parent"]) for r in _edges(spark).where("not cross_schema").collect()]
    out = graph.excluded_with_parents({k: v for k, v in own.items() if v}, own, local, REASON_ORDER[-1])
    return own, out, local


@query("catalog_non_syncable", "select * from (values ('users', 'incompatible_schema'), ('orders', 'incompatible_schema,unsupported_generated_columns,dependency_on_non_syncable'), ('log', 'missing_primary_key'), ('items', 'incompatible_schema,dependency_on_non_syncable'), ('tags', 'cross_schema_dependency'), ('lonely', 'missing_target_table')) v(table_name, reasons)")
def catalog_non_syncable(spark, d):
    _, out, _ = _catalog(spark)
    return spark.createDataFrame([(t, ",".join(r for r in REASON_ORDER if r in why)) for t, why in sorted(out.items())], "table_name string, reasons string")


@query("catalog_syncable", "select 'customer' as table_name, (select count(*) from customer) as estimated_rows, 'nation' as parents union all select 'nation', (select count(*) from nation), 'region' union all select 'region', (select count(*) from region), ''")
def catalog_syncable(spark, d):
    edges = {"customer": ["nation"], "nation": ["region"], "region": []}
    excluded = graph.excluded_with_parents({"lineitem": {REASON_ORDER[0]}}, [*edges, "lineitem"], [(c, p) for c, ps in edges.items() for p in ps], REASON_ORDER[-1])
    out = None
    for t, parents in edges.items():
        if t not in excluded:
            part = read_table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("estimated_rows"), F.lit(",".join(parents)).alias("parents"))
            out = part if out is None else out.unionByName(part)
    return out.orderBy("estimated_rows", "table_name")


@query("selection_missing_parents", "select * from (values ('items', 'orders'), ('orders', 'tags')) v(child, parent) where child = 'items'")
def selection_missing_parents(spark, d):
    local = [(r["child"], r["parent"]) for r in _edges(spark).where("not cross_schema").collect()]
    return spark.createDataFrame(graph.missing_parents(["items", "users"], local), "child string, parent string")


@query("prerequisite_skipping", "select * from (values (0, 'drop_fk', 'run'), (1, 'alter', 'failed'), (2, 'index', 'skipped'), (3, 'fk', 'skipped'), (4, 'other', 'run')) v(n, name, state)")
def prerequisite_skipping(spark, d):
    s = graph.runnable([("drop_fk", (), False), ("alter", ("drop_fk",), True), ("index", ("alter",), False), ("fk", ("index", "drop_fk"), False), ("other", (), False)])
    return spark.createDataFrame([(i, *x) for i, x in enumerate(s)], "n int, name string, state string")


@query("synthesised_parent_keys", "select * from (values ('orders', 'id,user_id'), ('words', 'id')) v(table_name, columns)")
def synthesised_parent_keys(spark, d):
    refs = [(r["parent_table"], tuple(r["parent_columns"].split(","))) for r in _references(spark)[0].collect()]
    unique: dict = {}
    for r in inv.grouped_indexes(inv.frame(spark, SOURCE_INDEXES, inv.INDEXES)).where("is_unique").collect():
        unique.setdefault(r["table_name"], []).append(tuple(c["column_name"] for c in r["columns"]))
    return spark.createDataFrame([(t, ",".join(c)) for t, c in graph.synthesised_parent_keys(unique, refs)], "table_name string, columns string")


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("fn_sign_extend", "select event_id, case when (event_id * 7919) % 16777216 >= 8388608 then (event_id * 7919) % 16777216 - 16777216 else (event_id * 7919) % 16777216 end as v from events")
def fn_sign_extend(spark, d):
    return read_table(spark, d, "events").select("event_id", fn.sign_extend_24((F.col("event_id") * 7919) % 16777216).alias("v"))


@query("fn_as_signed", "select event_id, case when event_id % 256 >= 128 then event_id % 256 - 256 else event_id % 256 end as b, case when event_id % 2 = 0 then event_id else event_id - 9223372036854775807 - 1 end as l from events")
def fn_as_signed(spark, d):
    k = F.col("event_id")
    wide = F.when(k % 2 == 0, k.cast("decimal(20,0)")).otherwise(k.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)"))
    return read_table(spark, d, "events").select("event_id", fn.as_signed(k % 256, 8).alias("b"), fn.as_signed(wide, 64).alias("l"))


@query("fn_pack_bytes", "select event_id, printf('%04X', sum) as v from (select event_id, (select sum(case when (event_id // (i + 1)) % 2 = 1 then 1 << (9 - i) else 0 end)::int from range(0, 10) r(i)) as sum from events)")
def fn_pack_bytes(spark, d):
    """Ten bits fill two bytes."""
    bits = F.array(*[F.floor(F.col("event_id") / (i + 1)) % 2 == 1 for i in range(10)])
    return read_table(spark, d, "events").select("event_id", fn.pack_bytes(bits).alias("v"))


@query("fn_value_text", "select o_orderkey, coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') as day, coalesce(strftime(o_orderdate + interval 90 second, '%Y-%m-%d %H:%M:%S'), '') as moment, coalesce(nullif(o_orderpriority, '1-URGENT'), '') as priority from orders")
def fn_value_text(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    later = F.timestamp_micros(F.unix_micros(at) + 90_000_000)
    return read_table(spark, d, "orders").select("o_orderkey", fn.value_text(at).alias("day"), fn.value_text(later).alias("moment"), fn.value_text(F.nullif("o_orderpriority", F.lit("1-URGENT"))).alias("priority"))


@query("fn_duration_text", "select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then '-' else '' end || case when h < 100 then lpad(h::varchar, 2, '0') else h::varchar end || ':' || lpad((l_orderkey % 60)::varchar, 2, '0') || ':' || lpad((l_linenumber % 60)::varchar, 2, '0') as v from (select *, 24 * (l_orderkey % 9) + l_linenumber as h from lineitem)")
def fn_duration_text(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.duration_text(k % 9, n, k % 60, n % 60, n % 2 == 0).alias("v"))


@query("fn_pack_bits", "select event_id, (event_id % 2) * 4 + (event_id % 3 = 0)::int * 2 + (event_id % 5 = 0)::int as v from events")
def fn_pack_bits(spark, d):
    k = F.col("event_id")
    return read_table(spark, d, "events").select("event_id", fn.pack_bits(F.array(k % 2 == 1, k % 3 == 0, k % 5 == 0)).alias("v"))


@query("fn_enum_label", "select event_id, case event_id % 4 when 0 then '' when 1 then 'draft' when 2 then 'live''s' else 'old' end as label from events")
def fn_enum_label(spark, d):
    labels = fn.parse_labels("ENUM('draft','live''s','old')")
    return read_table(spark, d, "events").select("event_id", fn.enum_label(F.col("event_id") % 4, labels).alias("label"))


@query("fn_time_text", "select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%d %H:%M:%S') as second, case when (epoch_us(ts) % 1000000) < 1000 then strftime(ts, '%Y-%m-%d %H:%M:%S') else strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(((epoch_us(ts) % 1000000) // 1000)::varchar, 3, '0') end as milli from events")
def fn_time_text(spark, d):
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    return read_table(spark, d, "events").select("event_id", fn.date_text(F.unix_date(F.to_date("ts"))).alias("day"), fn.timestamp_text(F.floor(u / 1000)).alias("second"), fn.datetime_text(u).alias("milli"))


TEXTS = [(0, "a`b", "it's \\ x", "log.000123", "Duplicate entry '1' for key 'users.by_name'", "12.000000"), (1, "plain", None, "log", "fails (`db`.`c`, CONSTRAINT `fk_1` FOREIGN KEY)", "12.0000001"), (2, "", "a b", "x.7", "other", ".000000")]
TEXT_NAMES = "n, name, body, file, error, value"


@query("fn_text", f"""select n::int as n, '`' || replace(name, '`', '``') || '`' as name, coalesce('''' || replace(replace(body, chr(92), chr(92) || chr(92)), '''', '''''') || '''', 'NULL') as literal, nullif(regexp_extract(file, '\\.([0-9]+)$', 1), '')::bigint as number,
  nullif(regexp_extract(error, 'for key ''([^'']+)''', 1), '') as duplicate, nullif(regexp_extract(error, 'CONSTRAINT `([^`]+)`', 1), '') as failed, regexp_replace(value, '\\.000000$', '') as value, replace(body, ' ', '_') as word from {values(TEXTS, TEXT_NAMES)}""")
def fn_text(spark, d):
    t = spark.createDataFrame(TEXTS, "n int, name string, body string, file string, error string, value string")
    return t.select("n", fn.quote_name(F.col("name")).alias("name"), fn.quote_literal(F.col("body")).alias("literal"), fn.log_number(F.col("file")).alias("number"), fn.duplicate_index(F.col("error")).alias("duplicate"), fn.failed_constraint(F.col("error")).alias("failed"), fn.evidence_value(F.col("value")).alias("value"), fn.log_word(F.col("body")).alias("word"))


@query("fn_short_name", """with x as (select c_custkey, 'customer_with_a_rather_long_table_name' as t, 'fk_' || c_name || '_to_another_table' as n from customer), q as (select *, t || '_' || n as f from x)
  select c_custkey, case when length(f) <= 64 then f else f[1:47] || '_' || sha256('check' || chr(0) || t || chr(0) || n)[1:16] end as name from q""")
def fn_short_name(spark, d):
    t, n = F.lit("customer_with_a_rather_long_table_name"), F.concat(F.lit("fk_"), F.col("c_name"), F.lit("_to_another_table"))
    return read_table(spark, d, "customer").select("c_custkey", fn.short_name(F.lit("check"), t, n).alias("name"))


@query("fn_types", f"""with {BOTH} select table_name, column_name, coalesce(nullif(regexp_extract(column_type, '\\((\\d+)', 1), '')::bigint, 9223372036854775807) as capacity,
  case data_type when 'tinyint' then 1 when 'smallint' then 2 when 'mediumint' then 3 when 'int' then 4 when 'bigint' then 5 else 0 end as rank, not contains(lower(column_type), 'unsigned') as signed, split_part("collation", '_', 1) as charset, case when contains(upper(extra), 'STORED') then 'STORED' else 'VIRTUAL' end as generation from s""")
def fn_types(spark, d):
    s, _ = _inv(spark)
    t = F.col("column_type")
    return s.select("table_name", "column_name", C.capacity(t).alias("capacity"), C.integer_rank(F.col("data_type")).alias("rank"), C.is_signed(t).alias("signed"), C.character_set(F.col("collation")).alias("charset"), C.generation_kind(F.col("extra")).alias("generation"))


# --- control plane ---------------------------------------------------------------------------------------------------

FRAME = lambda *c: " || ".join(f"unhex(lpad(hex(octet_length(encode({x}))), 16, '0')) || encode({x})" for x in c)


@query("conflict_identity", f"select o_orderkey, sha256({FRAME(chr(39) + 'src' + chr(39), 'o_orderkey::varchar', 'o_orderstatus')}) as identity from orders")
def conflict_identity(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", control.conflict_id(F.lit("src"), F.col("o_orderkey"), F.col("o_orderstatus")).alias("identity"))


@query("run_identity", f"select n_nationkey, 'sync-v1-' || sha256({FRAME(chr(39) + 'run' + chr(39), 'n_name', 'n_nationkey::varchar')}) as run_id from nation")
def run_identity(spark, d):
    return read_table(spark, d, "nation").select("n_nationkey", control.run_id(F.col("n_name"), F.col("n_nationkey")).alias("run_id"))


HISTORY = [("a", 1, "translation_pending"), ("a", 2, "prepared"), ("a", 3, "applied"), ("a", 4, "checkpointed"), ("b", 1, "prepared"), ("b", 2, "blocked"), ("b", 3, "checkpointed"), ("c", 1, "applied"), ("d", 1, "prepared"), ("d", 2, "applied"), ("d", 3, "prepared")]


def _violations(name, allowed, rows):
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in allowed)

    @query(name, f"with h as (select *, coalesce(lag(status) over (partition by id order by seq), '') as before from {values(rows, 'id, seq, status')}) select id, seq::int as seq, before, status from h anti join (values {pairs}) p(a, b) on before = a and status = b")
    def run(spark, d):
        return control.violations(spark.createDataFrame(rows, "id string, seq int, status string"), allowed, ["id"]).select("id", "seq", "before", "status")

    return run


_violations("journal_violations", control.JOURNAL, HISTORY)
_violations("ledger_violations", control.LEDGER, [("a", 1, "unresolved"), ("a", 2, "unresolved"), ("a", 3, "resolved"), ("b", 1, "resolved"), ("c", 1, "unresolved"), ("c", 2, "resolved"), ("c", 3, "unresolved")])
_violations("recovery_violations", control.RECOVERY, [("a", 1, "prepared"), ("a", 2, "committed"), ("a", 3, "verified"), ("b", 1, "prepared"), ("b", 2, "abandoned"), ("b", 3, "committed"), ("c", 1, "committed")])
_violations("run_violations", control.RUN, [("a", 1, "running"), ("a", 2, "running"), ("a", 3, "complete"), ("b", 1, "running"), ("b", 2, "error"), ("b", 3, "running"), ("c", 1, "complete")])

LEDGER_STEPS = [(0, None, None, None, None, "unresolved", 1, None, None, True), (1, "unresolved", 1, None, None, "unresolved", 2, None, None, True), (2, "unresolved", 2, None, None, "resolved", 2, "r1", "e", True), (3, "unresolved", 2, None, None, "resolved", 2, None, "e", False), (4, "resolved", 2, "r1", "e", "resolved", 3, "r1", "e", False), (5, None, None, None, None, "resolved", 1, "r", "e", False), (6, "unresolved", 1, None, None, "unresolved", 1, None, None, False)]


@query("ledger_steps", f"select n, valid from {values(LEDGER_STEPS, 'n, os, oa, orun, oe, ns, na, nrun, ne, valid')}")
def ledger_steps(spark, d):
    t = spark.createDataFrame([x[:-1] for x in LEDGER_STEPS], "n int, os string, oa int, orun string, oe string, ns string, na int, nrun string, ne string")
    s = lambda p: F.struct(F.col(f"{p}s").alias("status"), F.col(f"{p}a").alias("attempts"), F.col(f"{p}run").alias("run_id"), F.col(f"{p}e").alias("evidence"))
    return t.withColumns({"old": F.when(F.col("os").isNotNull(), s("o")), "new": s("n")}).select("n", control.ledger_step(F.col("old"), F.col("new")).alias("valid"))


STATES = [(0, "p", "e", "e"), (1, "p", "p", "p"), (2, "p", "e", "p"), (3, "p", "e", "x")]


@query("prepared_reconciliation", f"select n, case when o = e and p <> e then 'proven' when o = e then 'blocked: no change to tell' when o = p then 'blocked: still in the state before' else 'blocked: unknown state' end as outcome from {values(STATES, 'n, p, e, o')}")
def prepared_reconciliation(spark, d):
    return spark.createDataFrame(STATES, "n int, p string, e string, o string").select("n", control.reconcile_prepared(F.col("p"), F.col("e"), F.col("o")).alias("outcome"))


JOURNAL_NAMES = "source, server_id, file, start_pos, end_pos, raw_sql, status"
JOURNAL_ROWS = [("s", 1, "log.1", 10, 20, "ALTER a", "prepared"), ("s", 1, "log.1", 30, 40, "ALTER b", "translation_pending"), ("s", 1, "log.2", 10, 20, "ALTER c", "checkpointed"), ("s", 1, "log.2", 30, 40, "ALTER d", "blocked")]
RECOVERED = [("s", 1, "log.1", 10, 20, "ALTER a", "committed"), ("s", 1, "log.1", 30, 40, "ALTER other", "verified"), ("s", 1, "log.2", 30, 40, "ALTER d", "prepared")]


@query("active_barriers", f"select file, start_pos from {values(JOURNAL_ROWS, JOURNAL_NAMES)} where status in ('translation_pending', 'prepared', 'blocked') and not exists (select 1 from {values(RECOVERED, JOURNAL_NAMES).replace(') v(', ') r(')} where r.status in ('committed', 'verified') and r.source = v.source and r.server_id = v.server_id and r.file = v.file and r.start_pos = v.start_pos and r.end_pos = v.end_pos and sha256(r.raw_sql) = sha256(v.raw_sql))")
def active_barriers(spark, d):
    schema = "source string, server_id int, file string, start_pos int, end_pos int, raw_sql string, status string"
    r = spark.createDataFrame(RECOVERED, schema).withColumn("sql_sha", F.sha2("raw_sql", 256))
    return control.active_barriers(spark.createDataFrame(JOURNAL_ROWS, schema), r).select("file", "start_pos")


@query("journal_identity_reuse", "select 'log.1' as file, 10 as start_pos, 'raw_sql,end_pos' as fields")
def journal_identity_reuse(spark, d):
    schema = "source string, server_id int, file string, start_pos int, end_pos int, raw_sql string, status string"
    events = spark.createDataFrame([("log.1", 10, 25, "ALTER x"), ("log.1", 30, 40, "ALTER b")], "file string, start_pos int, end_pos int, raw_sql string")
    return control.reused(events, spark.createDataFrame(JOURNAL_ROWS, schema), ["file", "start_pos"], ["raw_sql", "end_pos"])


@query("control_upsert", "select o_orderkey, case when o_orderkey % 2 = 0 then 2 else 1 end as version, case when o_orderkey % 2 = 0 then 'new' else 'old' end as state from orders union all select -1, 1, 'new'")
def control_upsert(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey")
    old = o.withColumns({"version": F.lit(1), "state": F.lit("old")})
    new = o.where("o_orderkey % 2 = 0").withColumns({"version": F.lit(2), "state": F.lit("new")}).unionByName(spark.createDataFrame([(-1, 1, "new")], "o_orderkey long, version int, state string"))
    return control.upsert_latest(old, new, ["o_orderkey"], "version")


@query("control_insert_if_absent", "select o_orderkey, case when o_orderkey % 3 = 0 then 'old' else 'new' end as state from orders")
def control_insert_if_absent(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey")
    return control.insert_if_absent(o.where("o_orderkey % 3 = 0").withColumn("state", F.lit("old")), o.withColumn("state", F.lit("new")), ["o_orderkey"])


@query("ledger_resolve", "select o_orderkey, case when o_orderkey % 5 = 0 then 'resolved' when o_custkey < 50 then 'resolved' else 'unresolved' end as status, case when o_orderkey % 5 = 0 then 'r0' when o_custkey < 50 then 'r1' end as run_id from orders")
def ledger_resolve(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    done = F.col("o_orderkey") % 5 == 0
    led = o.withColumns({"status": F.when(done, "resolved").otherwise("unresolved"), "run_id": F.when(done, "r0"), "evidence": F.when(done, "e0")})
    return control.resolve(led, F.col("o_custkey") < 50, "r1", "e1").select("o_orderkey", "status", "run_id")


@query("checkpoint_compare_and_set", "select * from (values ('a', 'new'), ('b', 'other')) v(name, value)")
def checkpoint_compare_and_set(spark, d):
    t = spark.createDataFrame([("a", "old"), ("b", "other")], "name string, value string")
    t = control.compare_and_set(t, F.col("name") == "a", "value", "old", "new")
    return control.compare_and_set(t, F.col("name") == "b", "value", "old", "new")


PROGRESS = [("r", "a", "complete", 1, 0, 0), ("r", "b", "complete", 0, 0, 0), ("r", "c", "complete", 0, 2, 1)]


@query("progress_table_counts", f"select count(*) as compared, count(*) filter (where i + u + x > 0) as repaired from {values(PROGRESS, 'run_id, table_name, status, i, u, x')}")
def progress_table_counts(spark, d):
    return control.table_counts(spark.createDataFrame(PROGRESS, "run_id string, table_name string, status string, inserts int, updates int, deletes int"))


@query("recovery_proof", "select 3::bigint as rows, 3::bigint as tables, 0::bigint as incomplete, 0::bigint as \"foreign\", 1::bigint as missing, 1::bigint as unexpected, false as proven")
def recovery_proof(spark, d):
    p = spark.createDataFrame([x[:3] for x in PROGRESS], "run_id string, table_name string, status string")
    return control.recovery_proof(p, spark.createDataFrame([("a",), ("b",), ("d",)], "table_name string"), "r")


@query("recovery_proven", "select 3::bigint as rows, 3::bigint as tables, 0::bigint as incomplete, 0::bigint as \"foreign\", 0::bigint as missing, 0::bigint as unexpected, true as proven")
def recovery_proven(spark, d):
    p = spark.createDataFrame([x[:3] for x in PROGRESS], "run_id string, table_name string, status string")
    return control.recovery_proof(p, p.select("table_name"), "r")


SPECS = [
    ("a", ["id", "v"], ["id", "v"], 0, False, True, True, "", "", "unchanged"), ("b", ["id", "v"], ["id", "w", "v"], 0, True, True, True, "w", "", "migrate"), ("c", ["id", "v"], ["id", "v", "w"], 5, True, True, True, "w", "", "reject: rows done"),
    ("d", ["id", "v"], ["id", "w"], 0, True, True, True, "w", "v", "reject: columns removed"), ("e", ["id", "v"], ["v", "id", "w"], 0, True, True, True, "w", "", "reject: order changed"), ("f", ["id"], ["id", "w"], 0, False, True, True, "w", "", "reject: not authorised"),
    ("g", ["id"], ["id", "w"], 0, True, False, True, "w", "", "reject: key changed"), ("h", ["id"], ["id", "w"], 0, True, True, False, "w", "", "reject: settings changed"),
]


@query("spec_migration", f"select * from {values([(x[0], *x[7:]) for x in SPECS], 'table_name, added, removed, decision')}")
def spec_migration(spark, d):
    t = spark.createDataFrame([x[:7] for x in SPECS], "table_name string, old_columns array<string>, new_columns array<string>, rows_done int, authorised boolean, key_same boolean, settings_same boolean")
    return control.spec_migration(t).select("table_name", "added", "removed", "decision")


@query("run_spec_disagreement", "select 'r2' as run_id, 2::bigint as specs")
def run_spec_disagreement(spark, d):
    return control.one_spec(spark.createDataFrame([("r1", "x"), ("r1", "x"), ("r2", "x"), ("r2", "y")], "run_id string, spec string"))


@query("audit_events", "select o_orderkey, '{\"event\":\"reconciled\",\"key\":' || o_orderkey || ',\"action\":\"' || case when o_orderkey % 2 = 0 then 'update' else 'delete' end || '\"}' as event from orders")
def audit_events(spark, d):
    o = read_table(spark, d, "orders")
    action = F.when(F.col("o_orderkey") % 2 == 0, "update").otherwise("delete")
    return o.select("o_orderkey", F.to_json(F.struct(F.lit("reconciled").alias("event"), F.col("o_orderkey").alias("key"), action.alias("action"))).alias("event"))


