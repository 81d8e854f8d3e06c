"""Queries over schema statements: one for each order, on the tables of its customer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyloom.functions import classify
from keyloom.operators import closure, ddl
from keyloom.plans import schema_plan
from keyloom.plans.meta_queries import _customer_tables
from keyloom.plans.registry import query
from keyloom.session import materialise, read_table

#: The n-th statement on a customer's tables. Each eighth renames the table, so that a chain of names goes on.
STATEMENTS = {
    "create": "CREATE TABLE IF NOT EXISTS `{t}` (`id` BIGINT NOT NULL, `a` VARCHAR(20) DEFAULT 'x, (y', `b` INT, PRIMARY KEY (`id`)) ENGINE=InnoDB",
    "0": "RENAME TABLE `{p}` TO `{t}`",
    "1": "/* note */ ALTER TABLE `{t}` ADD COLUMN `c{n}` DECIMAL(10,2) NOT NULL AFTER `id` -- behind the key",
    "2": "ALTER TABLE {t} ADD `e{n}` TEXT FIRST, DROP COLUMN IF EXISTS `C{m}`;",
    "3": "ALTER TABLE `{t}` RENAME COLUMN `e{m}` TO `f{n}`, RENAME COLUMN `f{n}` TO `g{n}`",
    "4": "ALTER TABLE `{t}` MODIFY COLUMN `b` BIGINT NULL, ADD INDEX `i{n}` (`b`, `id`)",
    "5": "ALTER TABLE other.`{t}` ADD COLUMN z INT",
    "6": "ALTER TABLE `{t}` ADD COLUMN `id` INT, DROP COLUMN `b`",
    "7": "ALTER TABLE `{t}` ADD COLUMN `a` VARCHAR(20) DEFAULT 'x, (y' AFTER `gone{n}`, WHATEVER {n}",
}

_N = "row_number() over (partition by o_custkey order by o_orderkey)"
NUMBERED_SQL = f"""o as (select o_orderkey as id, o_custkey as c, {_N} as n from orders),
  s as (select *, n // 8 as v, case when n = 1 then 'create' else (n % 8)::varchar end as kind, 't' || c || '_' || (n // 8) as t, 't' || c || '_' || (n // 8 - 1) as p from o)"""


def statements(spark, d):
    """id, sql: a statement for each order."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), n.alias("n"))
    table = lambda back: F.concat(F.lit("t"), F.col("c").cast("string"), F.lit("_"), (F.floor(F.col("n") / 8) - back).cast("string"))
    sql = F.lit(None).cast("string")
    for kind, text in STATEMENTS.items():
        for name, value in (("t", table(0)), ("p", table(1)), ("n", F.col("n").cast("string")), ("m", (F.col("n") - 1).cast("string"))):
            text = F.replace(F.lit(text) if isinstance(text, str) else text, F.lit(f"{{{name}}}"), value)
        here = F.col("n") == 1 if kind == "create" else (F.col("n") % 8 == int(kind)) & (F.col("n") > 1)
        sql = F.coalesce(sql, F.when(here, text))
    return o.select("id", sql.alias("sql"))


#: The operations that each statement stands for, typed out by kind: item, operation, guarded, name, new, definition, after, first, error.
OPERATIONS_SQL = f"""{NUMBERED_SQL}, ops as (
  select id, c, n, kind, u.* from s, lateral (
    select 0 as item, 'create_table' as operation, true as guarded, null as name, null as new, null as definition, null as after, false as first, null as error, t as object where kind = 'create'
    union all select 1, 'add_column', false, 'id', null, 'BIGINT NOT NULL', null, false, null, t where kind = 'create'
    union all select 2, 'add_column', false, 'a', null, 'VARCHAR ( 20 ) DEFAULT ''x, (y''', null, false, null, t where kind = 'create'
    union all select 3, 'add_column', false, 'b', null, 'INT', null, false, null, t where kind = 'create'
    union all select 4, 'add_primary_key', false, null, null, null, null, false, null, t where kind = 'create'
    union all select 0, 'rename_table', false, null, t, null, null, false, null, p where kind = '0'
    union all select 1, 'add_column', false, 'c' || n, null, 'DECIMAL ( 10 , 2 ) NOT NULL', 'id', false, null, t where kind = '1'
    union all select 1, 'add_column', false, 'e' || n, null, 'TEXT', null, true, null, t where kind = '2'
    union all select 2, 'drop_column', true, 'C' || n - 1, null, null, null, false, null, t where kind = '2'
    union all select 1, 'rename_column', false, 'e' || n - 1, 'f' || n, null, null, false, null, t where kind = '3'
    union all select 2, 'rename_column', false, 'f' || n, 'g' || n, null, null, false, null, t where kind = '3'
    union all select 1, 'modify_column', false, 'b', null, 'BIGINT NULL', null, false, null, t where kind = '4'
    union all select 2, 'add_index', false, 'i' || n, null, null, null, false, null, t where kind = '4'
    union all select 0, null, null, null, null, null, null, null, 'qualified_name', null where kind = '5'
    union all select 1, 'add_column', false, 'id', null, 'INT', null, false, null, t where kind = '6'
    union all select 2, 'drop_column', false, 'b', null, null, null, false, null, t where kind = '6'
    union all select 1, 'add_column', false, 'a', null, 'VARCHAR ( 20 ) DEFAULT ''x, (y''', 'gone' || n, false, null, t where kind = '7'
    union all select 2, null, null, null, null, null, null, null, 'clause', t where kind = '7') u)"""


@query("ddl_parsed", f"with {OPERATIONS_SQL} select id, item, operation, guarded, object, name, new, definition, after, first, error from ops")
def ddl_parsed(spark, d):
    return ddl.parse(statements(spark, d), ["id"]).select("id", "item", "operation", "guarded", "object", "name", "new", "definition", "after", "first", "error")


#: A customer's table after its first n statements, by recursion over n: columns are (name, definition) in order.
STATES_SQL = f"""with recursive {NUMBERED_SQL}, fold as (
  select c, n, t as name, ['id', 'a', 'b'] as names, ['BIGINT NOT NULL', 'VARCHAR ( 20 ) DEFAULT ''x, (y''', 'INT'] as defs, 'applied' as outcome, false as dropped from s where n = 1
  union all
  select s.c, s.n, case s.kind when '0' then s.t else f.name end,
    case s.kind when '1' then list_concat(f.names[1:list_position(f.names, 'id')], ['c' || s.n], f.names[list_position(f.names, 'id') + 1:])
      when '2' then list_filter(list_prepend('e' || s.n, f.names), lambda x: x <> 'c' || (s.n - 1))
      when '3' then list_transform(f.names, lambda x: case when x = 'e' || (s.n - 1) then 'g' || s.n else x end) else f.names end,
    case s.kind when '1' then list_concat(f.defs[1:list_position(f.names, 'id')], ['DECIMAL ( 10 , 2 ) NOT NULL'], f.defs[list_position(f.names, 'id') + 1:])
      when '2' then list_prepend('TEXT', list_transform(list_filter(range(1, len(f.names) + 1), lambda i: f.names[i] <> 'c' || (s.n - 1)), lambda i: f.defs[i]))
      when '4' then list_transform(range(1, len(f.names) + 1), lambda i: case when f.names[i] = 'b' then 'BIGINT NULL' else f.defs[i] end) else f.defs end,
    case when s.kind in ('6', '7') then 'refused' when s.kind = '5' then 'none' else 'applied' end,
    s.kind = '2' and list_contains(f.names, 'c' || (s.n - 1))
  from fold f join s on s.c = f.c and s.n = f.n + 1
)"""


def _applied(spark, d):
    return ddl.apply_all(ddl.parse(statements(spark, d), ["id"]), ["id"])


@query("ddl_post_state", f"""{STATES_SQL}, l as (select *, row_number() over (partition by c order by n desc) as back from fold)
  select name as table_name, unnest(range(1, len(names) + 1))::int as ordinal, unnest(names) as column_name, unnest(defs) as definition from l where back = 1""")
def ddl_post_state(spark, d):
    """Every table's columns behind all statements, chains of table and column names included."""
    return _applied(spark, d)[1].where("kind = 'column'").select("table_name", "ordinal", F.col("name").alias("column_name"), "definition")


@query("ddl_translated", f"""{STATES_SQL}, {OPERATIONS_SQL[OPERATIONS_SQL.index('ops as ('):]}
  select ops.id, ops.item, case when f.outcome = 'refused' then 'refused' when ops.kind = '2' and ops.item = 2 and not f.dropped then 'no_op' else 'applied' end as outcome,
    case when f.outcome = 'refused' or (ops.kind = '2' and ops.item = 2 and not f.dropped) then null
      when ops.kind = '1' then 'ADD COLUMN `c' || ops.n || '` DECIMAL ( 10 , 2 ) NOT NULL AFTER `id`'
      when ops.kind = '2' and ops.item = 1 then 'ADD COLUMN `e' || ops.n || '` TEXT FIRST' when ops.kind = '2' then 'DROP COLUMN `c' || (ops.n - 1) || '`'
      when ops.kind = '3' then 'RENAME COLUMN `' || ops.name || '` TO `' || ops.new || '`' else '-' end as said
  from ops join fold f on f.c = ops.c and f.n = ops.n where ops.object is not null""")
def ddl_translated(spark, d):
    """What becomes of each operation, and what the target must be told for column operations ('-' for others)."""
    ops, _ = _applied(spark, d)
    said = F.when(F.col("said").isNull() | F.col("said").rlike("^(ADD|DROP|RENAME) COLUMN "), F.col("said")).otherwise("-")
    return ops.select("id", "item", "outcome", said.alias("said"))


#: Orders refer to the order before the last of their customer, parts of orders to each other by tens: a forest of any size.
FOREST_SQL = f"e as (select b.id as child, a.id as parent from (select o_orderkey as id, o_custkey as c, {_N} as n from orders) a join (select o_orderkey as id, o_custkey as c, {_N} as n from orders) b on a.c = b.c and a.n = b.n // 2)"


def _forest(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = materialise(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("c"), n.alias("n")), "forest")
    parent = o.select(F.col("node").alias("parent"), "c", F.col("n").alias("half"))
    edges = o.withColumn("half", F.floor(F.col("n") / 2)).join(parent, ["c", "half"]).select(F.col("node").alias("child"), "parent")
    return o.select("node"), edges


@query("closure_levels", f"with recursive {FOREST_SQL}, r as (select o_orderkey as node, 0 as level from orders where o_orderkey not in (select child from e) union all select e.child, r.level + 1 from r join e on e.parent = r.node) select node, level from r")
def closure_levels(spark, d):
    return closure.levels(*_forest(spark, d))


@query("closure_components", f"with recursive {FOREST_SQL}, m as (select o_custkey, min(o_orderkey) as component, count(*) as n from orders group by 1) select o_orderkey as node, component from orders join m using (o_custkey) where n > 1")
def closure_components(spark, d):
    return closure.components(_forest(spark, d)[1], "child", "parent")


@query("closure_dependents", f"with recursive {FOREST_SQL}, r as (select child as node, 1 as steps from e where parent % 7 = 0 union all select e.child, r.steps + 1 from r join e on e.parent = r.node) select node, min(steps)::int as steps from r group by node")
def closure_dependents(spark, d):
    """Everything that depends on an excluded row, and over how many references at least."""
    nodes, edges = _forest(spark, d)
    return closure.dependents(nodes.where("node % 7 = 0"), edges)


@query("order_statement_decisions", f"""with {NUMBERED_SQL}
  select id, case kind when '2' then 'quarantine' else 'replay' end as decision, case kind when '2' then 'vendor_only' end as reason, case kind when '2' then 'IF EXISTS' end as detail from s""")
def order_statement_decisions(spark, d):
    """What the stream does with each order's statement."""
    s = statements(spark, d).withColumn("x", classify.statement_decision(classify.normalise(F.col("sql"))))
    return s.select("id", "x.decision", "x.reason", "x.detail")


@query("customer_schema_diff", """with k as (select c_custkey as k from customer), c as (select k, 't' || k as table_name, unnest(['id', 'name', 'amount', 'made']) as column_name from k)
  select table_name, column_name, case when k % 7 = 0 or (column_name = 'amount' and k % 5 = 0) then 'add' when column_name = 'name' and k % 3 = 0 then 'modify' else 'same' end as action,
    case when k % 7 <> 0 and column_name = 'name' and k % 3 = 0 then 'column_type' else '' end as attributes from c
  union all select 't' || k, 'old', 'drop', '' from k where k % 7 <> 0 and k % 11 = 0""")
def customer_schema_diff(spark, d):
    """Columns of a table for each customer, in source and target."""
    return schema_plan.column_diff(*_customer_tables(spark, d))


@query("customer_schema_drift", """with k as (select c_custkey as k from customer)
  select 't' || k as table_name, case when k % 7 = 0 then 'missing' when k % 3 = 0 or k % 5 = 0 or k % 11 = 0 then 'differs' else 'equal' end as state from k""")
def customer_schema_drift(spark, d):
    """Whether a table's fingerprints agree."""
    source, target = (schema_plan.fingerprints(x).withColumnRenamed("fingerprint", n) for x, n in zip(_customer_tables(spark, d), ("s", "t")))
    state = F.when(F.col("t").isNull(), "missing").when(F.col("s") == F.col("t"), "equal").otherwise("differs")
    return source.join(target, "table_name", "left").select("table_name", state.alias("state"))
