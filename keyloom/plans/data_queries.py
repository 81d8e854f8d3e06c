"""Queries over keyed tables: comparison, windows, checksums, apply, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions.encode import checksum, row_text
from keyloom.operators import apply, diff, integrity, keyset, sync, validate
from keyloom.plans.registry import query
from keyloom.plans.schema_plan import ColumnType, preflight, samples
from keyloom.plans.spec import BY_STATUS, CONVERSATIONS, CUSTOMER, ORDERS, SOURCE_SQL, TARGET_SQL, TableSpec, source_orders, target_orders
from keyloom.session import materialise, read_table, work_path

S, T = f"s as ({SOURCE_SQL})", f"t as ({TARGET_SQL})"
ST = f"with {S}, {T}"
VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
OTHER = " or ".join(f"s.{c} is distinct from t.{c}" for c in VALUES)
CHANGED = "concat_ws(',', " + ", ".join(f"case when s.{c} is distinct from t.{c} then '{c}' end" for c in VALUES) + ")"
KIND = f"case when s.o_orderkey is null then 'missing_source' when t.o_orderkey is null then 'missing_target' when {OTHER} then 'value_mismatch' else 'equal' end"


def sides(spark, d):
    return source_orders(spark, d), target_orders(spark, d)


def listed(c):
    return F.array_join(c, ",")


# --- comparison --------------------------------------------------------------------------------------


@query("divergence_summary", f"{ST} select {KIND} as kind, count(*) as rows from s full join t using (o_orderkey) group by 1")
def divergence_summary(spark, d):
    return diff.summary(*sides(spark, d), ORDERS)


@query("diff_inserts", f"{ST} select s.* from s anti join t using (o_orderkey)")
def diff_inserts(spark, d):
    return diff.inserts(*sides(spark, d), ORDERS)


@query("diff_deletes", f"{ST} select o_orderkey from t anti join s using (o_orderkey)")
def diff_deletes(spark, d):
    return diff.deletes(*sides(spark, d), ORDERS)


@query("diff_updates", f"{ST} select s.* from s join t using (o_orderkey) where {OTHER}")
def diff_updates(spark, d):
    return diff.updates(*sides(spark, d), ORDERS)


@query("diff_changes", f"""{ST} select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey, case {KIND} when 'missing_source' then 'D' when 'missing_target' then 'I' else 'U' end as op,
  t.o_totalprice as old_price, s.o_totalprice as new_price from s full join t using (o_orderkey) where {KIND} <> 'equal'""")
def diff_changes(spark, d):
    c = diff.changes(*sides(spark, d), ORDERS)
    return c.select("o_orderkey", "op", F.col("before.o_totalprice").alias("old_price"), F.col("after.o_totalprice").alias("new_price"))


@query("differing_columns", f"{ST} select o_orderkey, {CHANGED} as columns from s join t using (o_orderkey) where {OTHER}")
def differing_columns(spark, d):
    return diff.compare(*sides(spark, d), ORDERS).where("kind = 'value_mismatch'").select("o_orderkey", listed(F.col("changed")).alias("columns"))


@query("row_divergence_windowed", f"""with s as (select * from ({SOURCE_SQL}) order by o_orderkey limit 500), t as (select * from ({TARGET_SQL}) order by o_orderkey limit 500)
  select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey, {KIND} as kind from s full join t using (o_orderkey) where {KIND} <> 'equal'""")
def row_divergence_windowed(spark, d):
    return diff.windowed_compare(*sides(spark, d), ORDERS, 500).where("kind <> 'equal'").select("o_orderkey", "kind")


@query("key_set_difference", f"{ST}, k as (select o_orderkey from s) select o_orderkey, 'missing' as problem from (select o_orderkey from k except select o_orderkey from t) union all select o_orderkey, 'unexpected' from (select o_orderkey from t except select o_orderkey from k)")
def key_set_difference(spark, d):
    s, t = sides(spark, d)
    return diff.same_key_set(s.select("o_orderkey"), t).select("o_orderkey", "problem")


@query("key_union", f"{ST} select o_orderkey from s union select o_orderkey from t")
def key_union(spark, d):
    s, t = sides(spark, d)
    return s.select("o_orderkey").union(t.select("o_orderkey")).distinct()


@query("duplicate_keys", "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all having count(*) > 1")
def duplicate_keys(spark, d):
    spec = TableSpec("lineitem", ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber"))
    return diff.duplicate_keys(read_table(spark, d, "lineitem"), spec)


@query("exact_row_verification", f"{ST} select s.o_orderkey from s anti join t on s.o_orderkey is not distinct from t.o_orderkey and {' and '.join(f's.{c} is not distinct from t.{c}' for c in VALUES)}")
def exact_row_verification(spark, d):
    s, t = sides(spark, d)
    return apply.verify_rows(t, s, ORDERS).select("o_orderkey")


# --- windows of keys -----------------------------------------------------------------------------------


@query("keyset_window", f"select * from ({SOURCE_SQL}) where o_orderkey > 1000 and o_orderkey <= 3000 order by o_orderkey limit 300")
def keyset_window(spark, d):
    return keyset.window(source_orders(spark, d), ORDERS, [1000], [3000], 300)


@query("keyset_composite", "select conv_id, turn, role from conversations where (conv_id > 3 or conv_id = 3 and turn > 1) and (conv_id < 40 or conv_id = 40 and turn <= 2)")
def keyset_composite(spark, d):
    return keyset.window(read_table(spark, d, "conversations"), CONVERSATIONS, [3, 1], [40, 2]).select("conv_id", "turn", "role")


@query("keyset_enum_order", """with o as (select o_orderstatus, o_orderkey, coalesce(list_position(['P', 'O', 'F'], o_orderstatus), 0) as p from orders)
  select o_orderstatus, o_orderkey from o where (p, o_orderkey) > (2, 500) order by p, o_orderkey limit 200""")
def keyset_enum_order(spark, d):
    return keyset.window(read_table(spark, d, "orders"), BY_STATUS, ["O", 500], None, 200).select("o_orderstatus", "o_orderkey")


@query("target_tail", f"with {T} select o_orderkey from t where o_orderkey > (select max(o_orderkey) from orders)")
def target_tail(spark, d):
    s, t = sides(spark, d)
    return keyset.tail(t, s, ORDERS).select("o_orderkey")


@query("point_read", "select o_orderkey, o_custkey, 1::bigint as matches from orders where o_orderkey in (1, 2, 77, 4000, 99999999)")
def point_read(spark, d):
    keys = spark.createDataFrame([(k,) for k in (1, 2, 77, 4000, 99999999)], "o_orderkey long")
    return keyset.point_read(source_orders(spark, d), keys, ORDERS).select("o_orderkey", "o_custkey", "matches")


@query("point_read_ambiguous", "select l_orderkey, l_linenumber, count(*) as matches from lineitem group by all having count(*) > 1")
def point_read_ambiguous(spark, d):
    spec = TableSpec("lineitem", ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber"))
    rows = read_table(spark, d, "lineitem")
    return keyset.point_read(rows, rows, spec).where("matches > 1").select("l_orderkey", "l_linenumber", "matches").distinct()


@query("chunk_boundaries", "with c as (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 1000 + 1 as chunk from orders) select chunk, min(o_orderkey) as first_key, max(o_orderkey) as last_key, count(*) as rows from c group by chunk")
def chunk_boundaries(spark, d):
    return keyset.chunk_bounds(read_table(spark, d, "orders"), ORDERS, 1000)


@query("chunk_range_join", "select (row_number() over (order by o_orderkey) - 1) // 2000 + 1 as chunk, o_orderkey, o_custkey from orders")
def chunk_range_join(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return keyset.range_join(o, keyset.chunk_bounds(o, ORDERS, 2000), ORDERS, 2000).select("chunk", "o_orderkey", "o_custkey")


@query("composite_chunks", "select chunk, count(*) as rows, min(conv_id) as first_conv from (select conv_id, (row_number() over (order by conv_id, turn) - 1) // 100 + 1 as chunk from conversations) group by chunk")
def composite_chunks(spark, d):
    return keyset.chunk_numbers(read_table(spark, d, "conversations"), CONVERSATIONS, 100).groupBy("chunk").agg(F.count("*").alias("rows"), F.min("conv_id").alias("first_conv"))


@query("evidence_batch", f"{ST} select t.o_orderkey, t.o_totalprice from t semi join (select o_orderkey from s where o_custkey % 20 = 0) k using (o_orderkey)")
def evidence_batch(spark, d):
    """A batch that grows with the table: the orders of each twentieth customer."""
    s, t = sides(spark, d)
    return t.join(s.where("o_custkey % 20 = 0").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


# --- counts and checksums ------------------------------------------------------------------------------

COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "price", "o_orderdate", "o_orderpriority"]
PART = lambda c, t: f"case when {c} is null then 'N' else octet_length(encode({t})) || ':' || {t} end"
ROW = " || ".join([PART("o_orderkey", "o_orderkey::varchar"), PART("o_custkey", "o_custkey::varchar"), PART("o_orderstatus", "o_orderstatus"), PART("o_totalprice", "o_totalprice::decimal(18,2)::varchar"), PART("o_orderdate", "epoch_us(o_orderdate)::varchar"), PART("o_orderpriority", "o_orderpriority")])
SUM = f"coalesce(bit_xor(('0x' || substr(md5({ROW}), 1, 16))::ubigint), 0)::decimal(20,0)"


def priced(df):
    """Prices as decimals: floats have no stable text."""
    return df.withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))


@query("table_checksum", f"{ST} select 'source' as side, count(*) as row_count, {SUM} as checksum from s union all select 'target', count(*), {SUM} from t")
def table_checksum(spark, d):
    s, t = map(priced, sides(spark, d))
    one = lambda df, n: validate.table_checksum(df, COLS).select(F.lit(n).alias("side"), "row_count", "checksum")
    return one(s, "source").unionByName(one(t, "target"))


@query("checksum_window", f"with {S} select count(*) as row_count, {SUM} as checksum from s where o_orderkey > 500 and o_orderkey <= 1500")
def checksum_window(spark, d):
    return validate.table_checksum(priced(keyset.window(source_orders(spark, d), ORDERS, [500], [1500])), COLS)


@query("checksum_empty", "select 0::bigint as row_count, 0::decimal(20,0) as checksum")
def checksum_empty(spark, d):
    return validate.table_checksum(priced(source_orders(spark, d)).where("o_orderkey < 0"), COLS)


@query("bucket_checksum", f"with {S} select o_orderkey // 1000 as bucket, count(*) as row_count, {SUM} as checksum from s group by 1")
def bucket_checksum(spark, d):
    return validate.bucket_checksums(priced(source_orders(spark, d)), COLS, F.floor(F.col("o_orderkey") / 1000).cast("long"))


@query("bucket_checksum_diff", f"""{ST}, a as (select o_custkey % 50 as bucket, count(*) as source_rows, {SUM} as source_checksum from s group by 1),
  b as (select o_custkey % 50 as bucket, count(*) as target_rows, {SUM} as target_checksum from t where o_custkey % 50 <> 7 group by 1)
  select * from a full join b using (bucket) where source_rows is distinct from target_rows or source_checksum is distinct from target_checksum""")
def bucket_checksum_diff(spark, d):
    s, t = map(priced, sides(spark, d))
    return validate.checksum_diff(s, t.where("o_custkey % 50 <> 7"), COLS, F.col("o_custkey") % 50)


@query("checksum_text_types", """select count(*) as row_count, coalesce(bit_xor(('0x' || substr(md5(case when conv_id is null then 'N' else octet_length(encode(conv_id::varchar)) || ':' || conv_id end || case when text is null then 'N' else octet_length(encode(text)) || ':' || text end), 1, 16))::ubigint), 0)::decimal(20,0) as checksum from conversations""")
def checksum_text_types(spark, d):
    c = read_table(spark, d, "conversations")
    return c.agg(F.count("*").alias("row_count"), checksum(row_text(c, ["conv_id", "text"])).alias("checksum"))


@query("count_compare", f"""{ST}, c as (select * from customer where c_custkey % 11 <> 0)
  select 'customer' as table_name, (select count(*) from customer) as source_rows, (select count(*) from c) as target_rows, (select count(*) from customer) = (select count(*) from c) as matches
  union all select 'nation', (select count(*) from nation), (select count(*) from nation), true union all select 'orders', (select count(*) from s), (select count(*) from t), (select count(*) from s) = (select count(*) from t)""")
def count_compare(spark, d):
    c, n = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    return validate.count_compare([("orders", *sides(spark, d)), ("customer", c, c.where("c_custkey % 11 <> 0")), ("nation", n, n)])


NATION = TableSpec("nation", ("n_nationkey",), ("n_nationkey", "n_name", "n_regionkey"))


def _validation(spark, d):
    s, t = map(priced, sides(spark, d))
    n = read_table(spark, d, "nation")
    return validate.reports([(s, t, ORDERS, COLS, F.col("o_orderkey") % 100), (n, n, NATION, ["n_nationkey", "n_name"], F.col("n_nationkey") % 3)])


@query("validation_reports", f"""{ST}, a as (select o_orderkey % 100 as b, count(*) as n, {SUM} as x from s group by 1), z as (select o_orderkey % 100 as b, count(*) as n, {SUM} as x from t group by 1)
  select 'orders' as table_name, (select count(*) from s) as source_rows, (select count(*) from t) as target_rows, (select count(*) from s) = (select count(*) from t) as matches,
  (select count(*) from a full join z using (b) where a.n is distinct from z.n or a.x is distinct from z.x) as checksum_diffs,
  (select count(*) from s full join t using (o_orderkey) where {KIND} <> 'equal') as divergences, false as passed
  union all select 'nation', count(*), count(*), true, 0, 0, true from nation""")
def validation_reports(spark, d):
    return _validation(spark, d)


@query("cutover_gate", "select false as validated, 2::bigint as tables, 3::bigint as lag, 0::bigint as quarantined, false as may_switch, false as passed")
def cutover_gate(spark, d):
    return validate.cutover_gate(_validation(spark, d), F.lit(3).cast("long"), 5, F.lit(0).cast("long"))


@query("cutover_gate_lagging", "select true as validated, 1::bigint as tables, 3::bigint as lag, 0::bigint as quarantined, true as may_switch, false as passed")
def cutover_gate_lagging(spark, d):
    n = read_table(spark, d, "nation")
    return validate.cutover_gate(validate.report(n, n, NATION, ["n_nationkey", "n_name"], F.col("n_nationkey") % 3), F.lit(3).cast("long"), 5, F.lit(0).cast("long"))


# --- apply -------------------------------------------------------------------------------------------------


@query("apply_diff_converges", SOURCE_SQL)
def apply_diff_converges(spark, d):
    s, t = sides(spark, d)
    return apply.apply_changes(t, diff.changes(s, t, ORDERS), ORDERS)


def _log(spark, d):
    """A log over a tenth of the orders: key moves, updates, no-ops, deletes, inserts of present and absent keys."""
    o = source_orders(spark, d)
    image = F.struct(*ORDERS.columns)
    moved = F.struct((F.col("o_orderkey") + 50_000_000).alias("o_orderkey"), *ORDERS.columns[1:])
    priced_ = F.struct("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") + 5).alias("o_totalprice"), "o_orderdate", "o_orderpriority")
    none = F.lit(None).cast(o.select(image.alias("i")).schema["i"].dataType)
    k = F.col("o_orderkey")
    row = lambda seq, op, before, after, where: o.where(where).select(F.struct((k * 10 + seq).alias("pos")).alias("coord"), F.lit(op).alias("op"), before.alias("before"), after.alias("after"))
    parts = [
        row(1, "U", image, priced_, k % 10 == 1),
        row(2, "U", image, image, k % 10 == 2),
        row(3, "D", image, none, k % 10 == 3),
        row(4, "U", image, moved, k % 10 == 4),
        row(5, "I", none, priced_, k % 10 == 5),  # present: the old row stays
        row(6, "D", image, none, k % 10 == 6),
        row(7, "I", none, priced_, k % 10 == 6),  # absent by now
        row(8, "U", image, image.withField("o_orderstatus", F.lit("Z")), k % 20 == 6),
        row(9, "D", moved, none, k % 20 == 4),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return o, out


APPLIED = f"""with s as ({SOURCE_SQL})
select case when o_orderkey % 10 = 4 then o_orderkey + 50000000 else o_orderkey end as o_orderkey, o_custkey,
  case when o_orderkey % 20 = 6 then 'Z' else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 10 = 1 or o_orderkey % 20 = 16 then o_totalprice + 5 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority
from s where o_orderkey % 10 <> 3 and o_orderkey % 20 <> 4"""


@query("apply_log", APPLIED)
def apply_log(spark, d):
    return apply.apply_log(*_log(spark, d), ORDERS)


@query("apply_log_twice", APPLIED)
def apply_log_twice(spark, d):
    """A replay of the whole log over its own result: moves, deletes and inserts again give the same rows."""
    o, log = _log(spark, d)
    once = materialise(apply.apply_log(o, log, ORDERS), "once")
    return apply.apply_log(once, log.where("op <> 'I' or after.o_orderkey % 10 <> 5"), ORDERS)


@query("apply_pk_change", f"select * from ({APPLIED}) where o_orderkey > 50000000 ")
def apply_pk_change(spark, d):
    o, log = _log(spark, d)
    return apply.apply_log(o, log, ORDERS).where("o_orderkey > 50000000")


@query("compacted_ops", """select op, count(*) as keys, sum(changes)::bigint as changes from (
  select case when o_orderkey % 10 in (3) then 'D' when o_orderkey % 10 = 5 or o_orderkey % 20 = 16 then 'I' else 'U' end as op, case when o_orderkey % 10 = 6 then 2 + (o_orderkey % 20 = 6)::int else 1 end as changes from orders where o_orderkey % 10 in (1, 3, 5, 6)
  union all select 'D', 1 from orders where o_orderkey % 10 = 4 union all select case when o_orderkey % 20 = 4 then 'D' else 'I' end, 1 + (o_orderkey % 20 = 4)::int from orders where o_orderkey % 10 = 4) group by op""")
def compacted_ops(spark, d):
    return apply.compact(_log(spark, d)[1], ORDERS).groupBy("op").agg(F.count("*").alias("keys"), F.sum("changes").alias("changes"))


@query("noop_updates_removed", "select count(*) as kept from orders where o_orderkey % 10 in (1, 3, 4, 5, 6) or o_orderkey % 20 in (4, 6)")
def noop_updates_removed(spark, d):
    steps = apply.normalise(_log(spark, d)[1], ORDERS)
    return steps.groupBy("o_orderkey").count().select((F.col("o_orderkey") % 50_000_000).alias("k")).distinct().agg(F.count("*").alias("kept"))


@query("strict_insert_check", "select count(*) filter (where o_orderkey % 17 = 0) as free, count(*) filter (where o_orderkey % 17 <> 0) as taken from orders")
def strict_insert_check(spark, d):
    s, t = sides(spark, d)
    free, taken = apply.strict_inserts(t, s, ORDERS)
    return free.agg(F.count("*").alias("free")).crossJoin(taken.agg(F.count("*").alias("taken")))


@query("progress_counters", f"{ST} select count(*) filter (where k = 'missing_target') as inserts, count(*) filter (where k = 'value_mismatch') as updates, count(*) filter (where k = 'missing_source') as deletes from (select {KIND} as k from s full join t using (o_orderkey))")
def progress_counters(spark, d):
    c = diff.changes(*sides(spark, d), ORDERS)
    return c.agg(*[F.count_if(F.col("op") == op).alias(n) for op, n in (("I", "inserts"), ("U", "updates"), ("D", "deletes"))])


@query("sync_chunked", f"{SOURCE_SQL}")
def sync_chunked(spark, d):
    """The target after a run over all windows of the source."""
    s, t = sides(spark, d)
    run = sync.SyncRun(spark, work_path(spark, "sync"), ORDERS, 5000)
    run.run(s, t, windows=8)
    return run.result(t)


@query("sync_resumed", f"""{ST}, n as (select greatest(1, ceil(count(*) / 4000.0))::bigint as windows, count(*) as rows_scanned from s),
  c as (select count(*) filter (where k = 'missing_target') as inserts, count(*) filter (where k = 'value_mismatch') as updates, count(*) filter (where k = 'missing_source') as deletes from (select {KIND} as k from s full join t using (o_orderkey)))
  select n.*, c.*, 'complete' as status from n, c""")
def sync_resumed(spark, d):
    """Progress of a run that is left after its first step and opened again."""
    s, t = sides(spark, d)
    path = work_path(spark, "sync")
    sync.SyncRun(spark, path, ORDERS, 4000).step(s, t)
    again = sync.SyncRun(spark, path, ORDERS, 4000)
    again.run(s, t, windows=8)
    sums = [F.sum(c).alias(c) for c in ("windows", "rows_scanned", "inserts", "updates", "deletes")]
    return again.progress().agg(*sums, F.max_by("status", "step").alias("status"))


# --- integrity ------------------------------------------------------------------------------------------------


@query("orphans", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_custkey % 11 = 0)")
def orphans(spark, d):
    parent = read_table(spark, d, "customer").where("c_custkey % 11 <> 0")
    return integrity.orphans(source_orders(spark, d), ["o_custkey"], parent, ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("parent_repair_plan", "select c_custkey, c_name from customer where c_custkey % 11 = 0 and c_custkey in (select o_custkey from orders)")
def parent_repair_plan(spark, d):
    c = read_table(spark, d, "customer")
    return integrity.parent_repair(source_orders(spark, d), ["o_custkey"], c.where("c_custkey % 11 <> 0"), c, ["c_custkey"]).select("c_custkey", "c_name")


@query("nested_parent_repair", """with c as (select * from customer where c_custkey % 11 = 0 and c_custkey in (select o_custkey from orders)),
  n as (select * from nation where n_nationkey % 2 = 0 and n_nationkey in (select c_nationkey from c)), r as (select * from region where r_regionkey > 1 and r_regionkey in (select n_regionkey from n))
  select 0 as level, r_regionkey::bigint as key from r union all select 1, n_nationkey from n union all select 2, c_custkey from c""")
def nested_parent_repair(spark, d):
    c, n, r = (read_table(spark, d, t) for t in ("customer", "nation", "region"))
    chain = [(["o_custkey"], c.where("c_custkey % 11 <> 0"), c, ["c_custkey"]), (["c_nationkey"], n.where("n_nationkey % 2 <> 0"), n, ["n_nationkey"]), (["n_regionkey"], r.where("r_regionkey <= 1"), r, ["r_regionkey"])]
    out = None
    for level, df in enumerate(integrity.nested_repair(source_orders(spark, d), chain)):
        part = df.select(F.lit(level).alias("level"), F.col(df.columns[0]).cast("long").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def _renumbered(spark, d):
    """Customers to insert whose names other keys of the target own."""
    c = read_table(spark, d, "customer").select(*CUSTOMER.columns)
    return c, c.where("c_custkey % 5 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)


@query("unique_owner_conflicts", "select c_custkey + 1000000 as c_custkey, c_custkey as owner_c_custkey, c_name from customer where c_custkey % 5 = 0")
def unique_owner_conflicts(spark, d):
    target, rows = _renumbered(spark, d)
    return integrity.unique_conflicts(rows, target, CUSTOMER, ["c_name"])


@query("unique_owner_actions", "select c_custkey as owner_c_custkey, case when c_custkey % 2 = 0 then 'update' else 'delete' end as action from customer where c_custkey % 5 = 0")
def unique_owner_actions(spark, d):
    target, rows = _renumbered(spark, d)
    conflicts = integrity.unique_conflicts(rows, target, CUSTOMER, ["c_name"])
    return integrity.owner_actions(conflicts, target.where("c_custkey % 2 = 0"), CUSTOMER).select("owner_c_custkey", "action")


@query("superseded_inserts", "select o_orderkey, case when o_orderkey % 17 = 0 then 'skip' when o_orderkey % 3 = 0 then 'use_current' else 'fail' end as decision from orders where o_custkey % 11 = 0")
def superseded_inserts(spark, d):
    o = source_orders(spark, d)
    now = o.where("o_orderkey % 17 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return integrity.superseded(o.where("o_custkey % 11 = 0"), now, ORDERS, ["o_custkey"]).select("o_orderkey", "decision")


@query("targeted_resolution", f"""{ST}, l as (select o_orderkey from s where o_orderkey % 100 = 1), bad as (select o_orderkey from l where o_orderkey not in (select s.o_orderkey from s join t using (o_orderkey) where not ({OTHER})))
  select (select count(*) from l) as unresolved, (select count(*) from bad) as unequal_children, 0::bigint as repeated, 0::bigint as unequal_parents, (select count(*) from bad) = 0 as resolve""")
def targeted_resolution(spark, d):
    s, t = sides(spark, d)
    c = read_table(spark, d, "customer").select(*CUSTOMER.columns)
    ledger = s.where("o_orderkey % 100 = 1").select("o_orderkey", F.lit("unresolved").alias("status"))
    return integrity.conflict_resolution(ledger, s, t, ORDERS, [(["o_custkey"], c, c, CUSTOMER)])


@query("evidence_parents", "select distinct o_custkey from orders where o_orderkey % 100 = 1")
def evidence_parents(spark, d):
    return source_orders(spark, d).where("o_orderkey % 100 = 1").select("o_custkey").dropna().distinct()


# --- conversions of data ------------------------------------------------------------------------------------------


def _conversions():
    return [
        (ColumnType("o_custkey", "smallint", False), ColumnType("o_custkey", "bigint")),
        (ColumnType("o_orderpriority", "varchar(6)"), ColumnType("o_orderpriority", "varchar(20)")),
        (ColumnType("price", "decimal(8,1)"), ColumnType("price", "decimal(18,2)")),
        (ColumnType("o_orderstatus", "json"), ColumnType("o_orderstatus", "varchar(1)")),
        (ColumnType("o_orderkey", "bigint unsigned", False), ColumnType("o_orderkey", "bigint", False)),
    ]


@query("coercion_blockers", f"""with {T}, p as (select *, o_totalprice::decimal(18,2) as price from t), c as (
  select 'o_custkey' as column_name, count(*) filter (where o_custkey is null or o_custkey not between -32768 and 32767) as blockers from p
  union all select 'o_orderpriority', count(*) filter (where length(o_orderpriority) > 6) from p
  union all select 'price', count(*) filter (where abs(price) > 9999999.9 or price <> round(price, 1)) from p
  union all select 'o_orderstatus', count(*) from p union all select 'o_orderkey', count(*) filter (where o_orderkey < 0) from p)
  select *, case when blockers > 0 then 'blocked' else 'passed' end as verdict from c""")
def coercion_blockers(spark, d):
    return preflight(priced(target_orders(spark, d)), _conversions())


@query("coercion_samples", f"with {T} select o_orderkey from t where length(o_orderpriority) > 6 order by o_orderkey limit 10")
def coercion_samples(spark, d):
    return samples(target_orders(spark, d), ["o_orderkey"], *_conversions()[1])
