"""Queries over change logs: the events table as a log, decoded log text, statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import classify
from keyloom.operators import apply, changelog
from keyloom.plans.registry import query
from keyloom.plans.spec import TableSpec
from keyloom.session import materialise, read_table, work_path
from keyloom.sources import log_text

USERS = TableSpec("users", ("user_id",), ("user_id", "value", "event_type"))
#: A log file holds so many events here.
FILE = 1000
LOG = f"""log as (select *, 'log.' || lpad((event_id // {FILE})::varchar, 6, '0') as file, event_id // {FILE} as f, (event_id % {FILE} + 1) * 10 as pos,
  case event_type when 'error' then 'D' when 'signup' then 'I' else 'U' end as op from events)"""


def events_log(spark, d):
    """Each event as a change of its user's row: errors delete, signups insert, others update."""
    e = read_table(spark, d, "events")
    image = F.struct("user_id", "value", "event_type")
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    f = F.floor(F.col("event_id") / FILE)
    log = e.withColumns({"file": F.concat(F.lit("log."), F.lpad(f.cast("string"), 6, "0")), "pos": ((F.col("event_id") % FILE) + 1) * 10, "op": op})
    log = log.withColumn("coord", changelog.coordinate(F.col("file"), F.col("pos")))
    none = F.lit(None).cast(log.select(image.alias("i")).schema["i"].dataType)
    return log.withColumns({"before": F.when(F.col("op") != "I", F.struct("user_id", F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("event_type"))).otherwise(none), "after": F.when(F.col("op") != "D", image).otherwise(none)})


def no_users(spark):
    return spark.createDataFrame([], "user_id long, value double, event_type string")


FINAL = f"""with {LOG}, c as (select user_id, max(event_id) filter (where op = 'D') as cut from log group by 1),
  l as (select log.*, cut from log join c using (user_id) where event_id > coalesce(cut, -1)),
  b as (select user_id, min(event_id) as born, arg_min(value, event_id) as v, arg_min(event_type, event_id) as e from l where op = 'I' group by 1),
  u as (select user_id, arg_max(l.value, event_id) as v, arg_max(l.event_type, event_id) as e from l join b using (user_id) where op = 'U' and event_id > born group by 1)
  select user_id, case when u.e is null then b.v else u.v end as value, coalesce(u.e, b.e) as event_type from b left join u using (user_id)"""


@query("cdc_final_state", FINAL)
def cdc_final_state(spark, d):
    return apply.apply_log(no_users(spark), events_log(spark, d), USERS)


@query("cdc_final_state_in_parts", FINAL)
def cdc_final_state_in_parts(spark, d):
    """The same in three batches cut anywhere."""
    log, state = events_log(spark, d), no_users(spark)
    for lo, hi in ((0, 0.3), (0.3, 0.31), (0.31, 2)):
        n = log.agg(F.max("event_id")).first()[0] or 0
        state = materialise(apply.apply_log(state, log.where((F.col("event_id") >= int(lo * n)) & (F.col("event_id") < int(hi * n))), USERS), "state")
    return state


@query("cdc_stream_apply", FINAL)
def cdc_stream_apply(spark, d):
    """The same through Structured Streaming: the log as files, applied batch by batch to a versioned target."""
    from keyloom.streaming.apply_stream import VersionedTarget, run_available, stream_log

    log = events_log(spark, d).select("file", "pos", "coord", "op", "before", "after")
    source, at = work_path(spark, "log"), work_path(spark, "target")
    log.repartitionByRange(3, "coord").write.parquet(source)
    target = VersionedTarget(spark, at, USERS.key)
    target.commit(no_users(spark), -1, None)
    run_available(stream_log(spark, source, log.schema, 100), target, USERS, f"{at}-checkpoint")
    return target.read()


@query("cdc_stream_grouped", FINAL.replace(LOG, f"""{LOG.replace("log as", "all_log as", 1)}, turn as (select max(event_id) as turn from all_log where event_id % 1500 = 1499),
  nth as (select event_id, row_number() over (order by event_id) as k from all_log, turn where event_type = 'purchase' and event_id > coalesce(turn, -1)),
  cut as (select greatest(coalesce((select turn from turn), -1), coalesce((select max(event_id) from nth where k % 5 = 0), -1)) as cut),
  log as (select all_log.* from all_log, cut where event_id <= cut.cut)"""))
def cdc_stream_grouped(spark, d):
    """The target after a stream that commits groups of five transactions, or what there is at a rotation; the rest waits."""
    from keyloom.streaming.apply_stream import VersionedTarget, run_available, stream_log

    log = events_log(spark, d).withColumns({"closes": F.col("event_type") == "purchase", "rotates": F.col("event_id") % 1500 == 1499})
    log = log.select("file", "pos", "coord", "op", "before", "after", "closes", "rotates")
    source, at = work_path(spark, "log"), work_path(spark, "target")
    log.repartitionByRange(3, "coord").sortWithinPartitions("coord").write.parquet(source)
    target = VersionedTarget(spark, at, USERS.key)
    target.commit(no_users(spark), -1, None)
    run_available(stream_log(spark, source, log.schema, 100), target, USERS, f"{at}-checkpoint", group=5)
    return target.read()


@query("cdc_compacted", f"with {LOG} select user_id, arg_max(op, event_id) as op, count(*) as changes from log group by 1")
def cdc_compacted(spark, d):
    return apply.compact(events_log(spark, d), USERS).select("user_id", "op", "changes")


@query("cdc_transactions", f"with {LOG}, t as (select event_id, coalesce(sum((event_type = 'purchase')::int) over (order by f, pos rows between unbounded preceding and 1 preceding), 0) + 1 as txn from log) select txn::bigint as txn, count(*) as events, min(event_id) as first_event from t group by 1")
def cdc_transactions(spark, d):
    t = changelog.transaction_ids(events_log(spark, d), F.col("event_type") == "purchase")
    return t.groupBy("txn").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query("cdc_transaction_groups", f"with {LOG}, t as (select event_id, coalesce(sum((event_type = 'purchase')::int) over (order by f, pos rows between unbounded preceding and 1 preceding), 0)::bigint as txn from log) select txn // 5 as \"group\", count(*) as events, max(event_id) as last_event from t group by 1")
def cdc_transaction_groups(spark, d):
    t = changelog.transaction_ids(events_log(spark, d), F.col("event_type") == "purchase")
    return changelog.transaction_groups(t, 5).groupBy("group").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))


@query("cdc_carried_position", f"with {LOG} select event_id, last_value(case when event_type = 'view' then pos end ignore nulls) over (order by f, pos) as at from log")
def cdc_carried_position(spark, d):
    return changelog.carried(events_log(spark, d), F.when(F.col("event_type") == "view", F.col("pos")), "at").select("event_id", "at")


@query("cdc_event_start", f"with {LOG} select event_id, coalesce(lag(pos) over (partition by file order by pos), 4) as start_pos, pos as end_pos from log")
def cdc_event_start(spark, d):
    return changelog.previous_end(events_log(spark, d)).select("event_id", "start_pos", F.col("pos").alias("end_pos"))


MAPS = f"with {LOG}, m as (select user_id % 7 as table_id, event_id, case when user_id % 2 = 0 then 2 else 3 end as width from log where event_type = 'signup' and user_id % 7 <> 3), r as (select event_id, user_id % 7 as table_id from log where event_type = 'click')"


def _mapped(spark, d):
    log = events_log(spark, d).withColumn("table_id", F.col("user_id") % 7)
    names = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("id"), F.lit("value"))).otherwise(F.array(F.lit("id"), F.lit("value"), F.lit("note")))
    maps = log.where("event_type = 'signup' and table_id <> 3").select("table_id", "coord", names.alias("map"))
    return changelog.schema_as_of(log.where("event_type = 'click'").select("event_id", "table_id", "coord"), maps)


@query("cdc_schema_as_of", f"{MAPS} select r.event_id, r.table_id, m.width::int as width from r asof left join m on r.table_id = m.table_id and r.event_id >= m.event_id")
def cdc_schema_as_of(spark, d):
    return _mapped(spark, d).select("event_id", "table_id", F.when(F.col("map").isNotNull(), F.size("map")).alias("width"))


@query("cdc_skipped_tables", f"{MAPS} select r.table_id, count(*) as skipped from r asof left join m on r.table_id = m.table_id and r.event_id >= m.event_id where width is distinct from 3 group by 1")
def cdc_skipped_tables(spark, d):
    return changelog.split_known(_mapped(spark, d), F.lit(3))[1].groupBy("table_id").agg(F.count("*").alias("skipped"))


@query("cdc_bounded_stop", f"""with {LOG}, m as (select count(*) as n, max(event_id) as last, max(event_id) filter (where event_type = 'purchase') as bought, max(event_id) filter (where event_type = 'click') as clicked from events)
  select f as stop_file, pos - 5 as stop, n - 1 as applied, 'inside_event' as outcome from log, m where event_id = last union all select f + 1, 5, n, 'not_reached' from log, m where event_id = last
  union all select f, pos, (select count(*) from events, m where event_id <= bought), 'reached' from log, m where event_id = bought
  union all select f, pos, (select count(*) from events, m where event_id <= clicked), 'inside_transaction' from log, m where event_id = clicked""")
def cdc_bounded_stop(spark, d):
    """Stops in the last files, over the log of all files."""
    events = events_log(spark, d)
    log = changelog.previous_end(events).withColumn("event_type", F.when(F.col("event_type") == "purchase", "commit").otherwise("rows"))
    at = events.agg(F.max("coord").alias("last"), *[F.max(F.when(F.col("event_type") == x, F.col("coord"))).alias(x) for x in ("purchase", "click")]).first()
    out = changelog.bounded_stop(log.limit(0), 0, 0).select(F.lit(0).cast("long").alias("stop_file"), F.lit(0).cast("long").alias("stop"), "applied", "outcome").limit(0)
    stops = [(at["last"]["file"], at["last"]["pos"] - 5), (at["last"]["file"] + 1, 5)] if at["last"] else []
    for file, stop in stops + [tuple(at[x]) for x in ("purchase", "click") if at[x]]:
        out = out.unionByName(changelog.bounded_stop(log, stop, file).select(F.lit(file).cast("long").alias("stop_file"), F.lit(stop).cast("long").alias("stop"), "applied", "outcome"))
    return out


@query("cdc_no_overtake", f"with {LOG} select count(*) as rows, max(event_id) as last_event from log where event_id <= coalesce((select min(event_id) from log where user_id = 33 and event_type = 'error'), 9223372036854775807)")
def cdc_no_overtake(spark, d):
    log = events_log(spark, d)
    return changelog.no_overtake(log, log.where("user_id = 33 and event_type = 'error'")).agg(F.count("*").alias("rows"), F.max("event_id").alias("last_event"))


@query("cdc_not_advancing", f"with {LOG}, x as (select file, pos, (event_id * 37) % 1009 as seq from log), p as (select *, lag(pos) over (partition by file order by seq) as p from x) select file, seq, pos from p where pos <= p")
def cdc_not_advancing(spark, d):
    log = events_log(spark, d).select("file", "pos", ((F.col("event_id") * 37) % 1009).alias("seq"))
    return changelog.must_advance(log).select("file", "seq", "pos")


POLICY = "case event_type when 'signup' then 'table_map' when 'click' then 'insert' when 'view' then 'update' when 'error' then 'annotation' else 'commit' end"


@query("cdc_event_policies", f"with x as (select {POLICY} as t from events) select case t when 'table_map' then 'apply_table_map' when 'commit' then 'commit_transaction' when 'annotation' then 'ignore_annotation' else 'apply_rows' end as policy, count(*) as events from x group by 1")
def cdc_event_policies(spark, d):
    t = F.expr(POLICY)
    return read_table(spark, d, "events").groupBy(changelog.event_policy(t).alias("policy")).agg(F.count("*").alias("events"))


@query("cdc_resume_points", f"with {LOG} select event_id, case when event_type = 'purchase' then pos end as resume from log")
def cdc_resume_points(spark, d):
    log = changelog.previous_end(events_log(spark, d))
    kind = F.when(F.col("event_type") == "purchase", "commit").otherwise("rows")
    return log.select("event_id", changelog.resume_coordinate(kind, F.col("start_pos"), F.col("pos")).alias("resume"))


@query("cdc_lag", f"with {LOG} select count(*) as lag from log where f > 3 or f = 3 and pos > 500")
def cdc_lag(spark, d):
    return changelog.lag_after(events_log(spark, d), F.struct(F.lit(3).cast("long").alias("file"), F.lit(500).cast("long").alias("pos")))


@query("cdc_source_coordinate", f"with {LOG} select arg_max(file, event_id) as file, arg_max(pos, event_id) as pos from log")
def cdc_source_coordinate(spark, d):
    m = events_log(spark, d).agg(F.max(F.struct("coord", "file", "pos")).alias("m"))
    return m.select("m.file", "m.pos")


@query("cdc_full_images", "select count(*) filter (where user_id is not null and event_type is not null and event_id % 7 <> 0) as full_rows, count(*) filter (where user_id is null or event_type is null or event_id % 7 = 0) as partial_rows from events")
def cdc_full_images(spark, d):
    """Each seventh image lacks a column. The full ones pass the check that fails on any other."""
    log = events_log(spark, d).withColumn("present", F.array(F.col("user_id").isNotNull(), F.col("event_type").isNotNull(), F.col("event_id") % 7 != 0))
    full, partial = apply.split_full_images(log)
    return apply.require_full_images(full).agg(F.count("*").alias("full_rows")).join(F.broadcast(partial.agg(F.count("*").alias("partial_rows"))))


# --- decoded text -----------------------------------------------------------------------------------------------

LINES = [
    "# at 4", "#250101 server id 1 Start: binlog", "# at 256", "#250101 GTID 0-1-7 trans", "# at 300", "# Query: BEGIN", "CREATE TABLE a (id INT,", "  v INT);",
    "# at 400", "#250101 Table_map: `db`.`a` mapped to number 7", "# at 450", "### INSERT INTO `db`.`a`", "### SET", "###   @1=1", "### @2=5", "# at 500", "### UPDATE `db`.`a`", "### WHERE",
    "### @1=1", "### delete from `db`.`a`", "", "update a set v = 1 where id = 2;", "COMMIT;", "# at 620", "#250101 Rotate to log.000002  pos: 4", "# at 4", "INSERT INTO a VALUES (1, ';');", "  ALTER TABLE a ADD w INT;", "something else;", "# comment without meaning",
]


def values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


def _lines(spark):
    return spark.createDataFrame([("log-text", i, x) for i, x in enumerate(LINES)], "source string, n int, line string")


LINE_SQL = f"""with l as (select * from {values([(i, x) for i, x in enumerate(LINES)], 'n, line')}), c as (select n, trim(line) as t, upper(trim(line)) as u from l),
k as (select *, case when t = '' then null when t like '%Rotate to %' then 'rotate'
  when t like '#%' and t not like '###%' then case when regexp_matches(t, '^# at [0-9]') then null when u like '# QUERY%' then 'query' when t like '%GTID%' then 'gtid' when t like '%Table_map:%' then 'table_map' end
  when u like '### INSERT INTO%' then 'rows_insert' when u like '### UPDATE%' then 'rows_update' when u like '### DELETE%' then 'rows_delete'
  when regexp_matches(u, '^(INSERT INTO|UPDATE |DELETE FROM|CREATE |ALTER |DROP |TRUNCATE )') then 'statement' when t like '### @%' then null else 'unknown' end as class,
  case when t like '# at %' then split_part(t, ' ', 3)::bigint end as p, case when t like '%Rotate to %' then regexp_extract(t, 'Rotate to ([^ ]+)', 1) end as rot from c),
e as (select n, t, class, coalesce(last_value(p ignore nulls) over w, 4) as pos, coalesce(last_value(rot ignore nulls) over w, 'log.000001') as file from k window w as (order by n))"""


@query("log_line_classes", f"{LINE_SQL} select n, class, file, pos from e where class is not null")
def log_line_classes(spark, d):
    return log_text.events(_lines(spark), "log.000001").select("n", "class", "file", "pos")


@query("log_line_class_totals", f"{LINE_SQL} select class, count(*) as events from e where class is not null group by 1")
def log_line_class_totals(spark, d):
    return log_text.totals(_lines(spark), "log.000001")


@query("log_statements", """select * from (values (0::bigint, 'log.000001', 300::bigint, 'CREATE TABLE a (id INT,
  v INT);'), (1, 'log.000001', 500, 'update a set v = 1 where id = 2;'), (2, 'log.000001', 500, 'COMMIT;'), (3, 'log.000002', 4, 'INSERT INTO a VALUES (1, '';'');'), (4, 'log.000002', 4, '  ALTER TABLE a ADD w INT;'), (5, 'log.000002', 4, 'something else;')) v(statement, file, pos, sql)""")
def log_statements(spark, d):
    return log_text.statements(_lines(spark), "log.000001").select("statement", "file", "pos", "sql")


STATEMENTS = [
    ("", "quarantine", "empty", None), ("-- note\n /* x */ ;", "quarantine", "empty", None), ("insert into a values (1);", "replay", None, None), ("# c\nUPDATE a SET v = 'x;y'", "replay", None, None),
    ("DELETE FROM a; DELETE FROM b", "quarantine", "multi_statement", None), ("CREATE TRIGGER t BEFORE INSERT ON a FOR EACH ROW BEGIN SET x = 1; SET y = 2; END", "replay", None, None),
    ("INSERT INTO a VALUES (1) RETURNING id", "quarantine", "vendor_only", "RETURNING"), ("INSERT INTO a VALUES ('RETURNING')", "replay", None, None), ("CREATE SEQUENCE s", "quarantine", "vendor_only", "SEQUENCE"),
    ("CREATE TABLE sequences (id INT)", "replay", None, None), ("SELECT LOAD_FILE('/x')", "quarantine", "unsafe", "LOAD_FILE("), ("CREATE DEFINER=`a` VIEW v AS SELECT 1", "quarantine", "unsafe", "DEFINER"),
    ("ALTER TABLE a ADD COLUMN IF NOT EXISTS b INT", "quarantine", "vendor_only", "IF NOT EXISTS"), ("CREATE TABLE IF NOT EXISTS a (id INT)", "replay", None, None), ("DROP TABLE IF EXISTS a", "replay", None, None),
    ("DROP INDEX IF EXISTS i ON a", "quarantine", "vendor_only", "IF EXISTS"), ("GRANT ALL ON a TO b", "skip", None, None), ("drop user x", "skip", None, None), ("TRUNCATE a", "replay", None, None),
    ("SELECT 1", "quarantine", "unsupported", "SELECT"), ("call p()", "quarantine", "unsupported", "call"), ("RENAME TABLE a TO b", "replay", None, None), ("INSERT INTO a VALUES (1) -- ; x", "replay", None, None),
]


def _statements(spark):
    return spark.createDataFrame([(i, s[0]) for i, s in enumerate(STATEMENTS)], "n int, raw string").withColumn("sql", classify.normalise(F.col("raw")))


@query("statement_decisions", f"select * from {values([(i, *s[1:]) for i, s in enumerate(STATEMENTS)], 'n, decision, reason, detail')}")
def statement_decisions(spark, d):
    return _statements(spark).select("n", classify.statement_decision(F.col("sql")).alias("x")).select("n", "x.*")


@query("statement_totals", f"select decision, count(*) as statements from {values([(i, *s[1:]) for i, s in enumerate(STATEMENTS)], 'n, decision, reason, detail')} group by 1")
def statement_totals(spark, d):
    return statement_decisions(spark, d).groupBy("decision").agg(F.count("*").alias("statements"))


@query("statement_kinds", f"""with s as (select * from {values([(i, s[0]) for i, s in enumerate(STATEMENTS)], 'n, raw')}), t as (select n, upper(trim(regexp_replace(regexp_replace(raw, '^(--|#)[^\n]*\n?', ''), '^\\s*/\\*.*?\\*/', ''))) as u from s)
  select n, regexp_matches(u, '^(ALTER|CREATE|DROP|RENAME|TRUNCATE)\\s') as changes_schema, regexp_matches(u, '^(INSERT INTO|UPDATE|DELETE FROM|REPLACE INTO) ') as changes_data,
  case when u like 'RENAME%' then 'rename' when u like 'TRUNCATE%' then 'truncate' else coalesce(nullif(lower(regexp_extract(u, '^(?:CREATE|ALTER|DROP)\\s+(?:UNIQUE\\s+)?(TABLE|INDEX|VIEW|PROCEDURE|FUNCTION|EVENT|TRIGGER)\\b', 1)), ''), 'other') end as family from t""")
def statement_kinds(spark, d):
    s = F.col("sql")
    return _statements(spark).select("n", classify.changes_schema(s).alias("changes_schema"), classify.changes_data(s).alias("changes_data"), F.when(classify.changes_schema(s), classify.ddl_family(s)).otherwise("other").alias("family"))


QUERY_EVENTS = [(0, "BEGIN", "db", "transaction_control"), (1, "commit ;", "db", "transaction_control"), (2, "INSERT INTO a VALUES (1)", "db", "contract_violation"), (3, "INSERT INTO a VALUES (1)", "other", "ignore"), (4, "ALTER TABLE a ADD b INT", "db", "schema_change"), (5, "FLUSH LOGS", "db", "ignore")]


@query("query_event_policies", f"select n, policy from {values(QUERY_EVENTS, 'n, sql, db, policy')}")
def query_event_policies(spark, d):
    q = spark.createDataFrame([x[:3] for x in QUERY_EVENTS], "n int, sql string, db string")
    return q.select("n", classify.query_policy(F.col("sql"), F.col("db"), "db").alias("policy"))


ERRORS = [(0, "Lost connection to server", True, False), (1, "Connection reset by peer", True, False), (2, "requested file was purged", False, True), (3, "Could not find first log file name", False, True), (4, "Duplicate entry", False, False), (5, "read timed out", True, False)]


@query("error_classes", f"select n, retryable, stale from {values(ERRORS, 'n, error, retryable, stale')}")
def error_classes(spark, d):
    e = spark.createDataFrame([x[:2] for x in ERRORS], "n int, error string")
    return e.select("n", classify.is_retryable(F.col("error")).alias("retryable"), classify.is_stale(F.col("error")).alias("stale"))


@query("cdc_stream_schema", f"{MAPS.replace('m as (select', 'm0 as (select', 1)}, g as (select user_id % 7 as table_id, event_id, null as width from log where event_type = 'error' and user_id % 10 = 0), m as (select * from m0 union all select * from g) select r.event_id, r.table_id, m.width::int as width from r asof left join m on r.table_id = m.table_id and r.event_id >= m.event_id")
def cdc_stream_schema(spark, d):
    """Widths of the maps as of each row, by a stream with keyed state that is stopped half way; some errors stand for schema changes."""
    from keyloom.streaming import keyed

    names = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("id"), F.lit("value"))).otherwise(F.array(F.lit("id"), F.lit("value"), F.lit("note")))
    table = F.col("user_id") % 7
    kind = F.when((F.col("event_type") == "signup") & (table != 3), "table_map").when((F.col("event_type") == "error") & (F.col("user_id") % 10 == 0), "schema_change").when(F.col("event_type") == "click", "rows")
    log = events_log(spark, d).withColumn("kind", kind).where("kind is not null")
    log = log.select(table.alias("key"), F.col("event_id").alias("id"), "coord.file", "coord.pos", F.col("kind").alias("event_type"), F.lit(None).cast("string").alias("name"), F.when(F.col("kind") == "table_map", F.to_json(names)).alias("value"))
    source, out, checkpoint = (work_path(spark, x) for x in ("log", "mapped", "checkpoint"))
    stream = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 100).parquet(source)
    half = (log.agg(F.max("id")).first()[0] or 0) // 2
    for part in (log.where(F.col("id") <= half), log.where(F.col("id") > half)):
        part.write.mode("append").parquet(source)
        keyed.run_available(stream(), out, checkpoint)
    return spark.read.schema("key long, id long, event_type string, map string").parquet(out).where("event_type = 'rows'").select(F.col("id").alias("event_id"), F.col("key").alias("table_id"), F.size(F.from_json("map", "array<string>")).alias("width")).withColumn("width", F.when(F.col("width") >= 0, F.col("width")))


@query("cdc_stream_totals", f"with {LOG} select count(*) as applied, count(*) filter (where op = 'I') as inserts, count(*) filter (where op = 'U') as updates, count(*) filter (where op = 'D') as deletes from log")
def cdc_stream_totals(spark, d):
    """What a stream applied, by operation, from its last commit record; a stopped stream goes on counting."""
    from keyloom.streaming.apply_stream import VersionedTarget, run_available, stream_log

    log = events_log(spark, d).select("file", "pos", "coord", "op", "before", "after")
    source, at = work_path(spark, "log"), work_path(spark, "target")
    target = VersionedTarget(spark, at, USERS.key)
    target.commit(no_users(spark), -1, None)
    half = log.agg(F.max("coord.file")).first()[0] or 0
    for part in (log.where(F.col("coord.file") <= half // 2), log.where(F.col("coord.file") > half // 2)):
        part.write.mode("append").parquet(source)
        run_available(stream_log(spark, source, log.schema, 100), target, USERS, f"{at}-checkpoint")
    names = ("applied", "inserts", "updates", "deletes")
    return spark.createDataFrame([tuple(target.head()["totals"].get(n, 0) for n in names)], ", ".join(f"{n} long" for n in names))


def _decoded(spark, d):
    """The events as decoded log text, a file for each log file; some lines of a statement stand alone."""
    e = events_log(spark, d)
    n = F.col("event_id").cast("string")
    body = (
        F.when(F.col("event_type") == "signup", F.array(F.lit("### INSERT INTO `db`.`users`"), F.lit("### SET"), F.concat(F.lit("###   @1="), n)))
        .when(F.col("event_type") == "click", F.array(F.lit("#250101 Table_map: `db`.`users` mapped to number 7"), F.lit("### UPDATE `db`.`users`")))
        .when(F.col("event_type") == "error", F.array(F.lit("### DELETE FROM `db`.`users`")))
        .when(F.col("event_type") == "purchase", F.array(F.lit("COMMIT;"), F.lit("")))
        .otherwise(F.array(F.concat(F.lit("update users set v = "), n), F.lit("# a comment between"), F.lit("  where id = 1;")))
    )
    lines = F.concat(F.array(F.concat(F.lit("# at "), F.col("pos").cast("string"))), body)
    path = work_path(spark, "decoded")
    e.select("coord.file", "event_id", F.posexplode(lines).alias("i", "value")).repartition("file").sortWithinPartitions("file", "event_id", "i").select("file", "value").write.partitionBy("file").text(path)
    return log_text.split_lines(spark, path)


@query("log_split_statements", f"""with {LOG}, s as (select f, event_id, pos, event_type from log where event_type in ('purchase', 'view'))
  select f as source, row_number() over (partition by f order by event_id) - 1 as statement, pos::bigint as pos, case event_type when 'purchase' then 'COMMIT;' else 'update users set v = ' || event_id || chr(10) || '  where id = 1;' end as sql from s""")
def log_split_statements(spark, d):
    """Statements of decoded logs, read in splits."""
    s = log_text.split_statements(_decoded(spark, d), "log.000000")
    return s.select(F.regexp_extract("source", r"file=(\d+)", 1).cast("long").alias("source"), "statement", "pos", "sql")


@query("log_split_totals", f"""with {LOG}, c as (select f, unnest(case event_type when 'signup' then ['rows_insert', 'unknown', 'unknown'] when 'click' then ['table_map', 'rows_update'] when 'error' then ['rows_delete'] when 'purchase' then ['unknown'] else ['statement', 'unknown'] end) as class from log)
  select f as source, class, count(*) as events from c group by 1, 2""")
def log_split_totals(spark, d):
    """Events of decoded logs by class, read in splits."""
    c = log_text.split_classified(_decoded(spark, d), "log.000000").where("class is not null")
    return c.groupBy(F.regexp_extract("source", r"file=(\d+)", 1).cast("long").alias("source"), "class").agg(F.count("*").alias("events"))
