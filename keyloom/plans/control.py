"""Control plane: runs, journals, ledgers, recovery records, and the checks of their transitions."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.encode import identity

# Transitions that each state machine allows ("" is: no row before).
JOURNAL = [("", "translation_pending"), ("", "prepared"), ("translation_pending", "prepared"), ("prepared", "applied"), ("prepared", "blocked"), ("blocked", "applied"), ("applied", "checkpointed")]
LEDGER = [("", "unresolved"), ("unresolved", "unresolved"), ("unresolved", "resolved")]
RECOVERY = [("", "prepared"), ("prepared", "abandoned"), ("prepared", "committed"), ("committed", "verified")]
RUN = [("", "running"), ("running", "running"), ("running", "complete"), ("running", "error")]
STAGES = ["prerequisite_schema", "rows", "final_constraints"]


def violations(history: DataFrame, allowed: list[tuple[str, str]], key: list[str]) -> DataFrame:
    """Steps of a history (key, seq, status) that aren't allowed, with the status before."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy(*key).orderBy("seq")), F.lit(""))
    pairs = F.array(*[F.concat(F.lit(a), F.lit(">"), F.lit(b)) for a, b in allowed])
    h = history.withColumn("before", before)
    return h.where(~F.array_contains(pairs, F.concat("before", F.lit(">"), "status")))


def ledger_step(old: Column, new: Column) -> Column:
    """Is a ledger row's change valid: structs with status, attempts, run_id, evidence. Resolved rows never change."""
    same = (new["attempts"] == old["attempts"] + 1) & (new["status"] == "unresolved")
    done = (new["status"] == "resolved") & new["run_id"].isNotNull() & new["evidence"].isNotNull() & (new["attempts"] == old["attempts"])
    return F.when(old.isNull(), (new["status"] == "unresolved") & (new["attempts"] == 1)).when(old["status"] == "resolved", False).otherwise(same | done)


def reconcile_prepared(pre: Column, expected: Column, observed: Column) -> Column:
    """What a prepared step turned out to be: proven if the expected state is there and differs from the state before."""
    return (
        F.when((observed == expected) & (pre != expected), "proven")
        .when((observed == expected) & (pre == expected), "blocked: no change to tell")
        .when(observed == pre, "blocked: still in the state before")
        .otherwise("blocked: unknown state")
    )


def reused(events: DataFrame, journal: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Events whose coordinate the journal holds with other immutable fields, and which."""
    j = journal.select(*key, F.struct(*fields).alias("_j"))
    d = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_j.{f}")), F.lit(f)) for f in fields]).cast("array<string>"))
    return events.join(j, key).withColumn("fields", F.array_join(d, ",")).where("fields <> ''").select(*key, "fields")


def active_barriers(journal: DataFrame, recovery: DataFrame) -> DataFrame:
    """Unfinished journal rows that no committed or verified recovery owns; the earliest is the barrier."""
    key = ["source", "server_id", "file", "start_pos", "end_pos", "sql_sha"]
    j = journal.where("status in ('translation_pending', 'prepared', 'blocked')").withColumn("sql_sha", F.sha2("raw_sql", 256))
    return j.join(recovery.where("status in ('committed', 'verified')").select(*key), key, "left_anti")


def upsert_latest(table: DataFrame, rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both, of each key the one with the largest version."""
    both = table.unionByName(rows)
    values = F.struct(*[c for c in both.columns if c not in key])
    return both.groupBy(*key).agg(F.max_by(values, version).alias("_r")).select(*key, "_r.*").select(*both.columns)


def insert_if_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table.select(*key), key, "left_anti").select(*table.columns))


def resolve(ledger: DataFrame, scope: Column, run_id: str, evidence: str) -> DataFrame:
    """The ledger with the unresolved rows of a scope resolved."""
    hit = scope & (F.col("status") == "unresolved")
    return ledger.withColumns({"run_id": F.when(hit, run_id).otherwise(F.col("run_id")), "evidence": F.when(hit, evidence).otherwise(F.col("evidence")), "status": F.when(hit, "resolved").otherwise(F.col("status"))})


def compare_and_set(table: DataFrame, key: Column, column: str, expected, new) -> DataFrame:
    """Set a column of the rows of a key that hold the expected value."""
    return table.withColumn(column, F.when(key & F.col(column).eqNullSafe(F.lit(expected)), F.lit(new)).otherwise(F.col(column)))


def conflict_id(*fields: Column) -> Column:
    return identity(*fields)


def run_id(prefix: Column, spec: Column) -> Column:
    return F.concat(F.lit("sync-v1-"), identity(F.lit("run"), prefix, spec))


def table_counts(progress: DataFrame) -> DataFrame:
    """One row: tables compared, and repaired (with a change)."""
    return progress.agg(F.count("*").alias("compared"), F.count_if(F.col("inserts") + F.col("updates") + F.col("deletes") > 0).alias("repaired"))


def recovery_proof(progress: DataFrame, expected: DataFrame, run: str) -> DataFrame:
    """One row: does the progress of a run cover exactly the expected tables, once each, all complete."""
    mine = progress.where(F.col("run_id") == run)
    facts = mine.agg(F.count("*").alias("rows"), F.count_distinct("table_name").alias("tables"), F.count_if(F.col("status") != "complete").alias("incomplete"))
    other = progress.where(F.col("run_id") != run).agg(F.count("*").alias("foreign"))
    both = expected.select("table_name", F.lit(1).alias("e")).join(mine.select("table_name", F.lit(1).alias("p")).distinct(), "table_name", "full_outer")
    scope = both.agg(F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    out = facts.crossJoin(other).crossJoin(scope)  # a row each
    return out.withColumn("proven", (F.col("rows") > 0) & (F.col("rows") == F.col("tables")) & (F.col("incomplete") == 0) & (F.col("foreign") == 0) & (F.col("missing") == 0) & (F.col("unexpected") == 0))


def spec_migration(specs: DataFrame) -> DataFrame:
    """Decision on each changed run spec: old_columns, new_columns (arrays), rows_done, authorised, key_same, settings_same."""
    old, new = F.col("old_columns"), F.col("new_columns")
    kept = F.filter(new, lambda x: F.array_contains(old, x))
    return specs.withColumns({
        "added": F.array_join(F.array_except(new, old), ","),
        "removed": F.array_join(F.array_except(old, new), ","),
        "decision": F.when(old == new, "unchanged")
        .when(~F.col("authorised"), "reject: not authorised")
        .when(~F.col("settings_same"), "reject: settings changed")
        .when(~F.col("key_same"), "reject: key changed")
        .when(F.size(F.array_except(old, new)) > 0, "reject: columns removed")
        .when(kept != old, "reject: order changed")
        .when(F.col("rows_done") > 0, "reject: rows done")
        .otherwise("migrate"),
    })


def one_spec(progress: DataFrame) -> DataFrame:
    """Runs whose rows disagree on the spec."""
    return progress.groupBy("run_id").agg(F.count_distinct("spec").alias("specs")).where("specs <> 1")


def run_tables(tables: list[str], work: Callable[[str], object], parallel: int = 1) -> dict[str, object]:
    """work(table) for all tables in order of name, `parallel` at a time; the first error stops further ones."""
    if parallel < 1:
        raise ValueError("parallel is 1 or more")
    out, names = {}, sorted(tables)
    for i in range(0, len(names), parallel):
        group = names[i : i + parallel]
        with ThreadPoolExecutor(parallel) as pool:
            out |= dict(zip(group, pool.map(work, group)))
    return out


def run_stages(tables: list[str], steps: dict[str, Callable[[str], object]], progress: dict[tuple[str, str], str], parallel: int = 1) -> dict[tuple[str, str], str]:
    """Run the stages in order for tables that aren't complete; progress maps (stage, table) to a status.

    A run with an error must be looked at first: it isn't resumed.
    """
    state = dict(progress)
    if errors := [k for k, v in state.items() if v == "error"]:
        raise RuntimeError(f"the run has an error in {errors[0]}")
    for stage in STAGES:
        open_ = [t for t in tables if state.get((stage, t)) != "complete"]

        def one(table, stage=stage):
            state[stage, table] = "running"
            try:
                steps[stage](table)
            except Exception:
                state[stage, table] = "error"
                raise
            state[stage, table] = "complete"

        run_tables(open_, one, parallel)
    return state


def run_cutover(stop: Callable, drain: Callable[[], int], validate: Callable[[], bool], switch: Callable, resume: Callable, allowed_lag: int = 0) -> dict:
    """Stop writes, drain, validate, switch; writes resume whatever happens."""
    out = {"switched": False, "lag": None, "validated": None}
    stop()
    try:
        out["lag"] = drain()
        if out["lag"] <= allowed_lag:
            out["validated"] = validate()
            if out["validated"]:
                switch()
                out["switched"] = True
    finally:
        resume()
    out["passed"] = out["switched"] and out["lag"] == 0
    return out
