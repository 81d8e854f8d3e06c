"""Plans and passes that must not grow faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import ddl, diff, keyset, repair, sync
from keyloom.session import materialise, work_path
from test_operators import SPEC, frame, got
from test_repair import OWNERS, PAIR, SCHEMA


def test_pieces_of_windows_are_never_broadcast(spark):
    """A few endless windows stand for many pieces, which Spark's estimate doesn't count."""
    df = spark.range(2000).select((F.col("id") / 4).cast("int").alias("a"), F.lit("x").alias("b"), "id")
    bound = "struct<a:int,b:string>"
    w = spark.createDataFrame([(i, (i, "x"), None) for i in range(5)], f"window int, after {bound}, end {bound}")
    out = keyset.window_join(df, materialise(w, "windows"), PAIR)
    found = len(out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()  # the final one first
    assert min(plan.index(j) for j in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") if j in plan) == plan.index("SortMergeJoin")
    assert found == sum(2000 - 4 * (i + 1) for i in range(5))


def test_rows_meet_windows_by_lists(spark, monkeypatch):
    """Windows that cover a block are joined as lists, and the tasks of the join grow with its result."""
    monkeypatch.setattr(keyset, "ROWS_OF_TASK", 500)
    monkeypatch.setattr(keyset, "SPAN", 64)
    df = spark.range(2000).select((F.col("id") / 4).cast("int").alias("a"), F.lit("x").alias("b"), "id")
    bound = "struct<a:int,b:string>"
    w = spark.createDataFrame([(i, (i, "x"), None) for i in range(70)] + [(None, None, None)], f"window int, after {bound}, end {bound}")
    out, found = keyset.window_join(df, w, PAIR), lambda df: sorted(((r["id"], -1 if r["window"] is None else r["window"]) for r in df.collect()))
    want = sorted([(r, i) for i in range(70) for r in range(4 * (i + 1), 2000)] + [(r, -1) for r in range(2000)])
    assert found(out) == want
    plans, met = [out._jdf.queryExecution().executedPlan().executedPlan()], []
    while plans:
        plan = plans.pop()
        plans += [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
        met += [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "SortMergeJoin" else []
    assert len(met) == 1 and met[0] < len(want) / 4
    assert out.rdd.getNumPartitions() >= len(want) // 500
    monkeypatch.setattr(keyset, "LIST_BYTES", 1)  # rows too wide for lists
    assert found(keyset.window_join(df, w, PAIR)) == want


def test_a_run_compares_many_steps_at_once(spark, monkeypatch):
    """The comparisons of a run grow with the logarithm of its steps; an interrupted wave counts as far as it is published."""
    rng = random.Random(5)
    side = lambda: [(a, b, rng.choice([None, "1", "2"])) for a in range(40) for b in "xyz" if rng.random() < 0.7]
    s, t = side(), [(-1, "x", "early"), *side(), (99, "z", "tail")]
    source, target, path, seen = frame(spark, s), frame(spark, t), work_path(spark, "sync"), []
    plain, compare = sync.SyncRun(spark, work_path(spark, "sync"), SPEC, 3), sync.diff.changes
    for _ in range(3):
        plain.step(source, target, 2)
    half = got(plain.result(target))
    while plain.step(source, target, 2):
        pass
    monkeypatch.setattr(sync.diff, "changes", lambda *a: seen.append(1) or compare(*a))
    run = sync.SyncRun(spark, path, SPEC, 3)
    create = run.records.create
    monkeypatch.setattr(run.records, "create", lambda name, record: pytest.fail("stop") if name == "steps/3" else create(name, record))
    with pytest.raises(BaseException, match="stop"):
        run.run(source, target, 2)
    assert len(run.progress().collect()) == 3 and len(seen) == 2
    assert got(run.result(target)) == half
    again = sync.SyncRun(spark, path, SPEC, 3)
    again.retry()
    again.run(source, target, 2)
    p = again.progress().drop("rows_scanned").collect()
    assert p == plain.progress().drop("rows_scanned").collect() and len(p) > 12 and len(seen) <= 5
    assert got(again.result(target)) == got(plain.result(target)) == sorted(s, key=str)


def test_filters_on_operations_run_no_patterns_again(spark):
    df = spark.createDataFrame([(1, "ALTER TABLE t ADD c INT, DROP d"), (2, "CREATE TABLE t (a INT, b INT")], "id int, sql string")
    out = ddl.parse(df, ["id"]).where("object is not null and operation <> 'drop_column'")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp_extract" not in plan
    assert sorted((r["id"], r["item"], r["name"]) for r in out.collect() if r["error"] is None) == [(1, 1, "c"), (2, 0, None)]


def test_key_sets_are_grouped_once(spark):
    """One grouping for all sides, without a sort; nulls compare as values, as in EXCEPT."""
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    out = diff.same_key_set(keys(1, 2, 2, None), keys(2, 3, 3, None), keys(1, 2), keys(1, 2, None))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "missing", 0), (3, "unexpected", 0), (None, "missing", 1)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_rounds_of_owners_read_source_and_target_once(spark):
    """However many rounds a chain takes, the given tables are worked out once each."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = 6
    rows = lambda back: spark.createDataFrame([(i, str(i - back), None, None) for i in range(n)], SCHEMA).mapInArrow(counted, SCHEMA)
    plan = repair.unique_owners(spark.createDataFrame([(0, "0", None, None)], SCHEMA), rows(0), rows(1), OWNERS, ["token"])
    assert sorted((r["node"]["id"], r["round"]) for r in plan.collect()) == [(i, n - 1 - i) for i in range(n)]
    assert seen.value <= 3 * n
