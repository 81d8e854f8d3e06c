"""Joins with any windows, repairs along references and unique owners, keyed stream state."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import keyset, repair
from keyloom.plans.spec import TableSpec
from keyloom.session import work_path

PAIR = TableSpec("t", ("a", "b"), ("a", "b", "v"), labels={"b": ("z", "x", "y")})


@pytest.mark.parametrize("span", [1 << 16, 3])
def test_window_join_equals_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(keyset, "SPAN", span)
    rng, place = random.Random(1), ("z", "x", "y").index
    rows = [(rng.randrange(15), rng.choice("xyz"), i) for i in range(120)] + [(None, "x", -1), (3, None, -2)]
    key = lambda: None if rng.random() < 0.15 else (rng.randrange(-2, 17), rng.choice("xyz"))
    windows = [(i, key(), key()) for i in range(40)] + [(50, None, None), (51, (3, "x"), (3, "x"))]
    df = spark.createDataFrame(rows, "a int, b string, v int").withColumn("window", F.lit("mine")).repartition(3)
    w = spark.createDataFrame(windows, "window int, after struct<a:int,b:string>, end struct<a:int,b:string>")
    n = lambda k: (k[0], place(k[1]))
    want = sorted((*r, i) for i, lo, hi in windows for r in rows if r[0] is not None and r[1] is not None and (lo is None or n(r) > n(lo)) and (hi is None or n(r) <= n(hi)))
    got = sorted(tuple(r) for r in keyset.window_join(df, w, PAIR).select("a", "b", "v", "window").collect())
    assert got == want
    assert keyset.window_join(df.limit(0), w, PAIR).count() == 0 and keyset.window_join(df, w.limit(0), PAIR).count() == 0


def parents(spark, wanted, source, target):
    frame = lambda rows: spark.createDataFrame(rows, "k int, p int")
    out = repair.recursive_parents(frame([(k, None) for k in wanted]), frame(source), frame([(k, None) for k in target]), "k", "p")
    return {r["k"]: (r["round"], r["outcome"]) for r in out.collect()}


def test_parents_are_repaired_before_their_children(spark):
    source = [(1, None), (2, 1), (3, 2), (4, 3), (5, 9), (6, 6), (7, 8), (8, 7), (10, 7), (11, 99), (12, 11), (13, 4)]
    got = parents(spark, [4, 4, 5, 6, 10, 12, 77, None, 13], source, [1, 9])
    assert got == {2: (0, "insert"), 3: (1, "insert"), 4: (2, "insert"), 13: (3, "insert"), 5: (0, "insert"), 6: (0, "insert"), 7: (None, "cycle"), 8: (None, "cycle"), 10: (None, "cycle"), 99: (None, "lost"), 11: (None, "behind_lost"), 12: (None, "behind_lost"), 77: (None, "lost")}
    assert parents(spark, [1], source, [1]) == {} and parents(spark, [], source, []) == {}


def test_a_repeated_repair_key_is_a_cycle(spark):
    assert parents(spark, [1], [(1, 2), (2, 3), (3, 1)], []) == {k: (None, "cycle") for k in (1, 2, 3)}


OWNERS = TableSpec("widgets", ("id",), ("id", "token", "page", "v"))
SCHEMA = "id int, token string, page string, v string"


def check_owners(spark, wanted, source, target):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    plan = repair.unique_owners(spark.createDataFrame([(k,) for k in wanted], "id int"), frame(source), frame(target), OWNERS, ["token", "page"]).cache()
    assert repair.broken_rounds(frame(target), plan, OWNERS, ["token", "page"]).count() == 0
    after = {r["id"]: tuple(r) for r in repair.apply_owners(frame(target), plan, OWNERS).collect()}
    # One by one, with the unique key enforced, as the plan says.
    state = {r[0]: r for r in target}
    steps = plan.select("node.id", "action", "round", "parked", "row").collect()
    for s in steps:
        if s["parked"] and s["id"] in state:
            state[s["id"]] = (s["id"], None, None, state[s["id"]][3])
    for s in sorted(steps, key=lambda s: s["round"]):
        if s["action"] == "delete":
            state.pop(s["id"], None)
            continue
        row = tuple(s["row"])
        assert None in row[1:3] or not any(r[1:3] == row[1:3] for k, r in state.items() if k != row[0])
        state[row[0]] = row
    assert state == after
    by = {r[0]: r for r in source}
    assert all(after.get(k) == by.get(k) for k in wanted)
    return {s["id"]: (s["action"], s["round"], s["parked"]) for s in steps}, after


def test_owners_in_chains_and_cycles(spark):
    source = [(1, "a", "p", "s"), (2, "b", "p", "s"), (3, "c", "p", "s"), (4, "d", "p", "s"), (5, "e", "p", "s"), (6, "f", None, "s"), (9, "n", "p", "s")]
    chain = [(1, "z", "p", "t"), (2, "a", "p", "t"), (3, "b", "p", "t"), (7, "c", "p", "t"), (8, "q", "p", "t")]
    plan, after = check_owners(spark, [1], source, chain)
    assert plan == {1: ("update", 3, False), 2: ("update", 2, False), 3: ("update", 1, False), 7: ("delete", 0, False)} and 8 in after
    cycle = [(1, "b", "p", "t"), (2, "c", "p", "t"), (3, "a", "p", "t"), (4, "e", "p", "t"), (5, "d", "p", "t")]
    plan, _ = check_owners(spark, [1, 4], source, cycle)
    assert set(plan.values()) == {("update", 0, True)} and len(plan) == 5
    assert check_owners(spark, [9, 6, 55], source, cycle)[0] == {9: ("insert", 0, False), 6: ("insert", 0, False)}
    assert check_owners(spark, [], source, cycle)[0] == {}


def test_owners_at_random(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcdefghij"), rng.choice(["p", "q", None]), "s") for i in range(24)]
    unique = lambda rs: list({(r[1], r[2]) if r[2] else r[0]: r for r in rs}.values())
    source, target = unique(rows), unique([(i, rng.choice("abcdefghij"), rng.choice(["p", "q", None]), "t") for i in range(24)])
    check_owners(spark, [r[0] for r in source[::3]], source, target)


# --- keyed state ---------------------------------------------------------------------------------------


EVENTS = "key long, id long, file long, pos long, event_type string, name string, value string"


def test_stream_state_for_any_batches(spark):
    from keyloom.streaming import keyed

    rng, rows, want, state, waiting = random.Random(4), [], [], {}, {}
    for i in range(60):
        key, kind = rng.randrange(3), rng.choice(["table_map", "rows", "rows", "schema_change", "intvar", "uservar", "query", "query"])
        value = json.dumps([f"c{i}"]) if kind == "table_map" else str(i)
        rows.append((key, i, i // 20 + 1, i % 20, kind, "INSERT_ID" if kind == "intvar" else "@x" if kind == "uservar" else None, value))
        if kind == "table_map":
            state[key] = value
        elif kind == "schema_change":
            state.pop(key, None)
        elif kind in ("intvar", "uservar"):
            waiting.setdefault(key, []).append(rows[-1][4:])
        if kind in ("rows", "query", "schema_change"):
            context = error = None
            if kind == "query":
                values = waiting.pop(key, [])
                users = [n for k, n, _ in values if k == "uservar"]
                error = f"user variables: {', '.join(users)}" if users else None
                context = json.dumps([[n, v] for _, n, v in values]) if values and not users else None
            want.append((key, i, kind, state.get(key), context, error))
    for cuts in ([60], [7, 23, 24, 60]):  # one batch, and four, each behind a restart
        source, out, checkpoint = (work_path(spark, x) for x in ("log", "out", "checkpoint"))
        at = 0
        for end in cuts:
            part = rows[at:end]
            rng.shuffle(part)
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
            keyed.run_available(spark.readStream.schema(EVENTS).parquet(source), out, checkpoint)
            at = end
        got = spark.read.parquet(out)
        assert sorted((tuple(r) for r in got.select("key", "id", "event_type", "map", "context", "error").collect()), key=lambda r: r[1]) == want
    writes = keyed.can_write_target(F.col("event_type"), F.col("error"), F.col("map"), F.lit(False))
    assert {r["id"] for r in got.where(writes).collect()} == {w[1] for w in want if (w[2] == "rows" and w[3]) or (w[2] == "query" and not w[5])}
