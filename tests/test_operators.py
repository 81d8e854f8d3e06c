import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import scalars
from keyloom.functions.encode import checksum, identity, row_text
from keyloom.operators import apply, changelog, diff, graph, integrity, keyset, sync
from keyloom.plans import control, render
from keyloom.plans.schema_plan import ColumnType, TableState, blocker
from keyloom.plans.spec import TableSpec
from keyloom.sources import inventory, log_text
from keyloom.session import work_path
from keyloom.streaming.apply_stream import VersionedTarget, apply_batch, run_available, stream_log

SPEC = TableSpec("t", ("a", "b"), ("a", "b", "v"))
SCHEMA = "a int, b string, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_diff_then_apply_gives_source(spark):
    rng = random.Random(1)
    keys = [(a, b) for a in range(12) for b in "xyz"]
    for _ in range(3):
        side = lambda: [(*k, rng.choice([None, "", "1", "2"])) for k in keys if rng.random() < 0.7]
        s, t = side(), side()
        source, target = frame(spark, s), frame(spark, t)
        assert got(apply.apply_changes(target, diff.changes(source, target, SPEC), SPEC)) == sorted(s, key=str)
        kinds = {(r["a"], r["b"]): r["kind"] for r in diff.compare(source, target, SPEC).collect()}
        sd, td = {r[:2]: r[2] for r in s}, {r[:2]: r[2] for r in t}
        for k in set(sd) | set(td):
            want = "missing_source" if k not in sd else "missing_target" if k not in td else "equal" if sd[k] == td[k] else "value_mismatch"
            assert kinds[k] == want


def test_empty_sides(spark):
    none, some = frame(spark, []), frame(spark, [(1, "x", None)])
    assert diff.compare(none, none, SPEC).count() == 0
    assert [r["kind"] for r in diff.compare(some, none, SPEC).collect()] == ["missing_target"]
    assert got(apply.apply_changes(none, diff.changes(some, none, SPEC), SPEC)) == [(1, "x", None)]


def fold(target, log):
    """The log applied one by one."""
    state = {r[:2]: r for r in target}
    for op, before, after in log:
        if op == "D":
            state.pop(before[:2], None)
        elif op == "I":
            state.setdefault(after[:2], after)
        elif before != after:
            if before[:2] != after[:2]:
                state.pop(before[:2], None)
                state.setdefault(after[:2], after)
            elif after[:2] in state:
                state[after[:2]] = after
    return sorted(state.values(), key=str)


def log_frame(spark, log, start=0):
    image = f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>"
    rows = [((1, start + i), op, b, a) for i, (op, b, a) in enumerate(log)]
    return spark.createDataFrame(rows, f"coord struct<file:bigint,pos:bigint>, op string, before {image}, after {image}")


def random_log(rng, n):
    key = lambda: (rng.randrange(3), rng.choice("xy"))
    out = []
    for _ in range(n):
        op, k, m = rng.choice("IUUUD"), key(), key()
        row = lambda q: (*q, rng.choice([None, "1", "2", "3"]))
        out.append((op, None if op == "I" else row(k), None if op == "D" else row(m if rng.random() < 0.3 else k)))
    return out


def test_apply_log_equals_one_by_one_and_any_split(spark):
    rng = random.Random(7)
    for _ in range(4):
        target = [(0, "x", "old"), (1, "y", None)]
        log = random_log(rng, 25)
        want = fold(target, log)
        assert got(apply.apply_log(frame(spark, target), log_frame(spark, log), SPEC)) == want
        cut = rng.randrange(25)
        first = apply.apply_log(frame(spark, target), log_frame(spark, log[:cut]), SPEC)
        assert got(apply.apply_log(first, log_frame(spark, log[cut:], cut), SPEC)) == want


def test_duplicate_insert_can_be_an_error(spark):
    target, log = frame(spark, [(1, "x", "old")]), log_frame(spark, [("I", None, (1, "x", "new"))])
    assert got(apply.apply_log(target, log, SPEC)) == [(1, "x", "old")]
    with pytest.raises(Exception, match="duplicate insert"):
        apply.apply_log(target, log, SPEC, "error").collect()


def test_keyset_windows_partition_the_table(spark):
    rows = [(a, b, None) for a in range(5) for b in "xyz"]
    spec = TableSpec("t", ("b", "a"), ("a", "b", "v"), labels={"b": ("z", "x", "y")})
    df, seen, at = frame(spark, rows), [], None
    while page := keyset.window(df, spec, at, None, 4).collect():
        seen += [(r["b"], r["a"]) for r in page]
        at = seen[-1]
    assert seen == sorted([(b, a) for a, b, _ in rows], key=lambda k: ("zxy".index(k[0]), k[1]))
    chunks = {(r["b"], r["a"]): r["chunk"] for r in keyset.chunk_numbers(df, spec, 4).collect()}
    assert [chunks[k] for k in seen] == [i // 4 + 1 for i in range(15)]
    with pytest.raises(ValueError):
        keyset.after(spec, ["x"])
    assert keyset.chunk_numbers(df.limit(0), spec, 4).count() == 0


def test_bounds_reach_the_scan(spark):
    df = keyset.window(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"), TableSpec("c", ("conv_id", "turn"), ("conv_id", "turn")), [3, 1], [9, 2])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThan(conv_id,3)" in plan


def test_checksum_ignores_order_and_tells_nulls(spark):
    of = lambda rows: frame(spark, rows).agg(checksum(row_text(frame(spark, rows), ["a", "b", "v"]))).first()[0]
    rows = [(i, "é" * i, None if i % 2 else "") for i in range(6)]
    assert of(rows) == of(rows[::-1]) and of([]) == 0
    assert of([(1, "x", None)]) != of([(1, "x", "")]) != of([(1, "x", "N")])
    with pytest.raises(ValueError):
        row_text(spark.range(1).select(F.lit(1.5).alias("f")), ["f"])


def test_identity_frames_fields(spark):
    one = lambda *x: spark.range(1).select(identity(*map(F.lit, x))).first()[0]
    assert one("ab", "c") != one("a", "bc") and len(one("")) == 64


def test_labels_and_bits(spark):
    assert scalars.parse_labels("ENUM('a','b''c','d\\'e')") == ["a", "b'c", "d'e"]
    assert scalars.parse_labels("set('x')", "set") == ["x"] and scalars.parse_labels("int") is None
    assert scalars.fnv1a(b"a") == 0xE40C292C
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(scalars.enum_label(F.lit(4), ["a"])).collect()


def test_graph():
    out, rest = graph.levels("abcd", [("a", "b"), ("b", "c"), ("c", "c"), ("d", "x")])
    assert out == {"c": 0, "d": 0, "b": 1, "a": 2} and rest == []
    assert graph.levels("ab", [("a", "b"), ("b", "a")])[1] == ["a", "b"]
    with pytest.raises(ValueError, match="cyclic"):
        graph.require_acyclic("ab", [("a", "b"), ("b", "a")])


def test_repair_depth(spark):
    with pytest.raises(ValueError):
        integrity.nested_repair(frame(spark, []), [()] * 9)


def test_stages_resume_and_stop():
    done = []
    steps = {s: lambda t, s=s: done.append((s, t)) for s in control.STAGES}
    state = control.run_stages(["b", "a"], steps, {("rows", "a"): "complete"})
    assert ("rows", "a") not in done and done[0] == ("prerequisite_schema", "a") and set(state.values()) == {"complete"}
    with pytest.raises(RuntimeError):
        control.run_stages(["a"], steps, {("rows", "a"): "error"})


def test_cutover_resumes_writes():
    calls = []
    run = lambda lag, ok: control.run_cutover(lambda: calls.append("stop"), lambda: lag, lambda: ok, lambda: calls.append("switch"), lambda: calls.append("resume"), 5)
    assert run(0, True)["passed"] and calls == ["stop", "switch", "resume"]
    assert run(3, True) == {"switched": True, "lag": 3, "validated": True, "passed": False}
    assert not run(9, True)["switched"] and calls[-1] == "resume"


def test_table_state():
    t = TableState((("id", "int"), ("a", "int")), (("i", ("a",)),))
    with pytest.raises(ValueError):
        t.rename_column("a", "id")
    with pytest.raises(ValueError, match="supports"):
        t.drop_index("i", (("a",),))
    assert t.drop_column("A").indexes == () and t.drop_column("x", if_exists=True) is t


@pytest.mark.parametrize("source,target,bad", [("tinyint", "int", [200, -129]), ("tinyint unsigned", "int", [256, -1]), ("int", "bigint", [3_000_000_000])])
def test_integer_blockers(spark, source, target, bad):
    df = spark.createDataFrame([(x,) for x in [*bad, 0, 5, None]], "v long")
    assert sorted(r[0] for r in df.where(blocker(ColumnType("v", source), ColumnType("v", target))).collect()) == sorted(bad)


def test_stream_replays_once(spark):
    rng = random.Random(3)
    log = random_log(rng, 30)
    source, at = work_path(spark, "log"), work_path(spark, "target")
    for i in range(3):
        log_frame(spark, log[i * 10 : i * 10 + 10], i * 10).coalesce(1).write.mode("append").parquet(source)
    schema = log_frame(spark, []).schema
    target = VersionedTarget(spark, at)
    target.commit(frame(spark, [(0, "x", "old")]), -1, None)
    run_available(stream_log(spark, source, schema), target, SPEC, f"{at}-checkpoint")
    want = fold([(0, "x", "old")], log)
    assert got(target.read()) == want and target.head()["version"] == 3
    apply_batch(target, SPEC)(spark.read.schema(schema).parquet(source), 2)  # a batch that is delivered again
    assert target.head()["version"] == 3
    apply_batch(target, SPEC)(spark.read.schema(schema).parquet(source), 9)  # the whole log again, as another batch
    assert got(target.read()) == want
    target.lease("one")
    with pytest.raises(RuntimeError):
        target.lease("two")


def grouped_frame(spark, log, closing, turning):
    pos = F.col("coord.pos")
    return log_frame(spark, log).withColumns({"file": F.lit("log.000001"), "pos": pos, "closes": pos.isin(closing), "rotates": pos.isin(turning)})


def test_stream_applies_whole_groups(spark):
    log = random_log(random.Random(5), 30)
    df = grouped_frame(spark, log, [3, 6, 12, 20, 25], [10])
    cut = lambda rows, size: rows.agg(F.max("coord")).first()[0] and changelog.group_cut(rows, "closes", "rotates", size).first()["cut"]
    assert [cut(df, n)["pos"] for n in (1, 2, 3, 4)] == [25, 20, 25, 10]
    assert cut(df.where("pos < 3"), 1) is None
    target = VersionedTarget(spark, work_path(spark, "target"))
    target.commit(frame(spark, [(0, "x", "old")]), -1, None)
    part = lambda lo, hi: df.where((F.col("pos") >= lo) & (F.col("pos") < hi))
    after = []
    for n, (lo, hi) in enumerate(((0, 2), (2, 8), (8, 14), (14, 30))):
        apply_batch(target, SPEC, group=2)(part(lo, hi), n)
        after.append(got(target.read()))
    want = lambda n: fold([(0, "x", "old")], log[:n])
    assert after == [want(0), want(7), want(11), want(21)] and target.pending().count() == 9


def test_stream_that_fails_before_its_commit(spark, monkeypatch):
    log = random_log(random.Random(6), 20)
    df = grouped_frame(spark, log, [9], [])
    target = VersionedTarget(spark, work_path(spark, "target"))
    target.commit(frame(spark, []), -1, None)
    commit = VersionedTarget.commit

    def torn(self, rows, *more):
        rows.write.mode("overwrite").parquet(f"{self.path}/v={self.head()['version'] + 1}")
        raise OSError("lost")

    monkeypatch.setattr(VersionedTarget, "commit", torn)
    with pytest.raises(OSError):
        apply_batch(target, SPEC, group=1)(df, 0)
    monkeypatch.setattr(VersionedTarget, "commit", commit)
    assert target.head()["version"] == 0 and got(target.read()) == []
    apply_batch(target, SPEC, group=1)(df, 0)
    assert got(target.read()) == fold([], log[:10]) and target.pending().count() == 10


def test_stream_stops_before_a_barrier(spark):
    log = random_log(random.Random(7), 20)
    df = log_frame(spark, log)
    at = df.orderBy("coord").select("coord").collect()[12]["coord"]
    target = VersionedTarget(spark, work_path(spark, "target"))
    target.commit(frame(spark, []), -1, None)
    standing = df.where((F.col("coord.file") == at["file"]) & (F.col("coord.pos") == at["pos"])).select("coord")
    apply_batch(target, SPEC, barriers=lambda: standing)(df, 0)
    assert got(target.read()) == fold([], log[:12])
    apply_batch(target, SPEC, barriers=lambda: standing.limit(0))(df.limit(0), 1)
    assert got(target.read()) == fold([], log) and target.pending().count() == 0


def test_bounded_stop_in_a_later_file(spark):
    rows = [(f, p, p - 10, "commit" if p == 30 else "rows") for f in ("log.1", "log.2") for p in (10, 20, 30)]
    log = spark.createDataFrame(rows, "file string, pos long, start_pos long, event_type string")
    got = {s: tuple(changelog.bounded_stop(log, s[1], s[0]).first()) for s in ((1, 15), (2, 30), (2, 20), (2, 15), (3, 5))}
    assert got == {(1, 15): (1, "inside_event"), (2, 30): (6, "reached"), (2, 20): (5, "inside_transaction"), (2, 15): (4, "inside_event"), (3, 5): (6, "not_reached")}


# --- resumable sync ------------------------------------------------------------------------------------


def test_interrupted_sync_goes_on_and_converges(spark):
    rng = random.Random(3)
    side = lambda: [(a, b, rng.choice([None, "1", "2"])) for a in range(14) for b in "xyz" if rng.random() < 0.7]
    s, t = side(), [*side(), (99, "z", "tail")]
    source, target, path = frame(spark, s), frame(spark, t), work_path(spark, "sync")
    run = sync.SyncRun(spark, path, SPEC, 4)
    assert run.step(source, target)["status"] == "running"
    # A step that wrote its changes but not its record is done anew.
    frame(spark, [(1, "x", "junk")]).write.parquet(f"{path}/changes/1")
    again = sync.SyncRun(spark, path, SPEC, 4)
    assert again.progress().count() == 1 and again.step(source, target)["step"] == 1
    again.run(source, target, windows=3)
    assert got(again.result(target)) == sorted(s, key=str) and again.step(source, target) is None
    p = again.progress().collect()
    assert sum(r["rows_scanned"] for r in p) == len(s) and sum(r["windows"] for r in p) == -(-len(s) // 4) and [r["status"] for r in p][-1] == "complete"
    with pytest.raises(ValueError, match="other settings"):
        sync.SyncRun(spark, path, SPEC, 5).start(source)


def test_sync_of_empty_sides(spark):
    none, some = frame(spark, []), frame(spark, [(1, "x", "v")])
    for source, target in ((none, some), (some, none), (none, none)):
        run = sync.SyncRun(spark, work_path(spark, "sync"), SPEC, 2)
        run.run(source, target)
        assert got(run.result(target)) == got(source)
    with pytest.raises(ValueError):
        sync.SyncRun(spark, work_path(spark, "sync"), SPEC, 0)


def test_tail_of_a_composite_key_and_of_nothing(spark):
    target = frame(spark, [(1, "a", None), (2, "a", None), (2, "b", None), (3, "a", None)])
    assert got(keyset.tail(target, frame(spark, [(2, "a", None)]), SPEC)) == [(2, "b", None), (3, "a", None)]
    assert keyset.tail(target, frame(spark, []), SPEC).count() == 4


def test_partial_images_fail(spark):
    log = spark.createDataFrame([(1, [True, True]), (2, [True, False]), (3, None)], "i int, present array<boolean>")
    full, partial = apply.split_full_images(log)
    assert [r["i"] for r in apply.require_full_images(full).collect()] == [1] and sorted(r["i"] for r in partial.collect()) == [2, 3]
    with pytest.raises(Exception, match="lacks columns"):
        apply.require_full_images(log).collect()


def test_log_lines_are_numbered_by_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# at 4\n### INSERT INTO x\n")
    rows = log_text.events(log_text.read_lines(spark, str(tmp_path)), "log.000001").collect()
    assert [(r["n"], r["class"], r["file"], r["pos"]) for r in rows] == [(1, "rows_insert", "log.000001", 4)]


def test_index_behind_a_reference():
    assert graph.index_supports_reference(("a", "b"), [("a",)]) and not graph.index_supports_reference(("b", "a"), [("a",), ("b", "c")])


# --- statements ----------------------------------------------------------------------------------------


def test_definitions_and_statements(spark):
    rows = [
        ("t", 1, "id", "int", "int", False, None, None, None, "auto_increment", None),
        ("t", 2, "a`b", "varchar(9)", "varchar", False, "utf8mb4", "utf8mb4_bin", "", "", None),
        ("t", 3, "c", "enum('x')", "enum", True, None, None, "it's", "", None),
        ("t", 4, "at", "datetime", "datetime", True, None, None, "CURRENT_TIMESTAMP", "DEFAULT_GENERATED on update CURRENT_TIMESTAMP", None),
        ("t", 5, "g", "int", "int", True, None, None, None, "STORED GENERATED", "`id`*2"),
    ]
    source = inventory.frame(spark, rows, inventory.COLUMNS)
    keys = inventory.frame(spark, [("t", 2, "a`b"), ("t", 1, "id")], inventory.KEYS)
    (made,) = render.column_statements(source, source.limit(0), keys).collect()
    assert made["statement"] == (
        "CREATE TABLE `t` (`id` int NOT NULL AUTO_INCREMENT, `a``b` varchar(9) CHARACTER SET utf8mb4 COLLATE utf8mb4_bin NOT NULL DEFAULT '', `c` enum('x') NULL DEFAULT 'it''s', "
        "`at` datetime NULL DEFAULT CURRENT_TIMESTAMP ON UPDATE CURRENT_TIMESTAMP, `g` int GENERATED ALWAYS AS (`id`*2) STORED NULL, PRIMARY KEY (`id`, `a``b`))"
    )
    target = inventory.frame(spark, [*rows[1:3], ("t", 6, "z", "int", "int", True, None, None, None, "", None), ("own", 1, "id", "int", "int", True, None, None, None, "", None)], inventory.COLUMNS)
    got_ = {r["object"]: (r["statement"], r["needs"]) for r in render.column_statements(source.where("column_name <> 'at'"), target, keys).collect()}
    assert got_ == {
        "column:t.id": ("ALTER TABLE `t` ADD COLUMN `id` int NOT NULL AUTO_INCREMENT FIRST", []),
        "column:t.g": ("ALTER TABLE `t` ADD COLUMN `g` int GENERATED ALWAYS AS (`id`*2) STORED NULL AFTER `c`", ["column:t.c"]),
        "column:t.z": ("ALTER TABLE `t` DROP COLUMN `z`", []),
    }
    assert render.column_statements(source, source, keys).count() == 0


def test_index_and_reference_statements(spark):
    index = spark.createDataFrame([("t", "create", "i", True, [("a", None), ("b", 5)]), ("t", "drop", "j", False, [("a", None)])], "table_name string, action string, index_name string, is_unique boolean, columns array<struct<column_name:string,prefix_length:int>>")
    refs = spark.createDataFrame([("t", "create", "f", ["a", "b"], "p", ["x", "y"], "CASCADE", "RESTRICT"), ("t", "drop", "g", ["a"], "p", ["x"], "RESTRICT", "RESTRICT")], "table_name string, action string, constraint_name string, child_columns array<string>, parent_table string, parent_columns array<string>, update_rule string, delete_rule string")
    rows = render.statements(render.index_statements(index), render.reference_statements(refs)).orderBy("place").collect()
    assert [(r["phase"], r["statement"], r["needs"]) for r in rows] == [
        (0, "ALTER TABLE `t` DROP FOREIGN KEY `g`", []),
        (3, "ALTER TABLE `t` ADD UNIQUE INDEX `i` (`a`, `b`(5))", ["column:t.a", "column:t.b"]),
        (3, "ALTER TABLE `t` DROP INDEX `j`", []),
        (4, "ALTER TABLE `t` ADD CONSTRAINT `f` FOREIGN KEY (`a`, `b`) REFERENCES `p` (`x`, `y`) ON UPDATE CASCADE ON DELETE RESTRICT", ["table:p"]),
    ]
