"""Decoded logs in splits, footers, stream totals."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.sources import log_text, runtime
from keyloom.session import work_path
from keyloom.streaming.apply_stream import Progress, VersionedTarget, apply_batch
from test_operators import SPEC, frame, log_frame, random_log


@pytest.fixture
def split(spark):
    """Sets the size of splits, and resets it."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (str(size), "1", "1"))]
    for n in names:
        spark.conf.unset(n)


def sample(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice([f"# at {i * 7}", f"#250101 Rotate to log.{i:06d}  pos: 4", "### UPDATE `a`.`b`", "", "# comment", "insert into a values (1,", f"  {i}) ;", "x" * rng.randrange(60), "COMMIT;", "ü😀 " * 3]))
    return out


@pytest.mark.parametrize(("size", "end"), [(40, "\n"), (333, "\r\n"), (1 << 20, "\n")])
def test_splits_equal_the_whole(spark, split, tmp_path, size, end):
    rng = random.Random(size)
    texts = [sample(rng, 150), sample(rng, 90), []]
    for i, lines in enumerate(texts):
        (tmp_path / f"log{i}.txt").write_bytes("".join(x + end for x in lines).encode())
    split(size)
    lines = log_text.split_lines(spark, f"file://{tmp_path}")
    if size == 40:
        assert lines.select("source", "block").distinct().count() > 50
    whole = spark.createDataFrame([(str(i), n, x) for i, t in enumerate(texts) for n, x in enumerate(t)], "source string, n int, line string")
    name = F.regexp_extract("source", r"log(\d)\.txt$", 1)
    got = sorted(((r["s"], r["block"], r["n"], r["line"], r["class"], r["file"], r["pos"]) for r in log_text.split_classified(lines, "first").withColumn("s", name).collect()))
    want = sorted((r["source"], r["n"], r["line"], r["class"], r["file"], r["pos"]) for r in log_text.classified(whole, "first").collect())
    assert [(g[0], *g[3:]) for g in got] == [(w[0], *w[2:]) for w in want]
    statements = lambda df, s: sorted(tuple(r) for r in df.select(s, "statement", "file", "pos", "sql").collect())
    assert statements(log_text.split_statements(lines, "first"), name) == statements(log_text.statements(whole, "first"), "source")


def test_footers_answer_without_a_scan(spark):
    path = work_path(spark, "table")
    spark.range(5, 1000).repartition(3).write.parquet(path)
    empty = work_path(spark, "empty")
    spark.range(0).write.parquet(empty)
    got = {r["table_name"]: tuple(r)[1:4] for r in runtime.table_runtime(spark, {"t": (path, "id"), "e": (empty, "id")}).collect()}
    assert got == {"t": (995, "5", "999"), "e": (0, None, None)}
    assert runtime.table_runtime(spark, {}).count() == 0 and runtime.table_runtime(spark, {"t": (path, "id")}).first()["bytes"] > 0
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    for k, v in runtime._PUSHED.items():
        spark.conf.set(k, v)
    try:
        plan = runtime.footer_plan(spark, "t", path, "id")._jdf.queryExecution().toString()
    finally:
        for k in runtime._PUSHED:
            spark.conf.unset(k)
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id)]" in plan


def test_totals_count_a_batch_once_and_reports_are_throttled(spark):
    log = random_log(random.Random(11), 30)
    target = VersionedTarget(spark, work_path(spark, "target"), SPEC.key, 4)
    target.commit(frame(spark, []), -1, None)
    now, told = [0.0], []
    progress = Progress(told.append, rows=15, seconds=100, clock=lambda: now[0])
    run = apply_batch(target, SPEC, progress=progress)
    for n in (0, 1, 1, 2):
        run(log_frame(spark, log[n * 10 : n * 10 + 10], n * 10), n)
    ops = [op for op, _, _ in log]
    want = {"applied": 30, "inserts": ops.count("I"), "updates": ops.count("U"), "deletes": ops.count("D")}
    assert target.head()["totals"] == want and [t["applied"] for t in told] == [20]
    now[0] = 101.0
    run(log_frame(spark, [], 40), 3)
    assert [t["applied"] for t in told] == [20, 30] and target.head()["totals"] == want
