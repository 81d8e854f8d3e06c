"""Commits, steps and leases with more than one writer."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import sync
from keyloom.records import Lease, Records, Taken
from keyloom.session import work_path
from keyloom.streaming.apply_stream import VersionedTarget, apply_batch, run_available, stream_log
from test_operators import SPEC, fold, frame, got, log_frame, random_log


def rows_of(n, value):
    return [(i, "x", value) for i in range(n)]


@pytest.mark.parametrize("key", [(), SPEC.key])
def test_a_refused_commit_leaves_the_head(spark, monkeypatch, key):
    at = work_path(spark, "target")
    one, two = VersionedTarget(spark, at, key), VersionedTarget(spark, at, key)
    one.commit(frame(spark, rows_of(2, "base")), -1, None)
    seen = two.head()
    one.commit(frame(spark, rows_of(5, "one")), 0, None, frame(spark, rows_of(1, "waits")))
    monkeypatch.setattr(two, "head", lambda: seen)
    with pytest.raises(Taken):
        two.commit(frame(spark, rows_of(7, "two")), 0, None, frame(spark, rows_of(3, "waits")))
    assert got(one.read()) == rows_of(5, "one") and one.pending().count() == 1 and one.head()["version"] == 1
    assert got(one.read(0)) == rows_of(2, "base")


def test_a_batch_rewrites_only_its_buckets(spark):
    target = VersionedTarget(spark, work_path(spark, "target"), SPEC.key, 8)
    base = [(i, "x", "old") for i in range(60)]
    target.commit(frame(spark, base), -1, None)
    before = target.head()["parts"]
    log = [("U", (7, "x", "old"), (7, "x", "new"))]
    apply_batch(target, SPEC)(log_frame(spark, log), 0)
    after = target.head()["parts"]
    assert sum(a != b for a, b in zip(before, after)) == 1 and got(target.read()) == fold(base, log)
    everything = [("D", (i, "x", "old"), None) for i in range(60)]
    apply_batch(target, SPEC)(log_frame(spark, everything, 1), 1)
    assert target.head()["parts"] == [None] * 8 and target.read().count() == 0
    with pytest.raises(ValueError, match="8 buckets"):
        VersionedTarget(spark, target.path, SPEC.key, 4).commit(frame(spark, base), 5, None)


def test_old_versions_and_abandoned_folders_go(spark):
    log = random_log(random.Random(8), 30)
    source, at = work_path(spark, "log"), work_path(spark, "target")
    for i in range(3):
        log_frame(spark, log[i * 10 : i * 10 + 10], i * 10).coalesce(1).write.mode("append").parquet(source)
    target = VersionedTarget(spark, at, SPEC.key, 4)
    target.commit(frame(spark, []), -1, None)
    frame(spark, rows_of(1, "lost")).write.parquet(f"{at}/data/abandoned")
    run_available(stream_log(spark, source, log_frame(spark, []).schema), target, SPEC, f"{at}-checkpoint")
    assert target.records.numbers("commits") == [2, 3] and "abandoned" not in target.records.names("data")
    assert got(target.read()) == fold([], log)


def test_a_stream_needs_the_lease(spark):
    source, at = work_path(spark, "log"), work_path(spark, "target")
    log_frame(spark, random_log(random.Random(9), 5)).coalesce(1).write.parquet(source)
    target = VersionedTarget(spark, at, SPEC.key)
    target.commit(frame(spark, []), -1, None)
    held = target.lease("another")
    stream = lambda: run_available(stream_log(spark, source, log_frame(spark, []).schema), target, SPEC, f"{at}-checkpoint")
    with pytest.raises(Taken):
        stream()
    held.give_up()
    stream()
    assert target.head()["batch"] == 0


def test_leases_end_and_can_be_renewed(spark):
    records = Records(spark, work_path(spark, "records"))
    one, two = Lease(records, "one", 100), Lease(records, "two", 100)
    one.take()
    one.take()
    with pytest.raises(Taken):
        two.take()
    Lease(records, "one", -1).take()  # its time is over
    two.take()
    with pytest.raises(Taken):
        one.take()
    one.give_up()  # not its own any more
    with pytest.raises(Taken):
        one.take()
    two.give_up()
    one.take()
    assert len(records.numbers("leases")) <= 2


def test_records_are_never_replaced(spark):
    records = Records(spark, work_path(spark, "records"))
    records.create("a/1", {"n": 1})
    with pytest.raises(Taken):
        records.create("a/1", {"n": 2})
    assert records.read("a/1") == {"n": 1} and records.names("a") == ["1"] and records.read("a/2") is None


def test_a_second_worker_of_a_step_is_refused(spark, monkeypatch):
    source, target, path = frame(spark, rows_of(9, "s")), frame(spark, rows_of(4, "t")), work_path(spark, "sync")
    one, two = (sync.SyncRun(spark, path, SPEC, 3) for _ in range(2))
    one.step(source, target)
    monkeypatch.setattr(two, "_steps", lambda: [])
    with pytest.raises(Taken):
        two.step(frame(spark, rows_of(9, "other")), target)
    monkeypatch.undo()
    assert two.failure() is None
    two.run(source, target)
    assert got(one.result(target)) == rows_of(9, "s")
    Lease(one.records, "somebody").take()
    with pytest.raises(Taken):
        one.step(source, target)


def test_a_failed_run_is_refused_until_it_is_cleared(spark):
    source, target = frame(spark, rows_of(6, "s")), frame(spark, rows_of(2, "t"))
    run = sync.SyncRun(spark, work_path(spark, "sync"), SPEC, 3)
    run.step(source, target)
    bad = source.withColumn("v", F.raise_error(F.lit("gone")).cast("string"))
    with pytest.raises(Exception, match="gone"):
        run.step(bad, target)
    again = sync.SyncRun(spark, run.path, SPEC, 3)
    with pytest.raises(RuntimeError, match="failed"):
        again.step(source, target)
    again.retry()
    again.run(source, target)
    assert got(again.result(target)) == rows_of(6, "s")
