"""Structured Streaming apply of a change log to a versioned target, exactly once.

A target is rows in buckets by the hash of their key, in folders of unique names under `data`, and commit
records `commits/N`: batch, last coordinate applied, and the folder of each bucket. Only a record makes
rows part of the target, and it is created or refused, never replaced (keyloom.records), so a writer that
comes second leaves nothing but a folder that no record names. A batch rewrites the buckets that its keys
are in and takes over the others. A batch that is replayed after a crash finds its commit and does nothing;
one that failed before its commit is applied anew. Rows at or before the committed coordinate are dropped,
so splitting the log otherwise gives the same target.

With flags for the ends of transactions, a batch is applied up to the last whole group of transactions.
What lies behind it, the open transaction first of all, waits in a folder that the same record names, and
comes before the next batch. Nothing at or behind a barrier is applied while it stands.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.operators import changelog
from keyloom.operators.apply import apply_log
from keyloom.plans.spec import TableSpec
from keyloom.records import Lease, Records, Taken  # noqa: F401

#: Buckets of a new target. More of them make a batch rewrite less, and files smaller.
BUCKETS = 16


class VersionedTarget:
    """key: the columns whose hash deals rows to buckets; none: the whole target is one bucket."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), tuple(key)
        self.buckets = buckets if key else 1
        self.records = Records(spark, self.path)

    def head(self) -> dict | None:
        """The newest commit record."""
        found = self.records.numbers("commits")
        return self.records.read(f"commits/{found[-1]}") if found else None

    def bucket(self, key: Column | None = None) -> Column:
        """Number of the bucket of a row, or of a struct with its key."""
        if not self.key:
            return F.lit(0)
        return F.pmod(F.xxhash64(*[key[c] if key is not None else F.col(c) for c in self.key]), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), or only those of some buckets."""
        record = self.head() if version is None else self.records.read(f"commits/{version}")
        paths = [f"{self.path}/{p}" for b, p in enumerate(record["parts"]) if p and (buckets is None or b in buckets)]
        schema = StructType.fromJson(record["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def pending(self) -> DataFrame | None:
        """Log rows that wait behind the newest version."""
        head = self.head()
        return self.spark.read.parquet(f"{self.path}/{head['pending']}") if head and head["pending"] else None

    def commit(self, df: DataFrame, batch: int, coordinate: list | None, pending: DataFrame | None = None, buckets: list[int] | None = None, counts: dict[str, int] | None = None) -> None:
        """Publish df as the next version, or as the next content of some buckets, and rows that wait; counts add to the totals.

        If another writer publishes that version first, Taken is raised and its rows stay.
        """
        head = self.head()
        version = head["version"] + 1 if head else 0
        parts = list(head["parts"]) if head and buckets is not None else [None] * self.buckets
        if head and len(head["parts"]) != self.buckets:
            raise ValueError(f"{self.path} has {len(head['parts'])} buckets")
        at = f"data/{uuid.uuid4().hex}"
        dealt = df.withColumn("_bucket", self.bucket())
        dealt = dealt.repartition("_bucket") if self.key else dealt
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{at}")
        written = {n.removeprefix("_bucket=") for n in self.records.names(at) if n.startswith("_bucket=")}
        for b in range(self.buckets) if buckets is None else buckets:
            parts[b] = f"{at}/_bucket={b}" if str(b) in written else None
        waits = None
        if pending is not None:
            waits = f"data/{uuid.uuid4().hex}"
            pending.write.parquet(f"{self.path}/{waits}")
        totals = dict(head["totals"]) if head else {}
        for name, n in (counts or {}).items():
            totals[name] = totals.get(name, 0) + n
        record = {"version": version, "totals": totals, "batch": batch, "coordinate": coordinate, "pending": waits, "parts": parts, "schema": df.schema.jsonValue()}
        self.records.create(f"commits/{version}", record)

    def expire(self, keep: int = 2) -> None:
        """Delete all records but the last `keep`, and folders that none of those names. Only for the holder of the lease."""
        found = self.records.numbers("commits")
        for old in found[:-keep]:
            self.records.delete(f"commits/{old}")
        kept = [self.records.read(f"commits/{n}") for n in found[-keep:]]
        used = {p.split("/")[1] for r in kept for p in [*r["parts"], r["pending"]] if p}
        for name in self.records.names("data"):
            if name not in used:
                self.records.delete(f"data/{name}")

    def lease(self, owner: str, seconds: float = 600.0) -> Lease:
        """Take the right to write, or renew it; Taken if another owner has it."""
        held = Lease(self.records, owner, seconds)
        held.take()
        return held


class Progress:
    """Reports a stream's totals once so many rows have been applied or so many seconds have passed since the last report."""

    def __init__(self, report: Callable[[dict], None], rows: int = 10_000, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.report, self.rows, self.seconds, self.clock = report, rows, seconds, clock
        self._rows, self._at = 0, clock()

    def saw(self, applied: int, totals: dict) -> None:
        self._rows += applied
        if self._rows >= self.rows or self.clock() - self._at >= self.seconds:
            self.report(totals)
            self._rows, self._at = 0, self.clock()


def apply_batch(target: VersionedTarget, spec: TableSpec, on_duplicate: str = "ignore", hold_open: bool = True, group: int | None = None, barriers=None, lease: Lease | None = None, keep: int | None = None, progress: Progress | None = None):
    """The foreachBatch function. Batches have coord, op, before, after, and with group file and pos.

    With hold_open also `closed`: rows of a transaction whose commit hasn't come yet have closed = false and
    must not be there. With group, batches have the flags `closes` and `rotates` too and are applied in whole
    groups of so many transactions, or up to a rotation. barriers() gives the coordinates (coord) of standing
    barriers: only what lies before the first of them is applied. A lease is renewed before each commit; with
    keep, so many versions stay. Rows applied, by operation, are counted in the pass that finds the buckets; the totals are in
    the commit record, so a replayed batch counts once, and progress hears of them.
    """
    if group is not None and group < 1:
        raise ValueError("a group has a transaction or more")

    def run(batch: DataFrame, batch_id: int) -> None:
        head = target.head()
        if head and head["batch"] >= batch_id:
            return
        rows = batch
        if head and head["coordinate"]:
            file, pos = head["coordinate"]
            rows = rows.where((F.col("coord.file") > file) | ((F.col("coord.file") == file) & (F.col("coord.pos") > pos)))
        if hold_open and "closed" in rows.columns and not rows.where("not closed").isEmpty():
            raise RuntimeError("the batch cuts a transaction")
        if (waiting := target.pending()) is not None:
            rows = waiting.unionByName(rows).dropDuplicates(["coord"])  # a replayed row waits already
        held = None
        if barriers is not None:
            first = F.broadcast(barriers().agg(F.min("coord").alias("_barrier")))
            rows = rows.join(first)
            held = rows.where(F.col("coord") >= F.col("_barrier")).drop("_barrier")
            rows = rows.where(F.col("_barrier").isNull() | (F.col("coord") < F.col("_barrier"))).drop("_barrier")
        if group is not None:
            marked = rows.join(F.broadcast(changelog.group_cut(rows, "closes", "rotates", group)))
            behind = marked.where(F.col("cut").isNull() | (F.col("coord") > F.col("cut"))).drop("cut")
            held = behind if held is None else held.unionByName(behind)
            rows = marked.where(F.col("coord") <= F.col("cut")).drop("cut")
        last = rows.agg(F.max("coord").alias("c")).first()["c"]
        coordinate = [last["file"], last["pos"]] if last else (head or {}).get("coordinate")
        log = rows.select("coord", "op", "before", "after")
        # One pass finds the buckets that the images are in and counts what is applied: a row, with a number a bucket.
        spots = [F.collect_set(F.when(F.col(i).isNotNull(), target.bucket(F.col(i)))).alias(i) for i in ("before", "after")]
        seen = log.agg(*spots, F.count("*").alias("applied"), *[F.count_if(F.col("op") == op).alias(n) for op, n in (("I", "inserts"), ("U", "updates"), ("D", "deletes"))]).first().asDict()
        touched = sorted({*seen.pop("before"), *seen.pop("after")})
        counts = seen
        if lease is not None:
            lease.take()
        target.commit(apply_log(target.read(buckets=touched), log, spec, on_duplicate), batch_id, coordinate, held, touched, counts)
        if progress is not None:
            progress.saw(counts["applied"], target.head()["totals"])
        if keep is not None:
            target.expire(keep)

    return run


def stream_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A log of Parquet files as a stream; the files of a trigger bound what is read ahead."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(log: DataFrame, target: VersionedTarget, spec: TableSpec, checkpoint: str, on_duplicate: str = "ignore", keep: int | None = 2, **options) -> None:
    """Apply all of the log that is there, batch by batch, and stop; under the target's lease. Options are those of apply_batch."""
    lease = target.lease(f"run-{uuid.uuid4().hex}")
    try:
        query = log.writeStream.foreachBatch(apply_batch(target, spec, on_duplicate, lease=lease, keep=keep, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        lease.give_up()
