"""Resumable sync of a target to its source, window by window, with durable progress.

A run is a folder that driver and executors share:

* `data/…`   Parquet under unique names: number, rows and last key of each window of the source's key order,
  found in one pass, and the row changes of each step;
* `spec`     the run's settings and where its windows are, created once; a run that is opened with other
  settings is refused;
* `steps/N`  the step's record, created once, which says where its changes are;
* `failed/N` why a step failed. A run with such a record is refused until it is cleared (retry).

Records are created or refused, never replaced (keyloom.records), and a run is worked on under a lease, so
a second worker neither changes nor repeats what is published.

A step counts once its record is there. One that was interrupted before that is done anew, and a run that is opened
again goes on behind its last record. run() does steps in waves: one comparison for all steps of a wave, each wave
four times as long as the one before, and then their records one by one. A step compares the source and target rows between two keys, which
both scans take as pushed filters; the last one reaches beyond the source's last key, so that rows that
only the target has go too. Keys are never null.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import apply, diff, keyset
from keyloom.plans.spec import TableSpec
from keyloom.records import Lease, Records, Taken

#: Most steps of a wave.
WAVE = 1024
STEP = "step long, windows long, rows_scanned long, inserts long, updates long, deletes long, last_key string, status string"


class SyncRun:
    def __init__(self, spark: SparkSession, path: str, spec: TableSpec, size: int):
        if size < 1:
            raise ValueError("a window needs a positive size")
        self.spark, self.path, self.spec, self.size = spark, path.rstrip("/"), spec, size
        self.records = Records(spark, self.path)
        self.owner = uuid.uuid4().hex
        self._seen: dict[int, dict] = {}

    # --- records ---------------------------------------------------------------------------------------

    def _steps(self) -> list[dict]:
        """All step records, each read once, since they are never replaced."""
        numbers = self.records.numbers("steps")
        self._seen |= {n: self.records.read(f"steps/{n}") for n in numbers if n not in self._seen}
        return [self._seen[n] for n in numbers]

    def _write(self, df: DataFrame) -> str:
        """Write rows under a name that no one else uses."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return at

    def failure(self) -> str | None:
        """Why the last step failed, if it did."""
        found = self.records.numbers("failed")
        return self.records.read(f"failed/{found[-1]}")["error"] if found else None

    def retry(self) -> None:
        """Clear the failures, so that the run can go on."""
        for n in self.records.numbers("failed"):
            self.records.delete(f"failed/{n}")

    def progress(self) -> DataFrame:
        """A row for each finished step."""
        return self.spark.createDataFrame([tuple(r[f.split()[0]] for f in STEP.split(", ")) for r in self._steps()], STEP)

    # --- the run ---------------------------------------------------------------------------------------

    def start(self, source: DataFrame) -> dict:
        """Settings of the run; on its first opening the source's windows are found."""
        own = {"table": self.spec.name, "key": list(self.spec.key), "columns": self.spec.writable, "size": self.size}
        if held := self.records.read("spec"):
            if {k: held[k] for k in own} != own:
                raise ValueError(f"{self.path} is a run with other settings: {held}")
            return held
        numbers = keyset.chunk_numbers(source, self.spec, self.size)
        last = F.max_by(F.struct(*self.spec.key), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keyset.key_order(self.spec))]))
        at = self._write(numbers.groupBy("chunk").agg(F.count("*").alias("rows"), last.alias("last")))
        held = own | {"windows": max(1, self.spark.read.parquet(at).count()), "at": at}
        self.records.create("spec", held)
        return held

    def _parts(self, settings: dict, first: int, end: int, windows: int) -> dict[int, tuple]:
        """Last key and number of rows of each `windows` windows behind the first up to the end, from 0; -1 for the window before them."""
        rows = self.spark.read.parquet(settings["at"]).where((F.col("chunk") >= first) & (F.col("chunk") <= end))
        part = F.floor((F.col("chunk") - first - 1) / windows).cast("int").alias("part")
        found = rows.groupBy(part).agg(F.max_by("last", "chunk").alias("last"), F.sum("rows").alias("rows")).collect()  # a row a step
        return {r["part"]: (list(r["last"]), r["rows"]) for r in found}

    def step(self, source: DataFrame, target: DataFrame, windows: int = 1) -> dict | None:
        """Do the next windows, in one comparison, and publish them; None if all are done.

        Refused while another worker holds the run, and after a failure that retry() hasn't cleared.
        """
        done = self._wave(source, target, windows, 1)
        return done[0] if done else None

    def _wave(self, source: DataFrame, target: DataFrame, windows: int, steps: int) -> list[dict]:
        if error := self.failure():
            raise RuntimeError(f"{self.path} failed: {error}")
        lease = Lease(self.records, self.owner)
        lease.take()
        number = len(self.records.numbers("steps"))
        try:
            return self._do(source, target, windows, steps)
        except Taken:
            raise
        except Exception as e:
            self.records.create(f"failed/{len(self.records.numbers('failed'))}", {"step": number, "error": f"{type(e).__name__}: {e}"[:2000]})
            raise
        finally:
            lease.give_up()

    def _do(self, source: DataFrame, target: DataFrame, windows: int, steps: int) -> list[dict]:
        """Records of the next steps, as many as are left."""
        settings, done = self.start(source), self._steps()
        first, total = sum(r["windows"] for r in done), settings["windows"]
        if first >= total:
            return []
        ends = [*range(first + windows, total, windows)][:steps]
        if len(ends) < steps:
            ends.append(total)
        found = self._parts(settings, first, ends[-1], windows)
        after, last = (found.get(n, (None, 0))[0] for n in (-1, len(ends) - 1))
        bound = None if ends[-1] == total else last
        part = lambda df: keyset.window(df, self.spec, after, bound)
        changed = diff.changes(part(source), part(target), self.spec)
        at = self._write(changed.withColumn("_part", keyset.behind(changed, self.spec, [found[n][0] for n in range(len(ends) - 1)])))
        counts = self.spark.read.parquet(at).groupBy("_part").agg(*[F.count_if(F.col("op") == op).alias(n) for op, n in (("I", "inserts"), ("U", "updates"), ("D", "deletes"))]).collect()  # a row a step
        counts = {r["_part"]: r.asDict() for r in counts}
        out = []
        for n, (begin, end) in enumerate(zip([first, *ends], ends)):
            upto, scanned = found.get(n, (None, 0))
            changes = {c: counts[n][c] if n in counts else 0 for c in ("inserts", "updates", "deletes")}
            out.append({"step": len(done) + n, "windows": end - begin, "rows_scanned": scanned, **changes, "last_key": json.dumps(upto, default=str), "status": "complete" if end == total else "running", "at": at, "part": n, "parts": len(ends)})
            self.records.create(f"steps/{len(done) + n}", out[-1])
        return out

    def run(self, source: DataFrame, target: DataFrame, windows: int = 1) -> None:
        """Do and publish all steps that are left, of `windows` windows each, in waves of one comparison."""
        steps = 1
        while self._wave(source, target, windows, steps):
            steps = min(4 * steps, WAVE)

    def result(self, target: DataFrame) -> DataFrame:
        """The target with the changes of all finished steps."""
        done: dict[str, list[dict]] = {}
        for r in self._steps():
            done.setdefault(r["at"], []).append(r)
        if not done:
            return target.select(*self.spec.writable)
        # Of a wave that was interrupted only the published steps count.
        whole = [at for at, rs in done.items() if len(rs) == rs[0].get("parts", 1)]
        cut = [self.spark.read.parquet(at).where(F.col("_part") < len(rs)).drop("_part") for at, rs in done.items() if at not in whole]
        found = [self.spark.read.parquet(*whole).drop("_part")] if whole else []
        return apply.apply_changes(target, reduce(DataFrame.unionByName, found + cut), self.spec)
