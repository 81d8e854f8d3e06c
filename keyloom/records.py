"""Durable records in a shared folder: files that are created once, whole, and never replaced; leases made of them."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer created the record first."""


class Records:
    """JSON records `path/name`. A record is there with all of its content or not at all.

    It is written under a name of its own and then renamed without leave to replace: the second of two
    writers is refused. HDFS decides that at once; a store without such a rename needs one writer (Lease).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._path = hadoop.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        rename = getattr(hadoop, "Options$Rename")
        self._never_replace = spark._sc._gateway.new_array(rename, 1)
        self._never_replace[0] = rename.NONE

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def numbers(self, folder: str) -> list[int]:
        """Names in a folder that are numbers, ascending."""
        at = self._at(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in found if n.isdigit())

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, record: dict) -> None:
        """Create a record; Taken if it is there, which leaves it as it is."""
        half = self._at(f"{name}.{uuid.uuid4().hex}.half")
        out = self._fs.create(half, False)
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
        try:
            self._context.rename(half, self._at(name), self._never_replace)
        except Exception as e:
            self._fs.delete(half, False)
            if self.exists(name):
                raise Taken(f"{name} of {self.path} was written by another writer") from e
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Lease:
    """One writer at a time: numbered records `leases/N`, the last of which holds until its time is over.

    Taking, renewing and giving up are all the creation of the next number, so of two writers that see
    the same last record one is refused. Times are those of the drivers' clocks.
    """

    def __init__(self, records: Records, owner: str, seconds: float = 600.0):
        self.records, self.owner, self.seconds = records, owner, seconds

    def _last(self) -> tuple[int, dict | None]:
        found = self.records.numbers("leases")
        return (found[-1], self.records.read(f"leases/{found[-1]}")) if found else (-1, None)

    def _next(self, number: int, until: float) -> None:
        self.records.create(f"leases/{number + 1}", {"owner": self.owner, "until": until})
        for old in self.records.numbers("leases"):
            if old < number:
                self.records.delete(f"leases/{old}")

    def take(self) -> None:
        """Take or renew it; Taken if another owner's time isn't over."""
        number, held = self._last()
        if held and held["owner"] != self.owner and held["until"] > time.time():
            raise Taken(f"{self.records.path} is leased by {held['owner']}")
        self._next(number, time.time() + self.seconds)

    def give_up(self) -> None:
        number, held = self._last()
        if held and held["owner"] == self.owner:
            self._next(number, 0)
