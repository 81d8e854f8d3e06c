"""WARC archives with one gzip member for each record, and a splittable reader of them.

Writing goes through Spark's own committed text sink, so a lost task leaves nothing behind: a row is the
bytes of a gzip member, cast to string without any decoding. That sink puts a separator after each row.
The last byte of a gzip member is the high byte of the payload's length, zero below 16 MiB, so the
separator is a zero byte that stands for it; larger members keep their own last byte, and the zero
behind them is padding, which gzip readers skip.

Reading: each task scans a byte range for the gzip magic, tries to decode a record header at each
candidate (the magic also occurs inside compressed data) and owns the records that start in its range,
reading past its end to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import read_table, work_path

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a split, bytes that are read at a time, and records of an archive file.
SPLIT, BLOCK, RECORDS = 16 << 20, 1 << 20, 50_000
#: Tasks that read an archive at most.
TASKS = 100_000
DATE = "2020-01-01T00:00:00Z"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record_bytes(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without payload that refers to another record."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _members(batches):
    for b in batches:
        out, size = [], 0
        for page_id, url, html, first in zip(*(b.column(i) for i in range(4))):
            m = gzip_member(record_bytes(page_id.as_py(), url.as_py() or "", (html.as_py() or "").encode(), first.as_py()))
            out.append(m[:-1] if m[-1] == 0 else m)
            size += len(out[-1])
            if size > BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record for each row with a non-null id: of rows with equal payloads of min_bytes or more,
    the one with the smallest id is a response, the others are revisits of it.

    Null html is an empty payload, null url an empty one; white space in urls becomes a space. Rows that
    repeat an id and payload are written once, an id with two payloads is written for each. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).where("id is not null")
    # The digest of a payload: its SHA-1 and length, computed where the row lies.
    rows = rows.withColumn("sha", F.concat(F.sha1(F.col("html").cast("binary")), F.lit("-"), F.octet_length("html")))
    keys = rows.where(F.octet_length("html") >= min_bytes).select("id", "sha")
    firsts = keys.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha", "first")
    # Only keys of payloads that repeat meet here; a payload that a third of all rows share is split by AQE.
    revisits = keys.join(firsts, "sha").where("id > first").select("id", "sha", "first").distinct()
    all_rows = rows.join(revisits, ["id", "sha"], "left").dropDuplicates(["id", "sha"]) if _repeats(rows) else rows.join(revisits, ["id", "sha"], "left")
    members = all_rows.select("id", "url", "html", "first").mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS).text(path)


def _repeats(rows: DataFrame) -> bool:
    return bool(rows.groupBy("id").count().where("count > 1").limit(1).count())


def parse_record(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda k: int(fields[k].rsplit(":", 1)[1].rstrip(">")) if k in fields else None
    payload = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "response" and digest(payload) != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], fields["WARC-Type"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), number("WARC-Refers-To"), payload


class _Window:
    """Bytes of a file from a moving start on, read block by block."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, bytearray()
        file.seek(start)

    def at(self, pos: int, n: int) -> bytes:
        while self.start + len(self.data) < pos + n and (more := self.file.read(BLOCK)):
            self.data += more
        return bytes(self.data[pos - self.start : pos - self.start + n])

    def drop(self, pos: int) -> None:
        if pos - self.start > BLOCK:
            del self.data[: pos - self.start]
            self.start = pos


def records_in(file, start: int, end: int):
    """Records whose gzip member starts in start .. end - 1 of an open file."""
    window, pos = _Window(file, start), start
    while pos < end:
        window.drop(pos)
        chunk = window.at(pos, min(BLOCK, end - pos) + len(MAGIC) - 1)
        found = chunk.find(MAGIC)
        if found < 0:
            if len(chunk) < len(MAGIC):
                return
            pos += len(chunk) - len(MAGIC) + 1
            continue
        pos += found
        z, out, at = zlib.decompressobj(31), [], pos
        try:
            head = z.decompress(window.at(at, 1 << 12))
            if not head.startswith(b"WARC/"):
                raise zlib.error("no record header")
            out.append(head)
            at += 1 << 12
            while not z.eof:
                more = window.at(at, BLOCK >> 2)
                if not more:
                    raise zlib.error("the member doesn't end")
                out.append(z.decompress(more))
                at += len(more)
        except zlib.error:
            pos += 1  # the magic occurred inside other data
            continue
        length = min(at, window.start + len(window.data)) - len(z.unused_data) - pos
        yield parse_record(b"".join(out))
        pos += length


def _read(batches):
    for b in batches:
        for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3))):
            fs, name = pafs.FileSystem.from_uri(path)
            rows, size = [], 0
            with fs.open_input_file(name) as f:
                for r in records_in(f, start, end):
                    rows.append(r)
                    size += len(r[6])
                    if size > 4 * BLOCK or len(rows) >= 2000:
                        yield _rows(rows)
                        rows, size = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_warc(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Records of all archives under path: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    The payload of a revisit is empty; its length and digest are those of the full payload. Splits are
    rows of (file, start, end). They get a task each up to TASKS, since their rows are tiny whatever they
    stand for; each is read on its own, again if its task is lost.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # lists files, reads none
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(split).cast("long")))
    splits = files.where("length > 0").select("path", "length", starts.alias("start")).select("path", "start", F.least("length", F.col("start") + split).alias("end"))
    return splits.repartition(max(1, min(TASKS, splits.count()))).mapInArrow(_read, READ)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
with p as (
  select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(encode(coalesce(html, ''))) as x,
         min(page_id) over (partition by coalesce(html, '')) as first from pages
)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p
"""
