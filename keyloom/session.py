"""Session, table and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; works on every path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where that setting is missing on a local master, as in tests, a temporary folder is made; on a
    cluster, whose machines wouldn't share it, its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/keyloom/{label}-{uuid.uuid4().hex}"


#: Makes Spark delete the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows from which an Arrow batch for Python ends.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, any executor can read it.

    The shuffle files that led to it are deleted once it is written, since nothing reads them again.
    batch_bytes: what the batches that Python gets may hold (at least a row), instead of the session's setting.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, label)
    conf = {CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
