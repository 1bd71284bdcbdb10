"""Places for intermediate tables.

A cluster names a folder that all its nodes share in ``spark.checkpoint.dir``; everything that must
outlive an executor goes there. Only on a local master, as in tests, a local folder may stand in for it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session; also makes it the checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all nodes of {master} share")
        folder = getattr(shared_folder, "own", None)
        if folder is None:
            folder = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="quarry-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete all intermediate tables this process made; results that still read them must have been stored."""
    n = len(_made)
    while _made:
        remove(spark, _made.pop())
    return n


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives the loss of executors."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """written(), and the number of rows, counted while writing."""
    out, counts = observed(df, name, n=F.count(F.lit(1)))
    return out, counts["n"]


def observed(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """written(), and aggregates over its rows, computed while writing."""
    seen = Observation()
    path = fresh_path(df.sparkSession, name)
    df.observe(seen, *(a.alias(k) for k, a in aggregates.items())).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """What write_text() wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    into = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(into, "UTF-8")
    finally:
        into.close()


#: Limits of the Arrow batches sent to Python workers where rows hold whole payloads.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of the Python workers of this session: payloads are large, the default counts rows only."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(spark.conf.get(key, "0") or 0)
            if now <= 0 or now > most:
                spark.conf.set(key, str(most))
        except Exception:  # a version without this setting, or one that can't be changed
            pass
