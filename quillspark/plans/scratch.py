"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session (tests) that names none gets a temporary folder; on a
    cluster the executors would each write their own disk, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint the copy is columnar, so later stages read only the
    columns they need, and it survives the loss of any executor.  The files
    go when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def release(spark: SparkSession) -> None:
    """Let go the shuffle files of finished jobs, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    _delete(df.sparkSession, df._scratch)
    _made.remove((df.sparkSession, df._scratch))


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session or its gateway has gone already
            pass
