"""Writers; every one replaces its target as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_sources(records: DataFrame, path: str, source: str = "source_id") -> None:
    """Records by source, one folder each."""
    records.write.mode("overwrite").partitionBy(source).parquet(path)


def write_entities(entities: DataFrame, path: str, key: str = "id", files: int | None = None) -> None:
    """Entities range-sorted by id, so that a point look-up prunes to one file's row group."""
    parts = entities.repartitionByRange(files, key) if files else entities.repartitionByRange(key)
    parts.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_index(entries: DataFrame, path: str) -> None:
    """Search entries in the order of ``idx``."""
    entries.orderBy("idx").write.mode("overwrite").parquet(path)


def swap_version(new: DataFrame, base: str, version: str) -> str:
    """A new version beside the old ones, so that readers never see half of it; its path."""
    path = f"{base.rstrip('/')}/version={version}"
    new.write.mode("errorifexists").parquet(path)
    return path


def set_current(spark: SparkSession, base: str, version: str) -> None:
    """Point to a version: the pointer is written beside and renamed over the old one, so readers see the old or the new."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/CURRENT")
    beside = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/CURRENT.{uuid.uuid4().hex}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = target.getFileSystem(conf).create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(target.getFileSystem(conf).makeQualified(beside), target.getFileSystem(conf).makeQualified(target), options)


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """The version that the pointer names."""
    base = base.rstrip("/")
    version = spark.read.text(f"{base}/CURRENT", wholetext=True).first()[0]
    return spark.read.parquet(f"{base}/version={version}")


def update(spark: SparkSession, base: str, version: str, change) -> DataFrame:
    """Read the current version, write what ``change`` makes of it as a new one, and point to that; records that it leaves out are gone."""
    swap_version(change(read_current(spark, base)), base, version)
    set_current(spark, base, version)
    return read_current(spark, base)


def write_counted(df: DataFrame, path: str, **metrics) -> dict:
    """Write and return metrics (aggregate columns) taken on the way, without a second pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get
