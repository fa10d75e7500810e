"""Search tables that are built once and read by many queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans.scratch import materialize

_built: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of change of the files of a table; another state is another table."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def built(spark: SparkSession, path: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from the files at ``path``: written at the first call of a session, and again once they change."""
    key = (spark.sparkContext.applicationId, path, name, _state(spark, path))
    if key not in _built:
        _built[key] = materialize(build(), name)
    return _built[key]
