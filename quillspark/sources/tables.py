"""Parquet tables of a scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` in ``sf_dir``; a file or a folder of files, read with pruning and pushdown."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
