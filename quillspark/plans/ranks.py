"""Positions in order, without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.scratch import materialize


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: the position from 0 of each row in its group by ``order``.

    Rows are range-sorted by group and order and written once, which fixes the
    parts; positions are counted inside each part and moved on by what the
    parts before hold of the group.  A group of any size is spread over parts.
    """
    keys = [F.asc_nulls_first(c) for c in group]
    part = materialize(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = part.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = part.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)) - 1)
    same = " and ".join(["l._part = b._p", *[f"l.`{c}` <=> b.`_g_{c}`" for c in group]])
    joined = local.alias("l").join(before.alias("b"), F.expr(same))
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("_local") + F.col("_before")).alias(out))
