"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bin_packing, canonical_names, garbled_text, mixing, near_duplicates, stuffed_pages, survivors
from quillspark.llm.oracle import SQL
from quillspark.sources import table


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """The entries of problems 2 and 4."""
    return table(spark, d, "entry").where(F.col("field").isin("keynotes", "generalities"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_names.mapped_names(table(spark, d, "source_record"), table(spark, d, "remedy_ref"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_text.restored(_notes(spark, d)).select(F.col("id").alias("entry_id"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled_text.restored(_notes(spark, d)).withColumnRenamed("id", "entry_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "entity"), table(spark, d, "book"))


def p3_fused(spark: SparkSession, d: str) -> DataFrame:
    return survivors.fused(table(spark, d, "entity"), table(spark, d, "book"))


def p3_sources(spark: SparkSession, d: str) -> DataFrame:
    return survivors.sources(table(spark, d, "entity"), table(spark, d, "book"))


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return survivors.agreement(table(spark, d, "entity"), table(spark, d, "book"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_notes(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_notes(spark, d))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return bin_packing.containers(table(spark, d, "documents"), table(spark, d, "pack_bin"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return bin_packing.fill(p6_pack(spark, d), table(spark, d, "pack_bin"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    return bin_packing.check(p6_pack(spark, d), table(spark, d, "pack_bin"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, d), table(spark, d, "mix_target"), table(spark, d, "documents"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    return mixing.check(p7_mix(spark, d), table(spark, d, "mix_target"), table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages.junk_pages(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages.junk_shares(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p2_found, p2_restored, p3_found, p3_fused, p3_sources, p3_agreement, p4_found, p4_groups, p6_pack, p6_fill, p6_check, p7_mix, p7_shares, p7_check, p8_found, p8_shares]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
