"""Readers of landed pages, scans and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import decode_bytes, slug

#: Keys that may be given as a list, which is broadcast.
MOST_KEYS = 100_000
RECORD = "id string, names struct<primary: string, latin: string, common: array<string>, synonyms: array<string>, abbreviation: string>, category string, provenance struct<sources: array<string>>"


def pages(spark: SparkSession, path: str, charsets: tuple[str, ...] = ("cp1252", "iso-8859-1", "utf-8"), glob: str = "*") -> DataFrame:
    """``url, html`` of landed pages; an empty file marks a page that wasn't found and is left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.where("length > 0").select(F.col("path").alias("url"), decode_bytes(*charsets)("content").alias("html"))


def wanted_pages(landed: DataFrame, keys: list[str]) -> DataFrame:
    """The pages whose last path part, as a slug, is in a fixed list."""
    name = slug(F.regexp_replace(F.substring_index("url", "/", -1), r"\.[A-Za-z]+$", ""))
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys; join a table of them")
    few = landed.sparkSession.createDataFrame([(k,) for k in keys], "_key string")
    return landed.withColumn("_key", name).join(F.broadcast(few), "_key", "left_semi").drop("_key")


def scans(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of scanned text files, each as a whole; bytes that are no UTF-8 become U+FFFD."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def json_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of files that each hold a JSON array, and the names of files that don't.

    Records are ``source_file, ord, id, names, category, provenance, traditional,
    evidence`` with the open blocks as JSON text, in ``ord`` of their file.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("_v")).withColumn("_j", F.try_parse_json("_v"))
    good = F.coalesce(F.schema_of_variant("_j").startswith("ARRAY"), F.lit(False))
    items = F.from_json(F.when(good, F.col("_v")), "array<string>")
    rows = raw.where(good).select("source_file", F.posexplode(items).alias("ord", "_r"))
    record = F.from_json("_r", RECORD)
    out = rows.select("source_file", "ord", record.alias("r"), F.get_json_object("_r", "$.traditional").alias("traditional"), F.get_json_object("_r", "$.evidence").alias("evidence")).select("source_file", "ord", "r.*", "traditional", "evidence")
    return out, raw.where(~good).select("source_file")


def json_objects(spark: SparkSession, path: str, skip: str = "_index.json") -> DataFrame:
    """``file, doc`` (variant) of files that each hold one JSON object; others and ``skip`` are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("doc"))
    return raw.where((F.col("file") != skip) & F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)))


def books(config: list[dict], read, only: str = "all") -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Several books by one reader ``read(book)``; a book that fails is named and left out."""
    found, failed = None, []
    for book in config:
        if only not in ("all", book["id"]):
            continue
        try:
            part = read(book).withColumn("source_id", F.lit(book["id"]))
        except Exception as e:  # one bad book must not stop the others
            failed.append((book["id"], str(e)))
            continue
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found, failed
