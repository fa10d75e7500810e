"""Search entries, snippets and the positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import squeeze, words
from quillspark.operators.curate import item_text
from quillspark.operators.resolve import block_entries
from quillspark.plans.ranks import numbered

SNIPPET, JOINED = 400, 800


def ranked_index(entries: DataFrame, tie: str = "id") -> DataFrame:
    """``entries`` with ``idx``: position by most sources, then primary name, then ``tie``.

    The order is that of one global range sort.
    """
    order = [F.desc("n_sources"), F.asc_nulls_first("primary"), F.asc(tie)]
    return numbered(entries, [], order, "idx").withColumn("idx", F.col("idx").cast("int"))


def postings(df: DataFrame, key: str, text: Column | str, least: int = 3, unique: bool = False) -> DataFrame:
    """``token, key`` without repeats.  Null and token-free texts have no rows.

    Where keys are ``unique`` a text's own tokens are all that can repeat, and
    nothing is shuffled.
    """
    c = F.col(text) if isinstance(text, str) else text
    found = df.select(F.col(key), F.explode(F.array_distinct(words(c, least))).alias("token")).select("token", key)
    return found if unique else found.distinct()


def token_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tokens``: the distinct tokens of each document, one row a key; texts of repeated keys are taken together."""
    found = df.select(key, F.array_distinct(words(F.col(text))).alias("tokens")).where("size(tokens) > 0")
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return found
    return found.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))


def vocabulary(posted: DataFrame) -> DataFrame:
    """``token, df``: each token and the number of documents that have it."""
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def snippets(entries: DataFrame, key: str, field: str = "field", text: str = "text", order: str = "seq") -> DataFrame:
    """``key, field, snippet``: items of over 10 characters cut to 400, strung together by ' | ', cut to 800."""
    item = F.substring(squeeze(F.col(text)), 1, SNIPPET)
    kept = entries.where(F.length(text) > 10).select(key, field, order, item.alias("_t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), " | ")
    few = kept.groupBy(key, field, order).agg(F.min("_t").alias("_t"))
    top = few.withColumn("_n", F.row_number().over(Window.partitionBy(key, field).orderBy(order))).where(F.col("_n") <= JOINED)  # 800 items fill the snippet
    return top.groupBy(key, field).agg(F.substring(joined, 1, JOINED).alias("snippet"))


def search_text(*parts: Column) -> Column:
    """What is searched of an entry: its names and snippets, lower case, blank-joined."""
    return F.lower(F.concat_ws(" ", *parts))


def block_snippets(entries: DataFrame, prefix: str = "") -> DataFrame:
    """``key, field, snippet`` of ``resolve.block_entries``: strings of over 10 characters cut to 400, list items cut to 400 and strung together by ' | ', cut to 800.

    Of a list count texts of objects, and strings of over 5 characters.  Keys
    of a dict are named ``field.subfield``; ``prefix`` goes before all names.
    """
    text = item_text(F.col("v"))
    rows = entries.withColumn("leaf", F.when(F.col("kind") == "dict", F.col("subkind")).otherwise(F.col("kind"))).withColumn("text", text)
    good = ((F.col("leaf") == "scalar") & F.col("v").startswith('"') & (F.length("text") > 10)) | ((F.col("leaf") == "list") & F.when(F.col("v").startswith('"'), F.length("text") > 5).otherwise(F.length("text") > 0))
    name = F.concat(F.lit(prefix), F.concat_ws(".", "field", "subfield"))
    item = F.substring(F.regexp_replace(F.col("text"), r"(?U)\s+", " "), 1, SNIPPET)
    kept = rows.where(good).select("key", name.alias("field"), "leaf", "pos", item.alias("_t"))
    top = kept.withColumn("_n", F.row_number().over(Window.partitionBy("key", "field").orderBy("pos"))).where(F.col("_n") <= JOINED)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), " | ")
    return top.groupBy("key", "field").agg(F.substring(joined, 1, JOINED).alias("snippet"))


def search_entries(entities: DataFrame, key: str = "id") -> DataFrame:
    """Search entries of merged entities: names, counts and flags, and ``snippets`` by field, those of evidence as ``ev.``.

    ``entities`` has ``names, category, provenance`` and the open blocks
    ``traditional`` and ``evidence`` as JSON text, one row a ``key``.
    """
    keyed = entities.withColumn("key", F.col(key).cast("string"))
    place = F.lit(0).alias("_one")
    blocks = [block_snippets(block_entries(keyed.select("key", b, place), b, ("_one",)), p) for b, p in (("traditional", ""), ("evidence", "ev."))]
    found = blocks[0].unionByName(blocks[1]).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "snippet")))).alias("snippets"))
    none = F.array().cast("array<string>")
    some = lambda b: F.coalesce(F.regexp_replace(b, r"\s", "").rlike(r"^\{."), F.lit(False)) & ~F.coalesce(F.regexp_replace(b, r"\s", ""), F.lit("{}")).isin("{}")
    names = keyed.select(key, "key", F.coalesce("names.primary", F.lit("")).alias("primary"), F.coalesce("names.latin", F.lit("")).alias("latin"), F.coalesce("names.common", none).alias("common"), F.coalesce("names.synonyms", none).alias("synonyms"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("provenance.sources", none).alias("sources"), some(F.col("traditional")).alias("has_traditional"), some(F.col("evidence")).alias("has_evidence"))
    return names.withColumn("n_sources", F.size("sources")).join(found, "key", "left").withColumn("snippets", F.coalesce("snippets", F.create_map().cast("map<string,string>"))).drop(*({"key"} - {key}))
