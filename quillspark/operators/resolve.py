"""Entity resolution: canonical keys, ordered groups and deep merge."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as fixed
from quillspark.functions.text import fold_marks
from quillspark.plans.ranks import numbered
from quillspark.plans.scratch import materialize

DEFAULT_CATEGORY = "homeopathic"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def canonical_key(latin: Column, common: dict[str, str] | None = None, abbreviations: dict[str, str] | None = None, strict: bool = True) -> Column:
    """The slug of genus and species that a name stands for; '' for null, empty and name-free text.

    Brackets go, then all from the first dash, hyphen or comma; noise tokens
    are dropped; the longest prefix of four to one tokens in ``common`` wins,
    then the first token in ``abbreviations``, then the first two tokens.  Keys
    with hyphens or noise tokens can't be reached from a name; ``strict=False``
    tokenises such keys the way names are, so that they can.
    """
    common = fixed.COMMON_TO_LATIN if common is None else common
    abbreviations = fixed.ABBREVIATIONS if abbreviations is None else abbreviations
    if not strict:
        common = {" ".join(t for t in k.replace("-", " ").split() if t not in fixed.NOISE_TOKENS): v for k, v in common.items()}
    s = F.regexp_replace(F.coalesce(latin, F.lit("")), r"\([^)]*\)", " ")
    s = F.element_at(F.split(s, "[—–,-]", 2), 1)
    s = F.lower(fold_marks(F.regexp_replace(s, "[æÆ]", "ae")))
    noise = F.array(*[F.lit(t) for t in fixed.NOISE_TOKENS])
    tokens = F.filter(F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0)), lambda t: ~F.array_contains(noise, t))
    by_name = [F.when(F.size(tokens) >= n, F.try_element_at(_map(common), F.array_join(F.slice(tokens, 1, n), " "))) for n in (4, 3, 2, 1)] if common else []
    by_short = [F.try_element_at(_map(abbreviations), F.get(tokens, F.lit(0)))] if abbreviations else []
    name = F.coalesce(*by_name, *by_short, F.array_join(F.slice(tokens, 1, 2), " "))
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def _first_seen(rows: DataFrame, key: str, value: str, order: list[str], out: str) -> DataFrame:
    """``key, out``: distinct values of each key in the order first seen.

    Distinct (key, value) pairs are reduced first, map side, so that a hot key
    brings only its distinct values together.
    """
    first = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.min(F.struct(*order)).alias("_at"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_l"))
    return listed.select(key, F.transform("_l", lambda x: x[value]).alias(out))


def keyed(records: DataFrame) -> DataFrame:
    """``records`` with ``key`` of the Latin name, or of the primary name where there is none."""
    latin = F.coalesce(F.when(F.col("names.latin") != "", F.col("names.latin")), F.col("names.primary"))
    return records.withColumn("key", canonical_key(latin))


def merged_names(records: DataFrame, order: tuple[str, ...] = ("source_file", "ord")) -> DataFrame:
    """One row a key: ``key, primary, latin, common, synonyms, category, sources, n_records``.

    First primary and Latin name that aren't empty (Latin falls back to the
    record's primary), distinct common names and sources as first seen,
    synonyms are the other primaries, the last category that isn't the default
    wins.  Records with a blank key are skipped.  ``records`` has ``key``.
    """
    at = F.struct(*order)
    some = lambda c: F.when(c != "", c)
    rows = records.where("key <> ''")
    primary, latin = some(F.col("names.primary")), F.coalesce(some(F.col("names.latin")), some(F.col("names.primary")))
    base = rows.groupBy("key").agg(
        F.min_by(primary, F.when(primary.isNotNull(), at)).alias("primary"),
        F.min_by(latin, F.when(latin.isNotNull(), at)).alias("latin"),
        F.coalesce(F.max_by(F.col("category"), F.when(some(F.col("category")) != DEFAULT_CATEGORY, at)), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.count(F.lit(1)).alias("n_records"),
    )
    keep = [F.col(c) for c in order]
    common = _first_seen(rows.select("key", *keep, F.posexplode("names.common").alias("_p", "v")), "key", "v", [*order, "_p"], "common")
    sources = _first_seen(rows.select("key", *keep, F.posexplode("provenance.sources").alias("_p", "v")), "key", "v", [*order, "_p"], "sources")
    names = _first_seen(rows.select("key", *keep, F.col("names.primary").alias("v")), "key", "v", list(order), "names")
    none = F.array().cast("array<string>")
    full = base.join(common, "key", "left").join(sources, "key", "left").join(names, "key", "left")
    return full.select("key", F.coalesce("primary", F.lit("")).alias("primary"), F.coalesce("latin", F.lit("")).alias("latin"), F.coalesce("common", none).alias("common"), F.coalesce(F.slice("names", 2, F.greatest(F.size("names"), F.lit(1))), none).alias("synonyms"), "category", F.coalesce("sources", none).alias("sources"), "n_records")


def block_entries(records: DataFrame, block: str = "traditional", order: tuple[str, ...] = ("source_file", "ord")) -> DataFrame:
    """The open block (JSON text) in long form: ``key, field, kind, subfield, subkind, _at, pos, v``.

    ``kind`` is list, dict or scalar; dicts are one level deep, a list under a
    dict has one row an item.  Text that is no JSON object has no rows.
    """
    at = F.struct(*order).alias("_at")
    top = records.where("key <> ''").select("key", at, F.expr(f"try_parse_json({block})").alias("_b")).where("_b is not null and schema_of_variant(_b) like 'OBJECT%'")
    return _variant_rows(top, "_b")


def _variant_rows(top: DataFrame, block: str) -> DataFrame:
    spark = top.sparkSession
    name = f"_quillspark_{uuid.uuid4().hex}"  # of this call alone: another may run beside it
    kind = lambda v: f"case when schema_of_variant({v}) like 'ARRAY%' then 'list' when schema_of_variant({v}) like 'OBJECT%' then 'dict' else 'scalar' end"
    try:
        top.createOrReplaceTempView(f"{name}_block")
        level = spark.sql(f"select b.key, b._at, f.key as field, {kind('f.value')} as kind, f.value as v from {name}_block b, lateral variant_explode(b.{block}) f")
        level.createOrReplaceTempView(f"{name}_fields")
        none = "cast(null as string) subfield, cast(null as string) subkind"
        lists = spark.sql(f"select t.key, t._at, t.field, t.kind, {none}, e.pos, to_json(e.value) v from {name}_fields t, lateral variant_explode(t.v) e where t.kind = 'list'")
        scalars = spark.sql(f"select key, _at, field, kind, {none}, 0 pos, to_json(v) v from {name}_fields where kind = 'scalar'")
        subs = spark.sql(f"select t.key, t._at, t.field, t.kind, s.key subfield, {kind('s.value')} subkind, s.value v from {name}_fields t, lateral variant_explode(t.v) s where t.kind = 'dict'")
        subs.createOrReplaceTempView(f"{name}_subs")
        under = spark.sql(f"select t.key, t._at, t.field, t.kind, t.subfield, t.subkind, e.pos, to_json(e.value) v from {name}_subs t, lateral variant_explode(t.v) e where t.subkind = 'list' union all select key, _at, field, kind, subfield, subkind, 0 pos, to_json(v) v from {name}_subs where subkind <> 'list'")
        return lists.unionByName(scalars).unionByName(under)
    finally:
        for view in ("block", "fields", "subs"):
            spark.catalog.dropTempView(f"{name}_{view}")


def merged_block(entries: DataFrame) -> DataFrame:
    """``key, field, kind, subfield, subkind, n, v``: the deep merge of ``block_entries``.

    Lists of one field are strung together, dicts are merged one level deep,
    and where kinds differ (of a field, or under a dict) the first stays.  A
    scalar keeps its first value.  Rows of a hot key are numbered in a range
    sort, not gathered.
    """
    entries = materialize(entries, "block")
    first = entries.groupBy("key", "field").agg(F.min_by("kind", "_at").alias("kind"))
    same = entries.join(first, ["key", "field", "kind"])
    sub = same.groupBy("key", "field", "subfield").agg(F.min_by("subkind", "_at").alias("_kind"), F.min("_at").alias("_first")).toDF("_key", "_field", "_subfield", "_kind", "_first")
    kept = same.join(sub, F.expr("key = _key and field = _field and subfield <=> _subfield and subkind <=> _kind"))
    rows = kept.where("kind = 'list' or subkind = 'list' or _at = _first").select("key", "field", "kind", "subfield", "subkind", "_at", "pos", "v")
    return numbered(rows, ["key", "field", "subfield"], [F.asc("_at"), F.asc("pos")], "n").drop("_at", "pos")


def corpus_counts(records: DataFrame) -> DataFrame:
    """``source_file, n_records, n_keys, n_skipped``, and a total row with null file."""
    return records.rollup("source_file").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(F.when(F.col("key") != "", F.col("key"))).alias("n_keys"), F.count_if(F.col("key") == "").alias("n_skipped"))


def summary_counts(records: DataFrame, merged: DataFrame) -> DataFrame:
    """One row ``total_records, skipped, entities, multi_source``: the totals of a summary index, with the entities of two or more sources."""
    whole = records.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("key") == "").alias("skipped"))
    found = merged.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.size("sources") >= 2).alias("multi_source"))
    return whole.crossJoin(found)  # one row each


def summary_entries(merged: DataFrame) -> DataFrame:
    """The entities of a summary index: ``id, primary, latin, synonyms, category, n_sources, sources``."""
    return merged.select(F.col("key").alias("id"), "primary", "latin", "synonyms", "category", F.size("sources").alias("n_sources"), "sources")
