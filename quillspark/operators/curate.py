"""Curation of a fixed list: donors merged into canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.ranks import numbered

PREFIX = 200


def new_texts(target: DataFrame, donors: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Donor texts whose first 200 characters the target doesn't hold under the same ``by``.

    The target is taken as it was: repeats inside the donors stay.  Null texts
    are dropped.
    """
    held = target.where(F.col(text).isNotNull()).select(*by, F.substring(text, 1, PREFIX).alias("_p")).distinct()
    rows = donors.where(F.col(text).isNotNull()).withColumn("_p", F.substring(text, 1, PREFIX))
    return rows.join(held, [*by, "_p"], "left_anti").drop("_p")


def first_by_prefix(rows: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """The first row of each 200-character prefix under ``by``; null texts are dropped."""
    cols = rows.columns
    kept = rows.where(F.col(text).isNotNull()).groupBy(*by, F.substring(text, 1, PREFIX).alias("_p")).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return kept.select("_r.*")


def appended(target: Column | str, addition: Column | str):
    """A string with an addition of over 20 characters whose first 100 aren't in its first 500."""
    t, a = (F.col(c) if isinstance(c, str) else c for c in (target, addition))
    return F.when((F.length(a) > 20) & ~F.contains(F.substring(t, 1, 500), F.substring(a, 1, 100)), F.concat(t, F.lit("\n\n"), a)).otherwise(t)


def item_text(v: Column) -> Column:
    """The text of a JSON item: a string itself, or the ``text`` of an object; null for others."""
    whole = F.get_json_object(F.concat(F.lit('{"x":'), v, F.lit("}")), "$.x")
    return F.when(v.startswith('"'), whole).when(v.startswith("{"), F.get_json_object(v, "$.text"))


def deep_merged(target: DataFrame, donor: DataFrame) -> DataFrame:
    """``key, field, kind, subfield, subkind, n, v``: the blocks of ``donor`` merged into those of ``target``.

    Both are rows of ``resolve.block_entries`` of one record a key.  A field or
    subfield that the target lacks comes over whole; to a list are added the
    items whose first 200 characters it doesn't hold (as it was: repeats inside
    the donor stay; items without a text go); a string is strung to another if
    it is longer than 20 characters and its first 100 aren't in the first 500;
    where kinds differ, or a value is neither, the target stays.
    """
    path = ["key", "field", "subfield"]
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in path))
    cols = [*path[:2], "kind", "subfield", "subkind"]
    leaf = F.when(F.col("kind") == "dict", F.col("subkind")).otherwise(F.col("kind"))
    t = target.select(*cols, "pos", "v", leaf.alias("leaf"), item_text(F.col("v")).alias("text"))
    d = donor.select(*cols, "pos", "v", leaf.alias("leaf"), item_text(F.col("v")).alias("text"))
    fields = t.groupBy("key", "field").agg(F.first("kind").alias("_kind"))
    paths = t.groupBy(*path).agg(F.first("leaf").alias("_leaf"), F.max("pos").alias("_last"))
    seen = d.join(fields, ["key", "field"], "left").alias("d").join(paths.alias("p"), same("d", "p"), "left").select("d.*", "p._leaf", "p._last")
    fits = seen.where(F.col("_kind").isNull() | (F.col("_kind") == F.col("kind")))
    new = fits.where("_leaf is null")
    held = t.where("leaf = 'list' and text is not null").select(*path, F.substring("text", 1, PREFIX).alias("_p")).distinct()
    items = fits.where("_leaf = 'list' and leaf = 'list' and text is not null").withColumn("_p", F.substring("text", 1, PREFIX))
    added = items.alias("i").join(held.alias("h"), same("i", "h") & F.expr("i._p = h._p"), "left_anti").withColumn("pos", F.col("pos") + F.col("_last") + 1)
    strings = fits.where("_leaf = 'scalar' and leaf = 'scalar' and v like '\"%'").select(*path, F.col("text").alias("_more"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    kept = t.alias("t").join(strings.alias("s"), same("t", "s"), "left").select("t.*", "s._more")
    grown = F.when((F.col("leaf") == "scalar") & F.col("text").isNotNull() & F.col("_more").isNotNull() & (appended("text", "_more") != F.col("text")), quoted(appended("text", "_more"))).otherwise(F.col("v"))
    every = kept.withColumn("v", grown).select(*cols, "pos", "v").union(new.select(*cols, "pos", "v")).union(added.select(*cols, "pos", "v"))
    return numbered(every, path, [F.asc("pos"), F.asc("v")], "n").select(*cols, "n", "v")


def merge_donors(names: DataFrame, donors: DataFrame) -> DataFrame:
    """``names`` with donors merged into their canonical record and taken out.

    ``names``: ``id, primary, synonyms, sources``; ``donors``: ``donor, canonical``
    (a short fixed list).  Sources are united in order, a donor's primary name
    becomes a synonym unless it equals the canonical one in any case.  Donors
    whose canonical record is missing stay.
    """
    there = names.select(F.col("id").alias("canonical"))
    pairs = donors.join(there, "canonical", "left_semi")
    given = names.join(pairs, names["id"] == pairs["donor"]).select("canonical", F.struct("donor", "primary", "synonyms", "sources").alias("d"))
    gifts = given.groupBy("canonical").agg(F.array_sort(F.collect_list("d")).alias("ds"))  # a canonical record has a handful of listed donors
    kept = names.join(pairs.select(F.col("donor").alias("id")), "id", "left_anti").join(gifts, F.col("id") == F.col("canonical"), "left")
    none = F.array().cast("array<string>")
    extra = F.flatten(F.transform(F.coalesce("ds", F.array().cast("array<struct<donor:string,primary:string,synonyms:array<string>,sources:array<string>>>")), lambda d: F.concat(F.array(d["primary"]), F.coalesce(d["synonyms"], none))))
    fresh = F.filter(extra, lambda x: x.isNotNull() & (F.lower(x) != F.lower(F.coalesce("primary", F.lit("")))))
    more = F.flatten(F.transform(F.coalesce("ds", F.array().cast("array<struct<donor:string,primary:string,synonyms:array<string>,sources:array<string>>>")), lambda d: F.coalesce(d["sources"], none)))
    return kept.select("id", "primary", F.array_distinct(F.concat(F.coalesce("synonyms", none), fresh)).alias("synonyms"), F.array_distinct(F.concat(F.coalesce("sources", none), more)).alias("sources"))


def tagged(names: DataFrame, tags: DataFrame) -> DataFrame:
    """``names`` with the number of a fixed list (``id, number``), null elsewhere."""
    return names.join(tags.select("id", F.col("number").alias("tag_number")), "id", "left")


def frequent_marks(marks: DataFrame, mark: str, least: int = 50, repairs: dict[str, str | None] | None = None) -> DataFrame:
    """``mark, n, first_pos``: marks that come ``least`` times or more, after scan repairs (null drops a mark)."""
    c = F.col(mark)
    for wrong, right in (repairs or {}).items():
        c = F.when(F.col(mark) == wrong, F.lit(right)).otherwise(c)
    fixed = marks.select(c.alias("mark"), "pos").where("mark is not null")
    return fixed.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")).where(F.col("n") >= least)


def daily_cap(events: DataFrame, cap: int = 100, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """``events`` with ``allowed``: the first ``cap`` of each UTC day pass, in order of time and key.

    Ranks are needed up to the cap only: the cap-th event of a day is found
    with a group limit, so a hot day isn't sorted in one task, and the rest is
    a comparison.  Events without a time never pass.
    """
    day = F.to_date(ts)
    w = Window.partitionBy("_day").orderBy(ts, key)
    last = events.where(F.col(ts).isNotNull()).select(day.alias("_day"), ts, key).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).groupBy("_day").agg(F.max(F.struct(F.col(ts).alias("t"), F.col(key).alias("k"))).alias("_last"))
    at = F.struct(F.col(ts).alias("t"), F.col(key).alias("k"))
    return events.withColumn("_day", day).join(last, "_day", "left").withColumn("allowed", F.coalesce(at <= F.col("_last"), F.lit(False))).drop("_day", "_last")
