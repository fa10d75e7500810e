"""Keyword search over an inverted index: AND of substring hits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, PRE_LIMIT = 100, 3


def terms_of(query: str, least: int = 3) -> list[str]:
    """Distinct search words of a query in order."""
    return list(dict.fromkeys(re.findall("[a-z]{%d,}" % least, query.lower())))


#: First letters of parts that are looked for before a text's runs become rows.
MOST_STARTS = 2_000


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str, starts: list[str] | None = None) -> DataFrame:
    """The pairs of rows of ``texts`` and ``parts`` where the text contains the part.

    An equi-join on the first three letters of the part and the runs of up to
    three letters of the text finds the candidates; ``contains`` decides.  So
    there is no nested loop, and no side need be broadcast.  Where the parts'
    ``starts`` are known to be few, only these runs become rows.
    """
    runs = F.expr(f"array_distinct(flatten(transform(array(1, 2, 3), k -> case when length(`{text}`) >= k then transform(sequence(1, length(`{text}`) - k + 1), i -> substring(`{text}`, i, k)) else array() end)))")
    if starts is not None:
        runs = F.array_intersect(runs, F.array(*[F.lit(x) for x in starts]).cast("array<string>"))
    left = texts.withColumn("_run", F.explode(runs))
    right = parts.where(F.length(part) > 0).withColumn("_run", F.substring(part, 1, 3))
    return left.join(right, "_run").where(F.contains(F.col(text), F.col(part))).drop("_run")


def term_hits(posted: DataFrame, terms: DataFrame, key: str, vocab: DataFrame | None = None) -> DataFrame:
    """``term, key``: documents with a token that contains the term.

    The substring join runs over the distinct vocabulary (``vocab``, if it is
    at hand), against the terms of the query set; a term with a blank or
    another sign than a-z hits nothing.  Postings come in by an equi-join on
    the token.
    """
    words = (posted if vocab is None else vocab).select("token")
    few = terms.select("term").where("term rlike '^[a-z]+$'").distinct()
    return posted.join(containing(words if vocab is not None else words.distinct(), "token", few, "term"), "token").select("term", key).distinct()


def _terms(posted: DataFrame, terms: list[str]) -> DataFrame:
    return posted.sparkSession.createDataFrame([(t,) for t in terms], "term string")


def all_of(posted: DataFrame, terms: list[str], key: str, vocab: DataFrame | None = None) -> DataFrame:
    """Documents that every term hits; none if there are no terms."""
    wanted = list(dict.fromkeys(terms))
    hits = term_hits(posted, _terms(posted, wanted), key, vocab)
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(key)


def any_of(posted: DataFrame, terms: list[str], key: str, vocab: DataFrame | None = None) -> DataFrame:
    """Documents that some term hits."""
    return term_hits(posted, _terms(posted, terms), key, vocab).select(key).distinct()


def without(found: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Documents of ``found`` that aren't in ``other``."""
    return found.join(other, key, "left_anti")


def phrase_in(snippets: DataFrame, phrase: str, key: str, fields: list[str] | None = None) -> DataFrame:
    """Documents with the phrase in a snippet whose field name holds one of ``fields``."""
    rows = snippets.where(F.contains(F.lower("snippet"), F.lit(phrase.lower())))
    if fields:
        rows = rows.where(reduce(lambda a, b: a | b, [F.contains(F.col("field"), F.lit(f)) for f in fields]))
    return rows.select(key).distinct()


def search(entries: DataFrame, posted: DataFrame, query: str, category: str = "", dual_only: bool = False, limit: int = LIMIT, key: str = "idx", vocab: DataFrame | None = None) -> DataFrame:
    """``idx, score, total`` and the columns of ``entries``, best first.

    Words are ANDed, each by substring.  The first ``3 * limit`` hits in idx
    order are kept before scoring; score is the number of sources, plus 100 if
    the whole query is in the names.  An empty query takes all entries; a query
    without a word of three letters finds none.  ``total`` counts the hits
    before the last limit, by a window over those at most ``3 * limit`` rows.
    ``posted`` names documents by ``key``, a column of ``entries``.
    """
    q = query.strip().lower()
    terms = terms_of(q)
    if not q:
        hits = entries
    elif not terms:
        hits = entries.limit(0)
    else:
        hits = entries.join(all_of(posted, terms, key, vocab), key, "left_semi")
    if category:
        hits = hits.where(F.col("category") == category)
    if dual_only:
        hits = hits.where("has_traditional and has_evidence")
    first = hits.orderBy("idx").limit(PRE_LIMIT * limit)
    name = F.lower(F.concat_ws(" ", F.col("primary"), F.col("latin")))
    bonus = F.when(F.contains(name, F.lit(q)), 100).otherwise(0) if q else F.lit(0)
    scored = first.withColumn("score", F.coalesce("n_sources", F.lit(0)) + bonus)
    return scored.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy())).orderBy(F.desc("score"), "idx").limit(limit)


def lite(results: DataFrame) -> DataFrame:
    """Results cut for display: three common names, three snippets of 200 characters."""
    few = F.slice(F.map_entries("snippets"), 1, 3)
    cut = F.map_from_entries(F.transform(few, lambda e: F.struct(e["key"], F.substring(e["value"], 1, 200))))
    return results.withColumn("common", F.slice("common", 1, 3)).withColumn("snippets", cut)


def preview(snippets: Column) -> Column:
    """The first snippet of keynotes, a summary or indications, else the first."""
    entries = F.map_entries(snippets)
    liked = F.filter(entries, lambda e: e["key"].rlike("keynote|summary|indication"))
    return F.coalesce(F.get(liked, F.lit(0))["value"], F.get(entries, F.lit(0))["value"])


def first_match(names: DataFrame, entries: DataFrame, wanted: str = "name", text: str = "names") -> DataFrame:
    """``name, idx``: for each suggested name the first entry whose names hold it, or one of its words of four or more letters.

    A blank or null name fits nothing.
    """
    asked = names.select(F.col(wanted).alias("name"), F.lower(F.trim(F.col(wanted))).alias("_n")).where("_n <> ''").distinct()
    parts = asked.select("name", F.explode(F.array_distinct(F.concat(F.array("_n"), F.filter(F.split("_n", r"\s+"), lambda w: F.length(w) >= 4)))).alias("_part"))
    listed = entries.select("idx", F.lower(F.col(text)).alias("_names"))
    starts = [r[0] for r in parts.select(F.substring("_part", 1, 3)).distinct().limit(MOST_STARTS + 1).collect()]
    return containing(listed, "_names", parts, "_part", starts if len(starts) <= MOST_STARTS else None).groupBy("name").agg(F.min("idx").alias("idx"))
