"""Parsers of page and book sections, as Column expressions.

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import field_maps as maps
from quillspark.functions.text import clean_markup, looked_up, markup_title, squeeze

EDGES = r"^[ .,;]+|[ .,;]+$"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def dose(c: Column) -> Column:
    """``struct<notes>``: a dose line as it stands, without blanks around it."""
    return F.struct(stripped(c).alias("notes"))


def _listed(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x != "")


def meta_lists(page: Column, most: int = 50_000) -> Column:
    """``struct<name, common, latin>`` of a fact sheet: its first heading, and the lists behind "Common Names:" and "Latin Names:" in the cleaned first ``most`` characters."""
    text = clean_markup(F.substring(page, 1, most))
    common = F.regexp_extract(text, r"(?i)Common Names?:\s*([^.]+?)(?:Latin Names?:|Background)", 1)
    latin = F.regexp_extract(text, r"(?i)Latin Names?:\s*([^.]+?)(?:\.|Background)", 1)
    return F.struct(markup_title(page, "h1").alias("name"), _listed(common).alias("common"), _listed(latin).alias("latin"))


def botanical_name(c: Column) -> Column:
    """What follows "Botanical:" up to the family, a rule or the description, if under 80 characters; else ''."""
    name = F.regexp_replace(stripped(F.regexp_extract(c, r"Botanical:\s*(.+?)(?:\s+Family:|\s+---|\s+Description)", 1)), r"\.+$", "")
    return F.when(F.length(name) < 80, name).otherwise("")


def header_name(c: Column, short: Column, table: dict[str, str], most: int = 600) -> Column:
    """The first line of the first ``most`` characters that is a capitalised name of one to three words, else the full name of the abbreviation, else the abbreviation capitalised."""
    lines = F.transform(F.split(F.substring(c, 1, most), r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), stripped)
    fit = F.filter(lines, lambda s: s.rlike(r"^[A-Z][A-Za-z]+(\s+[a-z]+){0,2}\.?$") & (F.length(s) > 3) & (F.length(s) < 60))
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")
    plain = F.concat(F.upper(F.substring(short, 1, 1)), F.lower(F.substring(short, 2, 1_000_000)))
    return F.coalesce(F.regexp_replace(F.get(fit, F.lit(0)), r"\.+$", ""), F.try_element_at(names, short), plain)


def category(title: Column, words: list[str], found: str, otherwise: str) -> Column:
    """``found`` if the lower-cased title holds one of ``words``."""
    return F.when(_any([F.lower(title).contains(w) for w in words]), found).otherwise(otherwise)


def denied(name: Column, names: list[str] = (), starts: list[str] = (), parts: list[str] = ()) -> Column:
    """Is a page named one of ``names``, or does its name begin with or hold a listed part."""
    return _any([name.isin(list(names)) if names else F.lit(False), *[name.startswith(s) for s in starts], *[name.contains(p) for p in parts]])


def title_after(page: Column, mark: str = "|") -> Column:
    """The part of the page title behind the first ``mark``, the whole title without one."""
    t = markup_title(page)
    return F.when(F.contains(t, F.lit(mark)), stripped(F.substring(t, F.locate(mark, t) + len(mark), F.length(t)))).otherwise(t)


def split_title(c: Column) -> Column:
    """``struct<latin, common>`` of "Latin.—Common.": cut at the first dash, without full stops at the ends."""
    t = squeeze(c)
    parts = F.split(t, r"\s*[—–\-]\s*", 2)
    end = lambda x: stripped(F.regexp_replace(x, r"\.+$", ""))
    return F.struct(end(F.get(parts, F.lit(0))).alias("latin"), F.coalesce(end(F.get(parts, F.lit(1))), F.lit("")).alias("common"))


def _route(head: Column, body: Column, routes: list[tuple[tuple[str, ...], str, int]]) -> Column:
    low, out = F.lower(head), None
    for parts, field, length in routes:
        value = F.struct(F.lit(field).alias("field"), head.alias("head"), F.substring(body, 1, length).alias("text"))
        test = _any([low.contains(p) for p in parts]) if parts else F.lit(True)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def routed_sections(sections: Column, routes: list[tuple[tuple[str, ...], str, int]], skip: list[str] = (), summary: tuple[tuple[str, ...], int] | None = None, only_summary: bool = False) -> Column:
    """``array<struct<field, head, text>>``: each ``struct<head, body>`` by the first route of which its heading holds a part, cut to the route's length.

    Headings in ``skip`` are left out.  With ``summary`` the last section that
    fits it comes first, as field ``summary``; with ``only_summary`` such
    sections come in no other field.
    """
    kept = F.filter(sections, lambda s: ~F.lower(s["head"]).isin(list(skip))) if skip else sections
    if summary is None:
        return F.transform(kept, lambda s: _route(s["head"], s["body"], routes))
    fits = lambda s: _any([F.lower(s["head"]).contains(p) for p in summary[0]])
    last = F.slice(F.reverse(F.filter(kept, fits)), 1, 1)
    first = F.transform(last, lambda s: F.struct(F.lit("summary").alias("field"), s["head"].alias("head"), F.substring(s["body"], 1, summary[1]).alias("text")))
    others = F.filter(kept, lambda s: ~fits(s)) if only_summary else kept
    return F.concat(first, F.transform(others, lambda s: _route(s["head"], s["body"], routes)))


def herbal_sections(sections: Column) -> Column:
    """``struct<synonyms, sections>`` of ruled sections: up to 20 synonyms of each synonym section, the others routed."""
    named = lambda s: F.lower(s["head"]).contains("synonym")
    split = lambda s: F.slice(F.filter(F.transform(F.split(s["body"], ","), stripped), lambda x: x != ""), 1, 20)
    return F.struct(F.flatten(F.transform(F.filter(sections, named), split)).alias("synonyms"), routed_sections(F.filter(sections, lambda s: ~named(s)), maps.HERBAL_ROUTES).alias("sections"))


def labelled_field(label: Column, text: Column) -> Column:
    """``struct<field, text>`` of a label of the pocket manual; an unknown one goes to generalities, named in brackets."""
    field = F.try_element_at(F.create_map(*[F.lit(x) for pair in maps.LABELS.items() for x in pair]), F.lower(label))
    return F.struct(F.coalesce(field, F.lit("generalities")).alias("field"), F.when(field.isNotNull(), text).otherwise(F.concat(F.lit("["), F.initcap(label), F.lit("] "), text)).alias("text"))


def anchored_field(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in maps.ANCHORS.items() for x in pair]), F.lower(label)), F.lit("generalities"))


def numbered_field(label: Column) -> Column:
    """The field of the whole label, else of its first two words, else of its first word, else generalities."""
    return F.coalesce(looked_up(label, maps.NUMBERED), F.lit("generalities"))


def chapter_field(number: Column) -> Column:
    out = F.lit("generalities")
    for span, field in maps.CHAPTERS.items():
        low, high = map(int, span.split("-"))
        out = F.when(number.between(low, high), field).otherwise(out)
    return out


def is_fact_sheet(heads: Column) -> Column:
    """Has a page one of the two headings that make it a record."""
    return F.arrays_overlap(heads, F.array(*[F.lit(h) for h in list(maps.FACTS)[:2]]))


def sections_or_body(sections: Column, body: Column, least: int = 300, most: int = 8000) -> Column:
    """The sections, else the whole body as one summary if it is longer than ``least``, else null."""
    whole = F.array(F.struct(F.lit("Summary").alias("head"), F.substring(body, 1, most).alias("body")))
    return F.when(F.size(sections) > 0, sections).when(F.length(body) > least, whole)


def joined_sections(sections: Column, separator: str = " ", most: int = 30_000) -> Column:
    """``array<struct<head, body>>``: the bodies of one heading strung together in order, cut to ``most``; headings in the order first seen."""
    heads = F.array_distinct(F.transform(sections, lambda s: s["head"]))
    return F.transform(heads, lambda h: F.struct(h.alias("head"), F.substring(F.array_join(F.transform(F.filter(sections, lambda s: s["head"] == h), lambda s: s["body"]), separator), 1, most).alias("body")))


def valid_payload(c: Column, required: tuple[str, ...] = ("messages", "model")) -> Column:
    """Is a text a JSON object in which none of the ``required`` keys is missing, null, false, 0 or ''."""
    parsed = F.try_parse_json(c)
    good = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    for key in required:
        value = F.to_json(F.try_variant_get(parsed, f"$.{key}", "variant"))
        good = good & F.coalesce(~value.isin("null", "false", "0", '""'), F.lit(False))
    return F.when(c.isNotNull(), good).otherwise(False)
