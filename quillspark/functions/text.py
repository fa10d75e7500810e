"""Scalar text functions as Column expressions.

Null in, null out, unless said otherwise.  Only entity decoding, NFKD folding,
title case and exotic charsets leave the JVM, in Arrow batches.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quillspark.functions.field_maps import EVIDENCE_CUES


def squeeze(c: Column) -> Column:
    """White space (no-break spaces too) to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def words(c: Column, least: int = 3) -> Column:
    """The runs of ``least`` or more ASCII letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]{%d,}" % least), F.lit(0))


def kept_words(c: Column, stop: list[str], least: int = 3) -> Column:
    """``words`` without stop words; repeats and order stay."""
    listed = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.filter(words(c, least), lambda w: ~F.array_contains(listed, w))


def windows(tokens: Column, k: int) -> Column:
    """All runs of ``k`` neighbours as blank-joined strings; none if there are fewer."""
    n = F.size(tokens) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(F.array().cast("array<string>"))


@pandas_udf(T.StringType())
def fold_marks(s: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """HTML entities, the whole HTML5 table."""
    return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


@pandas_udf(T.StringType())
def title_case(s: pd.Series) -> pd.Series:
    """A capital after every sign that is no letter (``initcap`` only looks at blanks)."""
    return s.map(lambda x: x if x is None else x.title())


def decode_bytes(*charsets: str):
    """A function of binary columns: the first charset that fits; then the last one with replacement signs."""

    def read(b: bytes | None) -> str | None:
        if b is None:
            return None
        for name in charsets:
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(b).decode(charsets[-1], "replace")

    @pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(read)

    return run


#: How far a slug folds: nothing; marks; marks and ae; marks, ae and oe.
SLUG_MODES = ("plain", "marks", "ae", "oe")


def slug(c: Column, mode: str = "oe") -> Column:
    """Lower case, runs of other signs than a-z0-9 to one hyphen, none at the ends."""
    if mode not in SLUG_MODES:
        raise ValueError(f"mode is one of {SLUG_MODES}")
    if mode in ("ae", "oe"):
        c = F.regexp_replace(F.regexp_replace(c, "Æ", "AE"), "æ", "ae")
    if mode == "oe":
        c = F.regexp_replace(F.regexp_replace(c, "Œ", "OE"), "œ", "oe")
    if mode != "plain":
        c = fold_marks(c)
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def point_key(c: Column) -> Column:
    """The id that a requested id stands for."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9\-]", "")


def clean_escaped(c: Column) -> Column:
    """Entities first, then tags to nothing, then white space: escaped tags go too."""
    return squeeze(F.regexp_replace(decode_entities(c), "<[^>]+>", ""))


def clean_markup(c: Column, drop: tuple[str, ...] = ("script", "style")) -> Column:
    """Scripts and styles out, tags to blanks, then entities, then white space."""
    for tag in drop:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return squeeze(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")))


def links(c: Column) -> Column:
    """Targets of links in order, with repeats."""
    return F.regexp_extract_all(c, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))


def markup_title(c: Column, tag: str = "title", cut: str | None = None) -> Column:
    """What the first ``tag`` holds, cleaned; up to ``cut`` if given; '' if there is none."""
    inner = clean_markup(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))
    return inner if cut is None else squeeze(F.split_part(inner, F.lit(cut), F.lit(1)))


def paragraphs(c: Column, least: int = 4, skip: tuple[str, ...] = (r"^\* \* \*$", r"(?i)^related entries")) -> Column:
    """Cleaned texts of paragraphs with at least ``least`` characters, in order.  Entities stay; decode before or after."""
    raw = F.regexp_extract_all(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " "), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    cleaned = F.transform(raw, lambda p: squeeze(F.regexp_replace(p, "<[^>]+>", " ")))
    return F.filter(cleaned, lambda p: (F.length(p) >= least) & ~F.reduce(F.array(*[p.rlike(x) for x in skip]), F.lit(False), lambda a, x: a | x))


def headed_sections(c: Column, tag: str = "h2") -> Column:
    """``array<struct<head, body>>``: each heading with the markup up to the next one, cleaned but for entities."""
    heads = F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    bodies = F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>(.*?)(?=<{tag}\b|</main>|</body>|\z)"), F.lit(1))
    plain = lambda x: squeeze(F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]+>", " "))
    return F.transform(F.arrays_zip(heads.alias("h"), bodies.alias("b")), lambda x: F.struct(plain(x["h"]).alias("head"), plain(x["b"]).alias("body")))


def last_wins(sections: Column) -> Column:
    """Sections by head: a repeated head keeps its first place and takes its last body."""
    heads = F.array_distinct(F.transform(sections, lambda s: s["head"]))
    return F.transform(heads, lambda h: F.struct(h.alias("head"), F.element_at(F.filter(sections, lambda s: s["head"] == h), -1)["body"].alias("body")))


def labelled_sections(c: Column) -> Column:
    """``array<struct<label, text>>`` of ``Label.--text`` prose; what stands before the first label has label ''."""
    mark = r"([A-Z][A-Za-z ,]{1,30}?)\.\s*--"
    labels = F.regexp_extract_all(c, F.lit(mark), F.lit(1))
    rest = F.split(c, mark)
    first = F.get(labels, F.lit(0))
    body = F.transform(F.arrays_zip(labels.alias("l"), F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))).alias("t")), lambda x: F.struct(F.lower(F.regexp_extract(x["l"], "^([A-Za-z]+)", 1)).alias("label"), squeeze(x["t"]).alias("text")))
    intro = F.struct(F.lit("").alias("label"), squeeze(F.get(rest, F.lit(0))).alias("text"))
    return F.when(first.isNull(), F.array(intro)).otherwise(F.concat(F.array(intro), body))


def ruled_sections(c: Column) -> Column:
    """``array<struct<head, body>>`` of text with ``---Head---`` lines."""
    heads = F.regexp_extract_all(c, F.lit(r"---+\s*([^-\n]{2,60}?)\s*---+"), F.lit(1))
    rest = F.split(c, r"---+\s*[^-\n]{2,60}?\s*---+")
    return F.transform(F.arrays_zip(heads.alias("h"), F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))).alias("b")), lambda x: F.struct(squeeze(x["h"]).alias("head"), squeeze(x["b"]).alias("body")))


def numbered_items(c: Column, least: int = 6, most: int = 1499) -> Column:
    """Texts of ``1. …``/``2) …`` lines with a length from ``least`` to ``most``."""
    raw = F.regexp_extract_all(c, F.lit(r"(?ms)^\s*\d{1,4}[.)]\s+(.*?)(?=^\s*\d{1,4}[.)]\s|\z)"), F.lit(1))
    return F.filter(F.transform(raw, squeeze), lambda x: (F.length(x) >= least) & (F.length(x) <= most))


def bullets(c: Column, mark: str = r"─+", least: int = 1) -> Column:
    """Pieces between marks without blanks, stops, commas and semicolons around them."""
    return F.filter(F.transform(F.split(c, mark), lambda x: F.regexp_replace(x, r"(?U)^[\s.,;]+|[\s.,;]+$", "")), lambda x: F.length(x) >= least)


def between(c: Column, starts: list[str], ends: list[str]) -> Column:
    """From behind the first start marker found to the nearest end marker, or the end; '' without a start."""
    at = F.coalesce(*[F.when(F.locate(s, c) > 0, F.locate(s, c) + len(s)) for s in starts], F.lit(0))
    tail = F.substring(c, at, F.length(c))
    stops = [F.when(F.locate(e, tail) > 0, F.locate(e, tail) - 1) for e in ends]
    return F.when(at > 0, squeeze(F.substring(tail, F.lit(1), F.least(*stops, F.length(tail))))).otherwise("")


def modalities(c: Column) -> Column:
    """``array<struct<side, text>>`` of what follows each "better" and "worse"."""
    cut = r"(?is)\b(better|worse)\b(.*?)(?=\b(?:better|worse)\b|\z)"
    sides, texts = F.regexp_extract_all(c, F.lit(cut), F.lit(1)), F.regexp_extract_all(c, F.lit(cut), F.lit(2))
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"^[ .,;:\-]+|[ .,;:\-]+$", "")
    return F.filter(F.transform(F.arrays_zip(sides.alias("s"), texts.alias("t")), lambda x: F.struct(F.lower(x["s"]).alias("side"), trim(x["t"]).alias("text"))), lambda x: x["text"] != "")


#: The kinds of relationship and how each is introduced.
RELATIONS = {
    "complementary": r"complementary[^:]*:\s*([^.]+)",
    "antidoted_by": r"antidote(?:s)?(?:\s+to\s+it)?[^:]*:\s*([^.]+)",
    "follows_well": r"follows?\s+well[^:]*:\s*([^.]+)",
    "followed_well_by": r"followed\s+well\s+by[^:]*:\s*([^.]+)",
}


def relations(c: Column) -> Column:
    """Map of relationship kind to its named items; kinds without items are left out."""
    pieces = [x for kind, cut in RELATIONS.items() for x in (F.lit(kind), F.filter(F.transform(F.split(F.regexp_extract(c, "(?i)" + cut, 1), "[;,]"), lambda x: F.regexp_replace(x, r"^[ .,;]+|[ .,;]+$", "")), lambda x: x != ""))]
    return F.map_filter(F.create_map(*pieces), lambda _, v: F.size(v) > 0)


def evidence_rating(c: Column) -> Column:
    """The strength that the wording of findings claims; the first cue that fits decides, none and null are too few data."""
    out = None
    for rating, cue in EVIDENCE_CUES:
        out = F.when(F.lower(c).rlike(cue), rating) if out is None else out.when(F.lower(c).rlike(cue), rating)
    return out.otherwise("insufficient_data")


def routed(head: Column, routes: list[tuple[str, str]], default: str) -> Column:
    """The field of the first route whose text the lower-cased heading holds."""
    h = F.lower(head)
    out = None
    for part, field in routes:
        hit = h.contains(part)
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return F.lit(default) if out is None else out.otherwise(default)


def looked_up(c: Column, table: dict[str, str]) -> Column:
    """The exact entry, else that of the first two words, else of the first word, else null."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    w = F.split(squeeze(F.lower(c)), " ")
    return F.coalesce(F.try_element_at(entries, squeeze(F.lower(c))), F.try_element_at(entries, F.array_join(F.slice(w, 1, 2), " ")), F.try_element_at(entries, F.get(w, F.lit(0))))


def heading_line(c: Column) -> Column:
    """The first line that isn't blank if it is a heading: 4 to 59 characters, over 0.7 of its letters capitals; else ''."""
    line = squeeze(F.regexp_extract(c, r"(?s)\A\s*([^\r\n]*)", 1))
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(line, "[^A-Z]", ""))
    return F.when((F.length(line) > 3) & (F.length(line) < 60) & (capitals > 0.7 * letters), line).otherwise("")


def scanned_paragraphs(c: Column, least: int = 21) -> Column:
    """Paragraphs of scanned text: page numbers out, broken words mended, at least ``least`` characters."""
    numberless = F.regexp_replace(c, r"(?m)^\s*\d{1,4}\s*$", "")
    mended = F.regexp_replace(numberless, r"-\n\s*", "")
    return F.filter(F.transform(F.split(mended, r"\n\s*\n"), squeeze), lambda p: F.length(p) >= least)


def fence_stripped(c: Column) -> Column:
    """JSON without the Markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"^```\w*\n?", ""), r"\n?```$", "")


def label(c: Column) -> Column:
    """A key as a heading: ``mental_emotional`` to ``Mental Emotional``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def round_half_up(c: Column, places: int = 1) -> Column:
    """Exact half-up rounding of a decimal sum, as a double."""
    return F.round(c.cast("decimal(28,6)"), places).cast("double")
