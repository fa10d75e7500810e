"""Several values packed in one field (problem 5).

Each string is cut into tokens: a run of ordinary words with the blanks between
and the full stops behind them is one token, a delimiter with the blanks around
it another; a quoted value is one token, and what round brackets enclose belongs to
the run before.  The delimiter skeleton masks every run as ``w``, every quoted
value as ``q``, every delimiter that only parts as ``,`` and every number as
``0``, and keeps other brackets, single quotes, dashes and the few words that steer reading (linking words, labels, the
beginnings of remarks).  So strings of as many values in one style have one
skeleton, whatever the values are.

A splitting rule, the token ranges of the items, is worked out once for each
distinct skeleton.  The rules are broadcast if there are at most ``MOST_RULES``
of at most ``RULE_BYTES``, as a count of them shows; beyond that they are
joined on a hash of the skeleton, with the same result.  The ranges are cut out
of the tokens in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.scratch import materialize

#: Words that link the last values of a list.
LINKING = ["and", "or", "also", "as well as", "plus", "und", "oder", "et", "ou"]
#: Words of which a label or phrase before a list is made.
LABEL = "antidoted antidote antidotes by should follow follows followed well goes with is it compatible compat compare comp compares cf rel relations related inimical inimicals complementary complements see".split()
#: Words that an item begins with if it is a remark and names nothing.
REMARK = "none unknown nothing no not so see to".split()
STEERING = sorted({*" ".join(LINKING).split(), *LABEL, *REMARK})
#: Signs that part values wherever they stand outside of quotes and brackets: those of the keyboard, and all commas and semicolons of Unicode.
PARTING = "".join(
    c for c in map(chr, range(0x21, 0xFFFF)) if c in ",;|/&+¦•·—" or unicodedata.category(c)[0] in "PS" and (unicodedata.normalize("NFKC", c) in tuple(",;|/&+") or re.search(r"\b(COMMA|SEMICOLON)\b", unicodedata.name(c, "")))
)
#: Rules that are broadcast: so many, and so many bytes of skeletons and ranges.
MOST_RULES, RULE_BYTES = 50_000, 32_000_000
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
_BLANK = r"[ \x{00A0}]"
_WORD = rf"(?!(?i:{'|'.join(STEERING)})(?![\p{{L}}\p{{M}}'’-]))[\p{{L}}\p{{M}}]+(?:[-'’][\p{{L}}\p{{M}}]+)*"
_PARTS = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in PARTING) + "]"
_HELD = r"[^{0}{1}\r\n]*[\p{{L}}\p{{Nd}}][^{0}{1}\r\n]*"
_SIGNS = ('""', "“”", "«»")
_QUOTED = "|".join(f"{a}{_HELD.format(a, b)}{b}" for a, b in _SIGNS)
_UNQUOTED = "|".join(f"{a}({_HELD.format(a, b)}){b}" for a, b in _SIGNS)
_BRACKET = rf"{_BLANK}*\((?!\p{{Nd}}+\))[^()\r\n]*\)"
#: A quoted value, a run of ordinary words with what round brackets enclose, a parting sign with its blanks, a steering word, a number, blanks, a line, or one sign.
TOKEN = rf"(?U){_QUOTED}|{_WORD}(?:{_BLANK}+{_WORD}|{_BRACKET})*\.*|{_BLANK}*{_PARTS}{_BLANK}*|[\p{{L}}\p{{M}}]+|\p{{Nd}}+|{_BLANK}+|\r?\n|[^\p{{L}}\p{{Nd}}\s]|\s"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def skeleton(found: Column) -> Column:
    """One symbol a token: ``q`` a quoted value, ``w`` a run of up to four words, ``W`` a longer one, ``,`` a parting sign, ``0`` a number, else itself in lower case."""
    steering = F.array(*[F.lit(w) for w in STEERING])

    def mask(t: Column) -> Column:
        word = t.rlike(r"^[\p{L}\p{M}]")
        return (
            F.when(t.rlike(f"^(?:{_QUOTED})$"), F.lit("q"))
            .when(word & F.array_contains(steering, F.lower(t)), F.lower(t))
            .when(word, F.when(F.regexp_replace(t, _BRACKET, "").rlike(rf"(?:[^ \x{{00A0}}]+{_BLANK}+){{4}}[^ \x{{00A0}}]"), F.lit("W")).otherwise(F.lit("w")))
            .when(t.rlike(rf"^{_BLANK}*{_PARTS}"), F.lit(","))
            .when(t.rlike(r"^\p{Nd}"), F.lit("0"))
            .when(t.rlike(rf"^{_BLANK}+$"), F.lit(" "))
            .otherwise(t)
        )

    return F.transform(found, mask)


def rule(s: list[str]) -> list[tuple[int, int]]:
    """Token ranges (begin, end) of the items of a skeleton; fewer than two: no case.

    What quotes or round brackets enclose is one value; delimiters inside are
    ordinary signs there.
    """
    n = len(s)
    single = _single_quotes(s)
    lo, hi = 0, n
    while lo < hi and s[lo].isspace():
        lo += 1
    while hi > lo and (s[hi - 1].isspace() or s[hi - 1] in ".;,"):
        hi -= 1
    if hi - lo >= 2 and s[lo] in "[{" and s[hi - 1] in "]}":
        lo, hi = lo + 1, hi - 1
    parts: list[tuple[int, int]] = []
    begin = i = lo
    closing: list[str] = []
    quoted_before = False

    def close(end: int, after: int) -> None:
        nonlocal begin
        parts.append((begin, end))
        begin = after

    while i < hi:
        t = s[i]
        if closing:
            if t == closing[-1] and (t != "'" or i in single):
                closing.pop()
                quoted_before = t != ")"
            elif t == "(" and closing[-1] == ")":
                closing.append(")")
            i += 1
            continue
        if t == "q":
            if quoted_before and _only_quoted(s, begin, i):
                close(i, i)
            quoted_before = True
            i += 1
            continue
        if t in _QUOTES or t == "'" and i in single:
            want = _QUOTES.get(t, "'")
            if want in s[i + 1 : hi] and (want != t or s[i + 1 : hi].count(t)):
                if quoted_before and _only_quoted(s, begin, i):
                    close(i, i)  # one quoted value after another, with blanks between
                closing.append(want)
                i += 1
                continue
        if t == "(":
            number = i + 2 < hi and s[i + 1] == "0" and s[i + 2] == ")"
            if number:
                close(i, i + 3)
                i += 3
                continue
            if ")" in s[i + 1 : hi]:
                closing.append(")")
                i += 1
                continue
        if t == "0" and i + 1 < hi and s[i + 1] in ").:" and (i + 2 >= hi or s[i + 2].isspace()) and _blank(s, begin, i) | (i > lo and s[i - 1].isspace()):
            close(i, i + 2)  # numbering opens an item
            i += 2
            continue
        before, after = s[i - 1] if i > lo else " ", s[i + 1] if i + 1 < hi else " "
        dash = t in "-–*" and (before.isspace() and after.isspace() or before == "\n" or i > lo and s[i - 1] == t or after == t)
        if t in ",\t" or t == "\n" or t == "\r\n" or dash:
            close(i, i + 1)
            quoted_before = False
        elif t == ":":
            if _label(s[begin:i]):
                begin = i + 1
        elif t in LINKING and before.isspace() and after.isspace() and not _blank(s, begin, i):
            close(i, i + 1)
            quoted_before = False
        i += 1
    parts.append((begin, hi))
    items = [x for x in (_item(s, a, b, k == 0) for k, (a, b) in enumerate(_first_kept(s, parts))) if x]
    items = [x for x in items if not _remark(s, *x)]
    return items if len(items) >= 2 else []


def _first_kept(s: list[str], parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [p for p in parts if not _blank(s, *p)]


def _blank(s: list[str], a: int, b: int) -> bool:
    return all(t.isspace() for t in s[a:b])


def _only_quoted(s: list[str], a: int, b: int) -> bool:
    body = [t for t in s[a:b] if not t.isspace()]
    return bool(body) and (body[0] in _QUOTES or body[0] in "'q") and body[-1] in {*_QUOTES.values(), "'", "q"}


def _single_quotes(s: list[str]) -> set[int]:
    """Places of apostrophes that open or close a quoted value."""
    found = set()
    for i, t in enumerate(s):
        if t == "'":
            before, after = s[i - 1] if i else " ", s[i + 1] if i + 1 < len(s) else " "
            if not before[0].isalnum() or not after[0].isalnum():
                found.add(i)
    return found if len(found) >= 2 and len(found) % 2 == 0 else set()


def _label(s: list[str]) -> bool:
    words = [t for t in s if t[0].isalpha()]
    return bool(words) and len(words) <= 4 and not any(t in ("(", '"', "W", "q") for t in s)


def _item(s: list[str], a: int, b: int, first: bool) -> tuple[int, int] | None:
    """The range without blanks, numbering, label, linking word, quotes and full stops around it."""
    while True:
        while a < b and (s[a].isspace() or s[a] == ","):
            a += 1
        while b > a and (s[b - 1].isspace() or s[b - 1] in ".,;"):
            b -= 1
        if b - a >= 2 and (_QUOTES.get(s[a]) == s[b - 1] or s[a] == s[b - 1] == "'") and s[a] not in s[a + 1 : b - 1]:
            a, b = a + 1, b - 1
        elif b - a >= 2 and s[a] in "[{" and s[b - 1] in "]}":
            a, b = a + 1, b - 1
        elif a + 1 < b and s[a] in LINKING and s[a + 1].isspace():
            a += 1
        elif a < b and s[a] in "-–*•·":
            a += 1
        elif a + 1 < b and s[a] == "0" and s[a + 1] in ").:":
            a += 2
        elif first and a < b and s[a] in LABEL:
            k = a
            while k < b and (s[k] in LABEL or s[k].isspace() or s[k] in ".:"):
                k += 1
            if k == b:
                return None
            a = k
        else:
            return (a, b) if any(t[0].isalnum() for t in s[a:b]) else None


def _remark(s: list[str], a: int, b: int) -> bool:
    """Does an item begin as remarks do, or deny something."""
    words = [t for t in s[a:b] if t[0].isalpha()]
    return bool(words) and (words[0] in REMARK or "not" in words)


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(0).to_pylist()
        ranges = [[{"a": a, "n": b - a} for a, b in rule(s)] for s in found]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())]))
        yield pa.record_batch([pa.array(found, pa.list_(pa.string())), pa.array(ranges, kind)], names=["skeleton", "ranges"])


def skeletons(df: DataFrame, value: str = "value") -> DataFrame:
    """``skeleton, n`` of all strings: how many strings share each skeleton."""
    return df.where(F.col(value).isNotNull()).groupBy(skeleton(tokens(F.col(value))).alias("skeleton")).agg(F.count(F.lit(1)).alias("n"))


def split_packed(df: DataFrame, value: str = "value") -> DataFrame:
    """``df`` with ``pos, item``, one row for each value of strings that list two or more.

    Null, empty and single-valued strings, and remarks, give no rows; an empty
    table stays empty.  Other columns are kept, whatever their names, but a
    ``pos`` or ``item`` among them gives way.  Repeated rows repeat.
    """
    kept = [c for c in df.columns if c not in ("pos", "item")]
    cut = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), tokens(F.col(value)).alias("tokens"))
    cut = cut.withColumn("skeleton", skeleton(F.col("tokens"))).where(F.size("skeleton") > 2)
    rules = cut.select("skeleton").distinct().mapInArrow(_rules, "skeleton array<string>, ranges array<struct<a:int,n:int>>").where(F.size("ranges") >= 2)
    rules = materialize(rules.withColumn("hash", F.xxhash64("skeleton")), "rules")
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("skeleton") * 8 + F.size("ranges") * 8), F.lit(0)).alias("bytes")).first()
    small = size.n <= MOST_RULES and size.bytes <= RULE_BYTES
    joined = cut.withColumn("hash", F.xxhash64("skeleton")).join(F.broadcast(rules) if small else rules, ["hash", "skeleton"])
    out = joined.select("row", "tokens", F.posexplode("ranges").alias("pos", "range"))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|[\s.]+$", "")
    item = bare(F.regexp_replace(bare(F.array_join(F.slice("tokens", F.col("range.a") + 1, F.col("range.n")), "")), f"^(?:{_UNQUOTED})$", "$1$2$3"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "pos", item.alias("item"))


def relationship_strings(records: DataFrame) -> DataFrame:
    """``rec_id, field, elem, value`` of the strings of ``_raw`` and ``antidoted_by``."""
    lists = [F.struct(F.lit(f).alias("field"), F.from_json(F.get_json_object("traditional", f"$.relationships.{f}"), "array<string>").alias("v")) for f in ("_raw", "antidoted_by")]
    long = records.where("traditional is not null").select("rec_id", F.explode(F.array(*lists)).alias("x")).select("rec_id", "x.field", F.posexplode("x.v").alias("elem", "value"))
    return long.where("value is not null").dropDuplicates(["rec_id", "field", "elem"])


def split_relationships(records: DataFrame) -> DataFrame:
    """``rec_id, field, elem, pos, item`` of the packed relationship strings."""
    return split_packed(relationship_strings(records)).drop("value")
