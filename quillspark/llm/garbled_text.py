"""Text decoded with the wrong character encoding (problem 2).

Garbled sequences are computed for every pair of encodings and matched with
one multi-pattern automaton; only matched spans are replaced.

*Sequences*: UTF-8 read as a single-byte encoding turns one character into two
or three; such a sequence hardly occurs in right text, so each match counts.
Matching is repeated, for text that was garbled twice, and sees through HTML
entities, for garbled text that was escaped afterwards.

*Single characters*: a single-byte encoding read as another swaps one
character for one, and the wrong one may be right elsewhere.  A match counts
only in a place where the character can't stand (``_out_of_place``): a capital
inside a small word, a sign between letters, a box-drawing sign, a letter of
another script inside a word; or where the corpus speaks for a swap: over all
texts it is counted how often each character stands between which kinds of
neighbours, and a suspect counts if a character that it may stand for is
``ODDS`` times as frequent between such neighbours as itself, and it is a letter
alone or the same encodings explain another suspect of the text.  Two letters
of one script aren't compared so, as rare letters of names are right.  The
encodings that explain all suspects of a text best are taken for its restoring.

*Losses*: U+FFFD, and what is left of a sequence whose unprintable characters
were dropped, are found but can't be restored from the sequence alone; the
latter are restored where only one character fits.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 bytes may have been read in.
READ_AS = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15", "cp1254", "koi8-r"]
#: (written in, read as) for single-byte encodings: all pairs, of equal evidence the first.
_USUAL = ["cp1252", "mac_roman", "cp437", "cp850"]
SWAPPED = sorted(((a, b) for a in READ_AS for b in READ_AS if a != b), key=lambda p: ("cp1252" not in p, sum(e not in _USUAL for e in p), [*_USUAL, *READ_AS].index(p[0]), [*_USUAL, *READ_AS].index(p[1])))
#: How many times as frequent in its place the right character must be.
ODDS = 30
#: Ranges of characters that prose may hold; control codes are what a first garbling left.
REPERTOIRE = [(0x80, 0x17F), (0x192, 0x192), (0x2C6, 0x2C6), (0x2DC, 0x2DC), (0x391, 0x3C9), (0x410, 0x44F), (0x401, 0x401), (0x451, 0x451), (0x2010, 0x2027), (0x2030, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2122), (0x2212, 0x221E), (0x2260, 0x2265), (0xFB01, 0xFB02)]
ROUNDS = 3
LOST = "�"
_ORDER = {p: k for k, p in enumerate(SWAPPED)}
_CONTROL = re.compile("[\x80-\x9f]")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def _read(raw: bytes, encoding: str) -> str:
    """As lenient readers do: a byte without a character becomes its control code."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _rank(c: str) -> int:
    """How usual a character is in European prose, 0 first."""
    if c in "–—‘’“”…©®°§¶½¼¾" or "ß" <= c <= "ÿ" and c != "÷" or c in "œ":
        return 0
    return 1 if c.isalpha() or "\xa0" <= c <= "ÿ" else 3 if c < "\xa0" else 2


def sequences() -> dict[str, str]:
    """Garbled sequence to right character; of several meanings the most usual holds."""
    found: dict[str, str] = {}
    right = [chr(c) for a, b in REPERTOIRE for c in range(a, b + 1) if chr(c).isprintable() or c < 0xA1 or c == 0xAD]
    for encoding in READ_AS:
        for c in right:
            seq = _read(c.encode(), encoding)
            if not (encoding == "cp1251" and c.lower() != c.upper() and "Ѐ" <= c <= "ӿ" and seq[1:].isalpha()):
                found[seq] = min(found.get(seq, c), c, key=_rank)
    return found


def swaps() -> dict[str, dict[tuple[str, str], str]]:
    """Wrong character to what it stands for, by pair of encodings."""
    found: dict[str, dict[tuple[str, str], str]] = {}
    for pair in SWAPPED:
        for b in range(0x80, 0x100):
            try:
                wrong, right = bytes([b]).decode(pair[1]), bytes([b]).decode(pair[0])
            except UnicodeDecodeError:
                continue
            if wrong != right and (right.isprintable() or right == "\xa0"):
                found.setdefault(wrong, {})[pair] = right
    return found


def shape(c: str) -> str:
    """The kind of a neighbour: blank or none, small letter, other letter, digit or sign."""
    if not c or c.isspace():
        return " "
    if c.isalpha():
        return "a" if c == c.lower() else "A"
    return "0" if c.isdigit() else "."


def _place(text: str, i: int) -> tuple[str, str, str]:
    return text[i], shape(text[i - 1 : i]), shape(text[i + 1 : i + 2])


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


class Garbled:
    """The automaton and its decisions; built once a task.  ``counts``: how often characters stand in which places."""

    def __init__(self, counts: dict[tuple[str, str, str], int] | None = None) -> None:
        self.swaps = swaps()
        self.counts = counts or {}
        self.machine = ahocorasick.Automaton()
        for seq, c in sequences().items():
            self.machine.add_word(seq, (len(seq), c))
        for c in self.swaps:
            if c not in self.machine:
                self.machine.add_word(c, (1, ""))
        self.machine.make_automaton()

    def likelier(self, text: str, i: int) -> set[tuple[str, str]]:
        """The pairs of encodings by which the suspect stands for a character ``ODDS`` times as frequent in its place."""
        c, left, right = _place(text, i)
        known = self.counts.get((c, left, right), 0) + 0.5
        compared = ((p, r) for p, r in self.swaps[c].items() if _script(r) != _script(c) or not r.isalpha() and not c.isalpha())
        return {p for p, r in compared if self.counts.get((r, left, right), 0) + 0.5 >= ODDS * known}

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[int]]:
        """Longest non-overlapping sequences, and where single suspects are."""
        seqs, single = [], []
        for end, (n, c) in self.machine.iter(text):
            (seqs if n > 1 else single).append((end - n + 1, end + 1, c))
        seqs.sort(key=lambda s: (s[0], -s[1]))
        kept: list[tuple[int, int, str]] = []
        for s in seqs:
            if kept and s[0] < kept[-1][1]:
                if s[1] - s[0] > kept[-1][1] - kept[-1][0]:
                    kept[-1] = s
            else:
                kept.append(s)
        inside = {i for a, b, _ in kept for i in range(a, b)}
        return kept, [a for a, _, _ in single if a not in inside]

    def odd(self, text: str, at: list[int]) -> list[int]:
        """Those of the suspects at ``at`` that can't stand where they are, or hardly do.

        What only the corpus speaks against counts if it is a letter alone
        between blanks, if the same encodings explain another suspect too, or if
        it may be the apostrophe of a possessive.
        """
        wrong = {i for i in at if _out_of_place(text, i)}
        hardly = {i: self.likelier(text, i) for i in at if i not in wrong}
        backed = Counter(p for pairs in hardly.values() for p in pairs)
        backed.update(p for i in wrong for p in self.swaps[text[i]])
        lone = lambda i: text[i].isalpha() and shape(text[i - 1 : i]) == " " == shape(text[i + 1 : i + 2])
        return [i for i in at if i in wrong or hardly[i] and (lone(i) or any(backed[p] > 1 for p in hardly[i])) or self._possessive(text, i)]

    def _possessive(self, text: str, i: int) -> bool:
        before = text[max(0, i - 3) : i]
        return text[i + 1 : i + 2] == "s" and not text[i + 2 : i + 3].isalpha() and len(before) == 3 and before.isascii() and before.isalpha() and "’" in self.swaps[text[i]].values()

    def _explains(self, text: str, i: int, right: str) -> float:
        """How well ``right`` explains a suspect: by its frequency in such places, and whether it may stand there at all."""
        return math.log(self.counts.get((right, *_place(text, i)[1:]), 0) + 0.5) + 3 * _fits(text, i, right)

    def restore(self, text: str) -> tuple[bool, str, bool]:
        """Is it a case; the text restored as far as it can be; wholly so."""
        case, whole = False, LOST not in text
        for _ in range(ROUNDS):
            plain, back = _unescaped(text)
            kept, _ = self.spans(plain)
            if not kept:
                break
            case = True
            for a, b, c in reversed(kept):
                text = text[: back[a]] + c + text[back[b] :]
        bad = self.odd(text, self.spans(text)[1])
        if bad:
            case = True
            votes: dict[tuple[str, str], list[float]] = {}
            for i in bad:
                for pair, right in self.swaps[text[i]].items():
                    votes.setdefault(pair, []).append(self._explains(text, i, right))
            best = max(votes, key=lambda p: (len(votes[p]), round(sum(votes[p]), 6), -_ORDER[p]))
            whole &= len(votes[best]) == len(bad) and all(_fits(text, i, self.swaps[text[i]][best]) == 2 for i in bad)
            chars = list(text)
            for i in bad:
                chars[i] = self.swaps[text[i]].get(best, text[i])
            text = "".join(chars)
        rest = _LEFT_OVER.search(text)
        if rest:
            case = True
            text = _LEFT_OVER.sub(lambda m: "’" if m.group(1) else "–", text)
        c1 = bool(_CONTROL.search(text))
        return case or c1 or LOST in text, text, whole and not c1


def _unescaped(text: str) -> tuple[str, list[int] | range]:
    """``text`` with entities resolved, and where each character began in it."""
    if "&" not in text:
        return text, range(len(text) + 1)
    out, back, last = [], [], 0
    for m in _ENTITY.finditer(text):
        c = html.unescape(m.group())
        if len(c) != 1 or ord(c) < 0x80:
            continue
        out.append(text[last : m.start()] + c)
        back += [*range(last, m.start() + 1)]
        last = m.end()
    out.append(text[last:])
    back += [*range(last, len(text) + 1)]
    return "".join(out), back


#: What is left of an apostrophe or a dash whose unprintable characters were dropped.
_LEFT_OVER = re.compile(r"(?:(?<=[A-Za-z]{3})(â)(?=s\b)|(?<!\S)â(?!\S))")


def _fits(text: str, i: int, right: str) -> int:
    """2 if ``right`` would be usual at ``i``: a small letter in a word, a sign outside or before a final s."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if right.isalpha():
        return 2 if right == right.lower() and (before.isalpha() or after.isalpha()) else 0
    return 0 if before.isalpha() and after.isalpha() and right != "’" else 2


def _out_of_place(text: str, i: int) -> bool:
    c, before, after = text[i], text[i - 1 : i], text[i + 1 : i + 2]
    inside = before.isalpha() and after.isalpha()
    if "─" <= c <= "▟" or c in "⌐⌠⌡₧":
        return True
    if c.isalpha() and c != c.lower() and c.lower() not in "ßʼn":
        latin = c < "ɐ"
        if latin:  # a capital after a small letter, or between a letter and a small letter
            return before.isalpha() and before == before.lower() and before.isascii() or inside and after.islower() and before.isascii()
    if "Ͱ" <= c <= "Ͽ" or "Ѐ" <= c <= "ӿ":
        return before.isascii() and before.isalpha() or after.isascii() and after.isalpha()
    if c in "ˆ˜":
        return before.isalpha() or after.isalpha()
    if c == "µ":
        return inside
    if c in "ⁿ":
        return before.isalpha()
    if not c.isalnum() or c in "³²¹":
        if c in "‘’·­°ªº‐‑–—…“” ":
            return False
        return inside or before.isalpha() and c in "´ˆ¸³‡˘˜˛" or after.isalpha() and c in "ˆ¸‡"
    return False


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``c, before, after, n``: how often characters that may be swapped, or stand for swapped ones, come in which places; garbled sequences don't count."""
    g = Garbled()
    wanted = {*g.swaps, *(r for s in g.swaps.values() for r in s.values())}
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            inside = {i for a, b, _ in g.spans(text)[0] for i in range(a, b)}
            seen.update(_place(text, i) for i, c in enumerate(text) if c in wanted and i not in inside)
    columns = list(zip(*seen)) or [(), (), ()]
    yield pa.record_batch([*(pa.array(c, pa.string()) for c in columns), pa.array(list(seen.values()), pa.int64())], names=["c", "before", "after", "n"])


def place_counts(texts: DataFrame) -> dict[tuple[str, str, str], int]:
    """The places of all texts; as many rows as characters that may be swapped (some 500) by 25 pairs of neighbours."""
    found = texts.mapInArrow(_places, "c string, before string, after string, n long").groupBy("c", "before", "after").agg(F.sum("n").alias("n"))
    return {(r.c, r.before, r.after): r.n for r in found.collect()}


def _run(counts: dict[tuple[str, str, str], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Garbled(counts)
        for batch in batches:
            ids, texts, wholes = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                case, fixed, whole = g.restore(text)
                if case:
                    ids.append(key)
                    texts.append(fixed)
                    wholes.append(whole)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(wholes, pa.bool_())], names=["id", "restored", "whole"])

    return run


def restored(df: DataFrame, key: str = "entry_id", text: str = "text") -> DataFrame:
    """``id, restored, whole`` of the records with garbled text, one row an id.

    ``whole`` is false where something stays lost.  Null and empty texts are no
    cases; a record delivered twice comes once; an empty table gives no rows.
    Plain ASCII texts without entities never leave the JVM.
    """
    some = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(r"id is not null and text rlike '[^\\x00-\\x7f]|&[A-Za-z#]'")
    return some.mapInArrow(_run(place_counts(some)), "id long, restored string, whole boolean").groupBy("id").agg(F.min_by("restored", F.struct("restored")).alias("restored"), F.min("whole").alias("whole"))
