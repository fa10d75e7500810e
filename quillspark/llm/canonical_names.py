"""Free-entered names mapped to a reference list (problem 1).

1. A multi-pattern automaton over the canonical names and aliases finds the
   names embedded in a value.  It runs on letters and digits alone, so broken,
   glued and hyphened names match; a match must begin and end where a word of
   the value does, the longest non-overlapping match wins, and what is left
   over may only be words that qualify a name (``QUALIFIERS``).
2. What remains goes to token-set similarity: each word is resolved to the
   nearest words of the list (confusable characters cost half an edit), an
   inverted index of the words of all listed names gives every name that shares
   one, and names are scored by the weight of the shared words (rare ones weigh
   more, bent ones less) over that of all words of both.  The best from
   ``ENOUGH`` on is taken, whatever the order and number of words.  A word that
   is listed itself is never bent, so an unlisted species of a listed genus
   stays unmatched.  Names broken in the wrong place are compared as one run.

A bare genus means its one listed species, an abbreviated genus the one whose
name it begins.  A value that fits several entries equally is unmatched.

The list is broadcast; ``MOST_REFERENCES`` bounds it.  Only distinct values
are looked up, so a value that a third of the rows hold costs one look-up.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_REFERENCES = 200_000
#: Aliases of all entries together; the list is broadcast.
MOST_ALIASES = 1_000_000
#: Least similarity of word sets, and what an edit takes from a word's weight.
ENOUGH, EDIT_COST = 0.72, 0.12
#: Words that qualify a remedy's name without changing it.
QUALIFIERS = frozenset("the true common a an of fens sic tinctura tinct tinctures tincture fresh plant potency dilution extr extract root herb leaf bark flower seed n o".split())
#: A potency, or a natural order after "N. O.".
_POTENCY = re.compile(r"\d+(?:x|c|ch|d|m|k|lm)?$|[a-z]+aceae$")
_TOKEN = re.compile(r"[^\W_]+")
#: Characters that are taken for one another in scans, as (seen, stands for).
CONFUSED = [("vv", "w"), ("rn", "m"), ("cl", "d"), ("0", "o"), ("1", "l"), ("!", "l"), ("|", "l"), ("i", "l"), ("5", "s"), ("$", "s"), ("8", "b"), ("e", "c"), ("v", "u"), ("h", "n"), ("6", "b"), ("9", "g"), ("3", "c")]


def fold(value: str) -> str:
    """Lower case without accents; apostrophes vanish, scanned signs inside words stay."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(c))
    plain = re.sub(r"['’‘`´ʼ]", "", plain.replace("æ", "ae").replace("œ", "oe"))
    return re.sub(r"(?<=[a-z])[!|$](?=[a-z])", lambda m: {"!": "i", "|": "l", "$": "s"}[m.group()], plain)


def shape(word: str) -> str:
    """The word with confusable characters made one."""
    for seen, meant in CONFUSED:
        word = word.replace(seen, meant)
    return word


def distance(a: str, b: str, most: float) -> float:
    """Edits (a swap of neighbours is one) between words; more than ``most`` comes as infinite."""
    if abs(len(a) - len(b)) > most:
        return float("inf")
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row = row, [float(i)]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return float("inf")
        before = last
    return row[-1] if row[-1] <= most else float("inf")


def _deletes(word: str, most: int) -> set[str]:
    found = {word}
    level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found |= level
    return found


def _trigrams(word: str) -> set[str]:
    return {word[i : i + 3] for i in range(len(word) - 2)}


class Names:
    """Look-ups in one reference list; built once a task."""

    def __init__(self, entries: list[tuple[int, str | None, str | None, list | None, list | None]]) -> None:
        self.exact: set[str] = set()
        self.runs: dict[str, set[int]] = defaultdict(set)
        self.sets: dict[frozenset, set[int]] = defaultdict(set)
        self.short: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.genera: dict[str, set[int]] = defaultdict(set)
        self.species: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.words: set[str] = set()
        for ref, latin, abbreviation, common, synonyms in entries:
            aliases = [latin, *(synonyms or [])]
            self.exact |= {x for x in (latin, abbreviation, *(common or []), *(synonyms or [])) if x}
            for name in filter(None, aliases):
                words = _TOKEN.findall(fold(name))
                if len(words) >= 2:
                    self.genera[words[0]].add(ref)
                    self.species[words[1]].append((words[0], ref))
            for name in filter(None, [*aliases, *(common or [])]):
                words = _TOKEN.findall(fold(name))
                if words:
                    self.runs["".join(words)].add(ref)
                    self.sets[frozenset(words)].add(ref)
                    self.words.update(words)
                    if len(words) == 2:
                        self.runs["".join(reversed(words))].add(ref)
            if abbreviation:
                self.short[tuple(_TOKEN.findall(fold(abbreviation)))].add(ref)
        for genus, refs in self.genera.items():
            self.runs.setdefault(genus, set()).update(refs)
        self.machine = ahocorasick.Automaton()
        for run in self.runs:
            self.machine.add_word(run, run)
        if self.runs:
            self.machine.make_automaton()
        self.near: dict[str, set[str]] = defaultdict(set)
        self.shapes: dict[str, set[str]] = defaultdict(set)
        for word in self.words:
            self.shapes[shape(word)].add(word)
            for part in _deletes(word, 1 if len(word) < 6 else 2):
                self.near[part].add(word)
        self.grams: tuple[dict[str, list[str]], ...] = (defaultdict(list), defaultdict(list))  # of runs and of their shapes
        for run in self.runs:
            for grams, form in zip(self.grams, (run, shape(run))):
                for g in _trigrams(form):
                    grams[g].append(run)
        self.lone = {g: refs for g, refs in self.genera.items() if len(refs) == 1 and frozenset([g]) not in self.sets}
        self.having: dict[str, list[frozenset]] = defaultdict(list)
        for words in self.sets:
            for word in words:
                self.having[word].append(words)
        self.weight = {w: math.log(1 + len(self.sets) / len(s)) for w, s in self.having.items()}
        self.unknown = math.log(1 + len(self.sets))

    def resolve(self, word: str) -> tuple[float, set[str]]:
        """The nearest listed words."""
        if word in self.words:
            return 0.0, {word}
        best, found = 3.0, set()
        for w in self.shapes.get(shape(word), ()):
            best, found = 0.5, found | {w}
        if found:
            return best, found
        for part in _deletes(word, 1 if len(word) < 6 else 2):
            for w in self.near.get(part, ()):
                d = min(distance(word, w, 2), distance(shape(word), shape(w), 2) + 0.5)
                if d < best:
                    best, found = d, {w}
                elif d == best:
                    found = found | {w}
        return best, found

    def embedded(self, words: list[str]) -> int | None:
        """The one entry whose name is in the value, if the rest only qualifies it."""
        run = "".join(words)
        starts, ends, at = {}, {}, 0
        for k, w in enumerate(words):
            starts[at] = k
            at += len(w)
            ends[at] = k
        spans = []
        for end, name in self.machine.iter(run) if self.runs else ():
            a, b = end + 1 - len(name), end + 1
            if a in starts and b in ends:
                spans.append((a, b, name))
        spans.sort(key=lambda s: (s[0] - s[1], s[0]))
        kept: list[tuple[int, int, str]] = []
        for s in spans:
            if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
                kept.append(s)
        if not kept:
            return None
        used = {k for a, b, _ in kept for k in range(starts[a], ends[b] + 1)}
        if any(w not in QUALIFIERS and not _POTENCY.match(w) for k, w in enumerate(words) if k not in used):
            return None
        refs = set.intersection(*(self.runs[name] for _, _, name in kept))
        return refs.pop() if len(refs) == 1 else None

    def shortened(self, raw: str, words: list[str]) -> int | None:
        """An abbreviation written loosely, or an abbreviated genus with its species."""
        refs = self.short.get(tuple(words), set())
        if len(refs) == 1:
            return next(iter(refs))
        words = [w for w in words if len(w) > 3 or w not in QUALIFIERS]
        if len(words) == 2 and len(words[0]) <= 6 and re.match(r"\W*[^\W_]+\s*\.", raw):
            _, epithets = self.resolve(words[1])
            fit = {ref for e in epithets for genus, ref in self.species.get(e, ()) if genus.startswith(words[0])}
            if len(fit) == 1:
                return fit.pop()
        return None

    def close(self, run: str, edits: int) -> set[str]:
        """All listed runs within so many edits of ``run``, by letters or by shape, and some others.

        An edit spoils three trigrams, a swap of neighbours four.
        """
        found: set[str] = set()
        for grams, form in zip(self.grams, (run, shape(run))):
            own = _trigrams(form)
            need = len(own) - 4 * edits
            if need <= 0:
                return set(self.runs)
            tally: dict[str, int] = defaultdict(int)
            for g in own:
                for name in grams.get(g, ()):
                    tally[name] += 1
            found.update(n for n, k in tally.items() if k >= need)
        return found

    def nearest_set(self, options: list[tuple[float, set[str]]]) -> tuple[float, set[int]]:
        """The best similarity of the resolved words to a listed name, and the entries that all names of that similarity have in common."""
        got: dict[frozenset, dict[str, float]] = defaultdict(dict)
        for edits, near in options:
            for word in near:
                for names in self.having[word]:
                    got[names][word] = max(got[names].get(word, 0.0), 1 - EDIT_COST * edits)
        best, refs = 0.0, set()
        if len(options) == 1:  # a genus alone means its one species
            edits, near = options[0]
            for genus in near & self.lone.keys():
                best, refs = round(1 - EDIT_COST * edits, 6), refs & self.lone[genus] if refs else set(self.lone[genus])
        for names, shared in got.items():
            stray = sum(max((self.weight[w] for w in near), default=self.unknown) for _, near in options if not near & names)
            score = round(sum(self.weight[w] * x for w, x in shared.items()) / (sum(self.weight[w] for w in names) + stray), 6)
            if score > best:
                best, refs = score, set(self.sets[names])
            elif score == best:
                refs = refs & self.sets[names]
        return best, refs

    def similar(self, words: list[str]) -> int | None:
        """The listed name whose word set is nearest."""
        words = [w for w in words if w not in QUALIFIERS and not _POTENCY.match(w)] or words
        options = [self.resolve(w) for w in words]
        best, refs = self.nearest_set(options)
        if best >= ENOUGH:
            return refs.pop() if len(refs) == 1 else None
        if len(words) > 1 and all(near for _, near in options) and (len(words) == 2 or not any(edits for edits, _ in options)):
            return None  # its words are listed, their set isn't
        run = "".join(words)
        best, refs = 2.5, set()
        for name in self.close(run, min(2, len(run) // 6)):
            d = min(distance(run, name, 2), distance(shape(run), shape(name), 2) + 0.5)
            if d < best:
                best, refs = d, set(self.runs[name])
            elif d == best and refs:
                refs &= self.runs[name]
                if not refs:
                    best, refs = d, set()
        return refs.pop() if len(refs) == 1 and best <= min(2.5, len(run) / 6) else None

    def match(self, value: str) -> int:
        """The entry meant, or -1."""
        words = _TOKEN.findall(fold(value))
        if not words or not any(len(w) > 1 for w in words) and len(words) < 5:
            return -1
        for found in (self.embedded(words), self.shortened(value, words), self.similar(words)):
            if found is not None:
                return found
        return -1


def _names_of(key: str, entries: list[tuple]) -> Names:
    """Built once a worker process, which keeps those of one list."""
    known = ahocorasick.__dict__.setdefault("_quillspark_names", {})
    if key not in known:
        known.clear()
        known[key] = Names(entries)
    return known[key]


def _lookup(key: str, entries: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names_of(key, entries)
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array(values, pa.string()), pa.array([names.match(v) for v in values], pa.int32())], names=["value", "ref_id"])

    return run


def map_names(values: DataFrame, reference: DataFrame, value: str | Column = "value") -> DataFrame:
    """``value, ref_id`` of each distinct value; -1 where the list doesn't hold it.

    ``reference`` has ``ref_id, latin, abbreviation, common, synonyms``.  Null
    and blank values, and values that a reference name equals character for
    character, have no row: they need no mapping.  An empty list maps all
    to -1.
    """
    several = F.greatest(F.size("common"), F.lit(0)) + F.greatest(F.size("synonyms"), F.lit(0)) + 2
    size = reference.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(several), F.lit(0)).alias("aliases")).first()
    if size.entries > MOST_REFERENCES or size.aliases > MOST_ALIASES:
        raise ValueError(f"the reference list has more than {MOST_REFERENCES} entries or {MOST_ALIASES} names; split it")
    entries = [tuple(r) for r in reference.select("ref_id", "latin", "abbreviation", "common", "synonyms").collect()]
    listed = reference.select(F.explode(F.concat(F.array("latin", "abbreviation"), F.coalesce("common", F.array().cast("array<string>")), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("value")).where("value is not null").distinct()
    parts = max(values.sparkSession.sparkContext.defaultParallelism, 12)  # little data, much work a row
    todo = values.select((F.col(value) if isinstance(value, str) else value).alias("value")).where(r"value rlike '(?U)[^\\s]'").repartition(parts, "value").distinct().join(F.broadcast(listed), "value", "left_anti")
    return todo.mapInArrow(_lookup(uuid.uuid4().hex, entries), "value string, ref_id int")


def record_names(records: DataFrame) -> DataFrame:
    """``rec_id, field, pos, value`` of the names of records, one row a name."""
    once = records.select("rec_id", F.col("names.latin").alias("latin"), F.col("names.common").alias("common"))
    latin = once.select("rec_id", F.lit("latin").alias("field"), F.lit(0).alias("pos"), F.col("latin").alias("value"))
    common = once.select("rec_id", F.lit("common").alias("field"), F.posexplode("common").alias("pos", "value"))
    return latin.union(common).where("value is not null").distinct()


def mapped_names(records: DataFrame, reference: DataFrame) -> DataFrame:
    """``rec_id, field, pos, ref_id`` of the names of ``records`` that need mapping."""
    names = record_names(records)
    return names.join(map_names(names, reference), "value").select("rec_id", "field", "pos", "ref_id").distinct()
