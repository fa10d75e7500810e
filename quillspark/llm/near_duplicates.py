"""Near-duplicate records with small edits (problem 4).

A text is the set of its distinct words, each a 32-bit hash.  Its digest is a
row of positional bytes: a word's hash names a position and a byte, and the
bytes of one position are summed up modulo 256.  So a word that only one of two
texts has spoils at most one position, and texts of ``n`` and ``m`` words with
Jaccard similarity ``t`` or more, which differ in at most
``(1 - t) / (1 + t) * (n + m)`` words, are *guaranteed* to share at least

    positions - (1 - t) / (1 + t) * (n + m)

positional bytes (``least_shared``).  Pairs that meet in the index are tallied
on their bytes, those that reach the minimum are kept and verified on the exact
word sets.  The number of positions grows with the size class of the larger
text, so that the minimum is always above zero.

Lists of single positional bytes would hold 1/256 of all texts each.  The
inverted index is therefore over the four bytes of a word's hash, and holds only
the postings at which a pair beyond the bound can meet *first*: words are put
in one global order, rarest first; if a text's word has ``r`` words from it to
the end, then partners that meet there first share at most ``r`` words, which
bounds their size (``reach``).  A pair is tallied only where each is within the
other's reach.

With a vocabulary that doesn't grow, all but names are frequent in the end, and
such lists grow with the texts.  In the first size class only *rare* words, of
``FEW`` texts at most, are therefore keys of their own.  *Middle* words are keys
by twos.  A pair that has no rare word and at most one middle word in common
differs in all the others, which leaves

    (1 - t) / (1 + t) * (n + m) - rare - middle + 2

differences for the *frequent* words: the sum of a ``slack`` of either text.
They are dealt by hash into two parts more than that; two parts at least are the
same in both texts, and a part is a key, or the first two that are the same
where a part has over ``FEW`` texts.  Texts are grouped by slack, and each meets
those of its own group and of the groups of more slack.

Lists that are longer than ``HOT`` all the same, and long lists of long texts,
are cut into blocks that meet two by two, so no task holds a list of any length.

Nothing is lost: a pair has a rare word, two middle words or two parts in
common, both texts post the first of them, and neither the reach nor the minimum
of shared bytes excludes a pair within the bound.  What counts as rare, middle
or frequent only decides how much is tallied; it comes from a table of counts of
fixed size.  Precision is exact but for 32-bit word hashes.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.scratch import drop, materialize, release

#: Positions of the digest of texts of up to ``CLASS_WORDS`` words; both double from class to class.
POSITIONS, CLASS_WORDS = 96, 160
#: A longer list of texts is cut into blocks.  With two levels the keys of the first size class are refined; a long text has
#: too many pairs of words.
HOT, LEVELS = 20_000, 2
#: Rare words have so many texts at most, middle words this share of all; longer lists of parts are refined.
FEW, MIDDLE = 4_000, 0.002
#: Groups of texts by slack end at these quantiles of it.
GROUPS = (0.3, 0.7, 0.95, 0.999, 1)
#: Slots of the tables of counts: so many, and more (up to ``MOST_SLOTS``, 256 MB) as the postings outgrow them.
SLOTS, MOST_SLOTS = 1 << 20, 1 << 26
#: The index is built and tallied in turns, so many or more, so that the disk holds one turn: this many times the bytes of the words.
TURNS, TURN_SIZE = 6, 1.8
PART_BYTES = 48_000_000
#: Groups of so many texts are tallied in blocks of so many rows, smaller ones all together.
GROUP, ROWS = 48, 256
#: Keys of so many texts are made at once.
TEXTS = 1_000
#: Copies of one text, or members of one side of a pair, that are joined in one task.
COPIES = 1_000


def _not_words() -> str:
    """Code points that ``\\w`` takes for a letter or digit though they are other numbers."""
    odd = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and unicodedata.category(chr(c))[0] == "N" and unicodedata.category(chr(c)) != "Nd"]
    spans: list[list[int]] = []
    for c in odd:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


WORD = re.compile(f"[^\\W_{_not_words()}]+")
_FAST = re.compile(r"[^\W_]+")
_ASCII = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def words_of(text: str) -> set:
    """The distinct words of a text; ``bytes`` where it is plain ASCII."""
    text = text.lower()
    if text.isascii():
        return set(text.encode().translate(_ASCII).split())
    found = set(_FAST.findall(text))
    odd = [w for w in found if not w.isascii()]
    return found.difference(odd).union(*map(WORD.findall, odd))


class _WordHash(dict):
    """32-bit hashes of words, kept while a bounded number is known."""

    def __missing__(self, word) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) & 0xFFFFFFFF
        return value


def _word_sets(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            ids, docs, sets = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < least:
                    continue
                found = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                found.sort()
                raw = found.tobytes()
                ids.append(key)
                docs.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                sets.append(raw)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], names=["id", "doc", "words"])

    return run


def word_sets(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """``id, doc, words`` of the texts with at least ``least`` distinct words.

    ``doc`` names the word set itself, so copies share it.  Null and empty
    texts have no words and drop out; a repeated (key, text) row repeats.
    """
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").mapInArrow(_word_sets(least), "id long, doc long, words binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _rest(x: np.ndarray, by: int) -> np.ndarray:
    """``x % by``, for which numpy divides one by one."""
    by = x.dtype.type(by)
    return x - x // by * by


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return (_mixed(keys) & np.uint64(slots - 1)).astype(np.int64)


def _tallied(found: DataFrame, slots: int, above: int = 1, times: int = 1) -> tuple[np.ndarray, int]:
    """The counts ``slot, n`` of all tasks as one table of fixed size, and their sum; counts up to ``above`` become 1.  All are taken ``times``."""
    table = found.groupBy("slot").agg((F.sum("n") * times).alias("n")).where(f"n > {above} or slot < 0").toArrow()
    slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
    counts = np.ones(slots, np.uint32)
    counts[slot[slot >= 0]] = np.minimum(n[slot >= 0], 0xFFFFFFFF)
    return counts, int(n[slot < 0].sum())


def _count(keys_of, slots: int):
    """``slot, n`` of the keys of a task, folded batch by batch; slot -1 has all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            counts += np.bincount(_slot(keys_of(batch), slots), minlength=slots)
        at = np.flatnonzero(counts)
        for part in np.array_split(at, len(at) // 100_000 + 1):
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], names=["slot", "n"])
        yield pa.record_batch([pa.array([-1], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["slot", "n"])

    return run


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of the sets one after another, and the size of each set."""
    if not len(sets):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    _, ends, raw = (sets := sets.cast(pa.large_binary())).buffers()
    ends = np.frombuffer(ends, np.int64)[sets.offset : sets.offset + len(sets) + 1]
    words = np.frombuffer(raw or b"", np.uint8)[ends[0] : ends[-1]]
    return words.view(np.uint32), np.diff(ends) // 4


def _ordered(counts: np.ndarray, few: int, middle: float):
    """Puts the words of each set in the global order: rarest first, ties by hash.  How many are rare, and how many rare or middle."""
    rank = (np.log2(counts, dtype=np.float64) * 2000).astype(np.uint16)
    ends_at = (np.log2([few, max(few, middle)]) * 2000).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 5_000) for i in range(0, batch.num_rows, 5_000)):
                words, n = _flat(part.column(1))
                owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                placed = np.sort(owner << np.uint64(48) | rank[_slot(words, len(counts))].astype(np.uint64) << np.uint64(32) | words)
                words, at, ends = placed.astype(np.uint32), placed >> np.uint64(32) & np.uint64(0xFFFF), np.cumsum(n)
                upto = [pa.array(np.bincount(owner[at <= k].astype(np.int64), minlength=len(n)), pa.int32()) for k in ends_at]
                yield pa.record_batch([part.column(0), pa.array([words[e - k : e].tobytes() for e, k in zip(ends, n)], pa.binary()), *upto], names=["doc", "words", "rare", "known"])

    return run


class Postings:
    """The index keys of texts whose words lie in the global order.

    ``tables`` has the counts of the keys of each level, as far as they are known; ``groups`` the most slack of each group.
    """

    def __init__(self, share: float, least: int, hot: int = HOT, levels: int = LEVELS, tables: list[np.ndarray] | None = None, groups: list[float] | None = None) -> None:
        self.part, self.share, self.least, self.hot, self.levels, self.tables = share / (1 + share), share, least, hot, levels, tables or []
        self.few, self.groups = min(FEW, hot), groups or []

    def _reach(self, rest: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The size of the largest partner that may share ``rest`` words."""
        return np.floor(rest / self.part + 1e-9).astype(np.int64) - n

    def _smallest(self, n: np.ndarray) -> np.ndarray:
        return np.maximum(self.least, np.ceil(self.share * n - 1e-9).astype(np.int64))

    def levels_of(self, cls: int) -> int:
        return self.levels if cls == 0 else 1

    def slack(self, n: np.ndarray, known: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """A text's part in the differences left to frequent words where a pair shares no rare and at most one middle word."""
        return (1 - 2 * self.part) * n - known + np.minimum(middle, 1) + 1e-9

    def words(self, words: np.ndarray, n: np.ndarray, upto: np.ndarray | None = None, since: np.ndarray | None = None, mine=None) -> tuple[np.ndarray, ...]:
        """Key, text, reach and place of the words at which a pair may meet first; ``since``, ``upto``: of these words of each text, ``mine``: of these keys."""
        smallest, start = self._smallest(n), 0 if since is None else since
        # the last places are cut exactly below
        last = np.minimum(n, np.maximum(0, n - np.floor(self.part * (n + smallest)).astype(np.int64) + 1))
        more = np.maximum(0, (last if upto is None else np.minimum(last, upto)) - start)
        doc = np.repeat(np.arange(len(n)), more)
        at = np.arange(len(doc)) - (np.cumsum(more) - more - start)[doc]
        key = words[(np.cumsum(n) - n)[doc] + at].astype(np.uint64)
        if mine is not None:
            use = mine(key)
            key, doc, at = key[use], doc[use], at[use]
        reach = self._reach(n[doc] - at, n[doc])
        use = reach >= smallest[doc]
        return key[use], doc[use], reach[use], at[use]

    def _middles(self, words: np.ndarray, n: np.ndarray, rare: np.ndarray, known: np.ndarray, mine) -> tuple[np.ndarray, ...]:
        """Keys of the first two middle words that a pair may have in common."""
        key, doc, _, at = self.words(words, n, known, rare)
        more = known[doc] - 1 - at
        who = np.repeat(np.arange(len(key)), more)
        at = at[who] + 1 + np.arange(len(who)) - np.repeat(np.cumsum(more) - more, more)
        doc = doc[who]
        key = _mixed(key[who] + np.uint64(1)) + words[(np.cumsum(n) - n)[doc] + at]
        if mine is not None:
            use = mine(key)
            key, doc, at = key[use], doc[use], at[use]
        reach = self._reach(n[doc] - at + 1, n[doc])
        use = reach >= self._smallest(n)[doc]
        return key[use], doc[use], reach[use]

    def _parts(self, words: np.ndarray, n: np.ndarray, rare: np.ndarray, known: np.ndarray, only: bool, mine=None) -> Iterator[tuple[np.ndarray, ...]]:
        """Keys of the parts of the frequent words, for each group of slack; below zero the reach of texts of less slack, which don't meet each other.  ``only``: before any refining."""
        middle = known - rare
        slack, reach = self.slack(n, known, middle), self._reach(n - known + np.minimum(middle, 1), n)
        # the texts of a group are those whose slack is between most and -most: the first in this order
        order = np.flatnonzero(reach >= self._smallest(n))
        order = order[np.argsort(np.abs(slack[order]), kind="stable")]
        far, more = np.abs(slack[order]), (n - known)[order]
        ends, owner = np.cumsum(more), np.repeat(np.arange(len(order)), more)
        words = words[np.arange(len(owner)) + np.repeat((np.cumsum(n) - n + known)[order] - (ends - more), more)]
        value = _mixed(words + np.uint64(1 << 40)) | np.uint64(1)
        dealt = _mixed(words + np.uint64(1 << 41)) >> np.uint64(20)
        below = -np.inf
        for most in self.groups:
            parts = int(2 * most) + 2
            here = order[: np.searchsorted(far, most, "right")]
            upto = ends[len(here) - 1] if len(here) else 0
            keys = np.zeros(len(here) * parts, np.uint64)
            np.add.at(keys, owner[:upto] * parts + _rest(dealt[:upto], parts).astype(np.int64), value[:upto])
            keys = _mixed(keys.reshape(len(here), parts) + _mixed(np.arange(parts) + (parts << 20) + (1 << 50)))
            # the first same part, and the second, come so late at most
            last = np.floor(slack[here] + most).astype(np.int64)
            met = np.where(slack[here] > below, reach[here], -reach[here])
            below = most
            row, first = np.nonzero(np.arange(parts) <= last[:, None])
            key = keys[row, first]
            if only or not self.tables:
                yield key, here[row], met[row]
                continue
            hot = self.tables[0][_slot(key, len(self.tables[0]))] > self.few
            use = ~hot if mine is None else ~hot & mine(key)
            yield key[use], here[row[use]], met[row[use]]
            row, first = row[hot], first[hot]
            more = last[row] + 1 - first
            who = np.repeat(np.arange(len(row)), more)
            second = first[who] + 1 + np.arange(len(who)) - np.repeat(np.cumsum(more) - more, more)
            row, first = row[who], first[who]
            key = _mixed(keys[row, first] + np.uint64(1)) + keys[row, second]
            if mine is not None:
                use = mine(key)
                key, row = key[use], row[use]
            yield key, here[row], met[row]

    def keys(self, words: np.ndarray, n: np.ndarray, rare: np.ndarray, known: np.ndarray, levels: int, mine=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, text and reach of the postings of all texts; ``mine`` tells which keys are asked for."""
        if levels == 1:
            return self.words(words, n, mine=mine)[:3]
        found, ends = [], np.concatenate(([0], np.cumsum(n)))
        # few texts at a time, so that the arrays stay in the cache
        for a in range(0, max(1, len(n)), TEXTS):
            b = min(a + TEXTS, len(n))
            some = words[ends[a] : ends[b]], n[a:b], rare[a:b], known[a:b]
            for key, doc, reach in (self.words(*some[:3], mine=mine)[:3], self._middles(*some, mine), *self._parts(*some, False, mine)):
                found.append((key, doc + a, reach))
        return tuple(np.concatenate(x) for x in zip(*found))

    def counted(self, batch: pa.RecordBatch, level: int) -> np.ndarray:
        """Keys of the first level, before any refining, or of the last."""
        words, n, rare, known = _texts(batch)
        small = n <= CLASS_WORDS
        if level == 1:
            found = [self.words(words, n)[0]]
            if self.levels > 1:
                found += [k[reach > 0] for k, _, reach in self._parts(words[np.repeat(small, n)], n[small], rare[small], known[small], True)]
            return np.concatenate(found)
        return self.keys(words[np.repeat(small, n)], n[small], rare[small], known[small], level)[0]

    def blocks(self, key: np.ndarray, levels: int) -> np.ndarray:
        """In how many blocks the list of each key is cut."""
        last = self.tables[levels - 1] if len(self.tables) >= levels else None
        return np.ones(len(key), np.int64) if last is None else -(-last[_slot(key, len(last))].astype(np.int64) // self.hot)

    def turn(self, levels: int, turn: int, turns: int):
        """Which keys have postings in this turn: those whose one list falls into it, and all whose list is cut into blocks."""
        cut = len(self.tables) >= levels and bool((self.tables[levels - 1] > self.hot).any())

        def mine(key: np.ndarray) -> np.ndarray:
            here = _rest(_place(key, np.uint64(0)), turns) == turn
            if cut:
                away = np.flatnonzero(~here)
                here[away] = self.blocks(key[away], levels) > 1
            return here

        return mine


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Words, sizes and numbers of rare, and of rare or middle words of the texts ``doc, words, rare, known``."""
    return *_flat(batch.column(1)), batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / CLASS_WORDS))).astype(np.int64)


def digest(words: np.ndarray, n: np.ndarray, positions: int) -> np.ndarray:
    """A row of positional bytes for each text."""
    rows, ends = np.zeros(len(n) * positions, np.uint8), np.concatenate(([0], np.cumsum(n)))
    for a in range(0, len(n), TEXTS):
        b = min(a + TEXTS, len(n))
        mixed = _mixed(words[ends[a] : ends[b]])
        cell = np.repeat(np.arange(a, b) * positions, n[a:b]) + _rest(mixed >> np.uint64(16), positions).astype(np.int64)
        np.add.at(rows, cell, (_rest(mixed, 255) + np.uint64(1)).astype(np.uint8))
    return rows.reshape(len(n), positions)


def least_shared(positions: int, n: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """The positional bytes that texts of ``n`` and ``m`` words beyond ``share`` are guaranteed to have in common."""
    return positions - np.floor((1 - share) / (1 + share) * (n + m) + 1e-9)


def _place(key: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """A number for each list or block, of which its turn and its part follow."""
    return _mixed(key ^ _mixed(cell >> np.uint64(2))) >> np.uint64(8)


_COLUMNS = ["part", "cls", "key", "cell", "doc", "n", "reach", "bytes"]


def _posted(postings: Postings, turn: int, turns: int, parts: int):
    """Postings as blocks of arrays, one row for each part and size class; a key's postings all come in one part of one turn."""

    turn_of = {levels: postings.turn(levels, turn, turns) for levels in (1, postings.levels)}

    def _one_class(rows: list[list], cls: int, own_class: np.ndarray, docs: np.ndarray, words: np.ndarray, n: np.ndarray, rare: np.ndarray, known: np.ndarray) -> None:
        levels = postings.levels_of(cls)
        key, doc, reach = postings.keys(words, n, rare, known, levels, turn_of[levels])
        use = (own_class[doc] == cls) | (reach > CLASS_WORDS << max(0, cls - 1))
        key, doc, reach = key[use], doc[use], reach[use]
        blocks = postings.blocks(key, levels)
        own = (_mixed(docs.view(np.uint64)[doc]) % blocks.astype(np.uint64)).astype(np.int64)
        who = np.repeat(np.arange(len(key)), blocks)
        other = np.arange(len(who)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        key, doc, reach, own = key[who], doc[who], reach[who], own[who]
        cell = np.minimum(own, other) << 33 | np.maximum(own, other) << 2 | np.where(own == other, 0, np.where(own < other, 1, 2))
        place = _place(key, cell.astype(np.uint64))
        mine = np.flatnonzero(_rest(place, turns) == turn)
        if not len(mine):
            return
        part = (place // np.uint64(turns) % np.uint64(parts)).astype(np.int64)
        use = mine[np.argsort(part[mine], kind="stable")]
        some, back = np.unique(doc[use], return_inverse=True)
        keep = np.zeros(len(n), bool)
        keep[some] = True
        keep = np.repeat(keep, n)
        rows_of = digest(words[keep], n[some], POSITIONS << cls)[back]
        ends = np.flatnonzero(np.diff(part[use], append=-1)) + 1
        for a, b in zip([0, *ends[:-1]], ends):
            u = use[a:b]
            values = (int(part[u[0]]), cls, key[u].tobytes(), cell[u].tobytes(), docs[doc[u]].tobytes(), n[doc[u]].astype(np.int32).tobytes(), reach[u].astype(np.int32).tobytes(), rows_of[a:b].tobytes())
            for column, value in zip(rows, values):
                column.append(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 5_000) for b in batches for i in range(0, b.num_rows, 5_000)):
            docs, (words, n, rare, known) = batch.column(0).to_numpy(), _texts(batch)
            if not len(n):
                continue
            rows: list[list] = [[] for _ in _COLUMNS]
            own_class = size_class(n)
            for cls in range(int(own_class.max()) + 2):
                # texts of the class below meet the larger ones of this class, if they reach so far
                here = (own_class == cls) | (own_class == cls - 1) & (n / postings.share > CLASS_WORDS << max(0, cls - 1))
                if here.any():
                    _one_class(rows, cls, own_class[here], docs[here], words[np.repeat(here, n)], n[here], rare[here], known[here])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, [pa.int32(), pa.int32(), *[pa.binary()] * 6])], names=_COLUMNS)

    return run


def tally(a: np.ndarray, b: np.ndarray, digests: list[np.ndarray]) -> np.ndarray:
    """Shared positional bytes of the texts ``a`` and ``b``; ``digests`` holds eight positions of all texts an array."""
    ones = np.uint64(0x0101010101010101)
    shared = np.zeros(len(a), np.int32)
    size = min(len(a), 8_192)
    x, y, same, counts = (np.empty(size, np.uint64) for _ in range(4))
    for i in range(0, len(a), size or 1):
        p, q = a[i : i + size], b[i : i + size]
        k = len(p)
        # eight counts in a number, whose sum fits the highest byte
        for some in (digests[j : j + 31] for j in range(0, len(digests), 31)):
            counts[:k] = 0
            for eight in some:
                eight.take(p, out=x[:k], mode="clip")
                eight.take(q, out=y[:k], mode="clip")
                np.equal(x[:k].view(np.uint8), y[:k].view(np.uint8), out=same[:k].view(bool))
                counts[:k] += same[:k]
            shared[i : i + k] += (counts[:k] * ones >> np.uint64(56)).astype(np.int32)
    return shared


def _met(share: float):
    """Pairs of one part's postings that are within each other's reach and share the guaranteed minimum of bytes."""

    def pairs(cls: int, key: np.ndarray, cell: np.ndarray, doc: np.ndarray, n: np.ndarray, reach: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
        side = (cell & 3).astype(np.int8)
        order = np.lexsort((n, cell >> 2, key))
        key, cell, doc, n, reach, side = key[order], cell[order] >> 2, doc[order], n[order], reach[order], side[order]
        digests = [np.ascontiguousarray(c) for c in rows.view(np.uint64)[order].T]
        own = size_class(n) == cls if cls else reach > 0
        reach = np.abs(reach)

        def kept(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = tally(a, b, digests) >= least_shared(POSITIONS << cls, n[a], n[b], share)
            a, b = doc[a[ok]], doc[b[ok]]
            return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b]

        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
        size = np.diff(new, append=len(key))
        # small groups, all at once: each text with the d-th after it
        last = np.repeat(np.where(size <= GROUP, new + size, new), size)
        at = np.flatnonzero(last > np.arange(len(key)) + 1)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(1, GROUP):
            at = at[at + d < last[at]]
            if not len(at):
                break
            b = at + d
            ok = (n[b] <= reach[at]) & (n[at] <= reach[b]) & (own[at] | own[b]) & ((side[at] == 0) | (side[at] != side[b]))
            waiting.append((at[ok], b[ok]))
            if sum(len(x) for x, _ in waiting) > 500_000:
                yield kept(*map(np.concatenate, zip(*waiting)))
                waiting = []
        if waiting:
            yield kept(*map(np.concatenate, zip(*waiting)))
        # large groups, in blocks of texts of nearly one size
        for s, k in zip(new[size > GROUP], size[size > GROUP]):
            crossed = side[s : s + k].any()
            for i in range(s, s + k, ROWS):
                a = np.arange(i, min(i + ROWS, s + k))
                b = np.arange(i + 1, i + 1 + np.searchsorted(n[i + 1 : s + k], reach[a].max(), "right"))
                b = b[(reach[b] >= n[i]) & (own[b] | own[a].any())]
                if not len(b):
                    continue
                a = a[reach[a] >= n[b[0]]]
                for c in (b[j : j + 4_096] for j in range(0, len(b), 4_096)):
                    ok = (n[c] <= reach[a][:, None]) & (n[a][:, None] <= reach[c]) & (c > a[:, None]) & (own[c] | own[a][:, None])
                    if crossed:
                        ok &= (side[a][:, None] == 0) | (side[a][:, None] != side[c])
                    x, y = np.nonzero(ok)
                    if len(x):
                        yield kept(a[x], c[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint8]
        seen: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            for _, cls, *raw in zip(*(c.to_pylist() for c in batch.columns)):
                for column, value in zip(seen.setdefault(cls, [[] for _ in raw]), raw):
                    column.append(value)
        for cls in list(seen):
            key, cell, doc, n, reach, rows = (np.frombuffer(b"".join(c), t) for c, t in zip(seen.pop(cls), kinds))
            found = [np.empty((0, 2), np.int64)]
            for some in pairs(cls, key, cell, doc, n, reach, rows.reshape(len(key), -1)):
                found.append(some)
                if sum(map(len, found)) > 1_000_000:
                    found = [np.unique(np.concatenate(found), axis=0)]
                    if len(found[0]) > 500_000:
                        yield pa.record_batch([pa.array(found[0][:, 0]), pa.array(found[0][:, 1])], names=["da", "db"])
                        found = [np.empty((0, 2), np.int64)]
            out = np.unique(np.concatenate(found), axis=0)
            yield pa.record_batch([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["da", "db"])

    return run


def _verify(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 4_000) for b in batches for i in range(0, b.num_rows, 4_000)):
            (a, n), (b, m) = (_flat(batch.column(k)) for k in (2, 3))
            owner = np.concatenate([np.repeat(np.arange(len(x), dtype=np.uint64), x) for x in (n, m)])
            every = np.sort(owner << np.uint64(32) | np.concatenate([a, b]))
            both = np.bincount((every[1:][every[1:] == every[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(n))
            yield batch.select([0, 1]).filter(pa.array(both >= share * (n + m - both) - 1e-9))

    return run


def _slots(texts: int, per_text: float, hot: int) -> int:
    """Eight slots to each list that may be hot."""
    slots = SLOTS
    while slots < min(MOST_SLOTS, 8 * texts * per_text / hot):
        slots *= 2
    return slots


def _groups(one: DataFrame, postings: Postings) -> list[float]:
    """The most slack of each group of texts of the first size class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n, rare, known = _texts(batch)
            slack = np.ceil(postings.slack(n, known, known - rare)[n <= CLASS_WORDS]).astype(np.int64)
            value, count = np.unique(slack[slack >= 0], return_counts=True)
            yield pa.record_batch([pa.array(value, pa.int64()), pa.array(count, pa.int64())], names=["slack", "n"])

    found = one.mapInArrow(run, "slack long, n long").groupBy("slack").agg(F.sum("n").alias("n")).orderBy("slack").toArrow()
    value, share = found.column("slack").to_numpy(), np.cumsum(found.column("n").to_numpy())
    return sorted({float(value[np.searchsorted(share, q * share[-1])]) for q in GROUPS}) if len(value) else []


def similar_sets(sets: DataFrame, share: float, least: int = 1, hot: int = HOT, levels: int = LEVELS, spent: bool = False) -> DataFrame:
    """Pairs ``da < db`` of different word sets with Jaccard similarity of ``share`` or more.

    ``sets`` has ``doc`` and ``words`` (sorted 32-bit hashes) of at least
    ``least`` words; it must be cheap to read twice.  If it is ``spent``, a
    written table that nothing else reads, it goes as soon as it was read.  No
    pair is lost, whatever ``hot`` and ``levels`` are.
    """
    if not 0.5 < share <= 1:
        raise ValueError("share is above 0.5: a text may only meet texts of its own and the next size class")
    spark = sets.sparkSession
    one = sets.groupBy("doc").agg(F.first("words").alias("words"))
    texts, total = sets.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words") / 4), F.lit(0.0))).first()
    if not texts:
        return spark.createDataFrame([], "da long, db long")
    slots, few = _slots(texts, total / texts, hot), min(FEW, hot)
    counts, _ = _tallied(sets.select("words").mapInArrow(_count(lambda b: _flat(b.column(0))[0], slots), "slot long, n long"), slots)
    one = materialize(one.mapInArrow(_ordered(counts, few, MIDDLE * texts), "doc long, words binary, rare int, known int"), "texts")
    if spent:
        drop(sets)
    release(spark)
    tables: list[np.ndarray] = []
    groups = _groups(one, Postings(share, least, hot, levels)) if levels > 1 else []
    # what is over few texts shows in a part of the texts, too
    times, slots = max(1, few // 64), _slots(texts, total / texts, few)
    some = one.where(F.pmod("doc", F.lit(times)) == 0)
    for level in range(1, levels + 1):
        known = Postings(share, least, hot, levels, tables, groups)
        table, posted = _tallied(some.mapInArrow(_count(lambda b, p=known, k=level: p.counted(b, k), slots), "slot long, n long"), slots, few // times, times)
        tables = [*tables, table]
    postings = Postings(share, least, hot, levels, tables, groups)
    posted *= POSITIONS + 32
    turns = max(TURNS, math.ceil(posted / (TURN_SIZE * 4 * total)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-posted // (PART_BYTES * turns)))
    shape = "part int, cls int, key binary, cell binary, doc binary, n binary, reach binary, bytes binary"
    met = []
    for turn in range(turns):
        rows = one.mapInArrow(_posted(postings, turn, turns, parts), shape)
        met.append(materialize(rows.repartitionById(parts, F.col("part")).mapInArrow(_met(share), "da long, db long"), "met"))
        del rows
        release(spark)
    pairs = reduce(DataFrame.union, met).distinct()
    words = one.select("doc", "words")
    full = pairs.join(words.toDF("da", "wa"), "da").join(words.toDF("db", "wb"), "db").select("da", "db", "wa", "wb")
    found = materialize(full.mapInArrow(_verify(share), "da long, db long"), "pairs")
    for table in [*met, one]:
        drop(table)
    return found


def _alike(df: DataFrame, key: str, text: str, least: int, share: float) -> tuple[DataFrame, DataFrame]:
    """``id, doc`` of the records of ``least`` words or more, once each, and the pairs of different word sets."""
    sets = materialize(word_sets(df, key, text, least), "sets")
    members = materialize(sets.select("id", "doc").distinct(), "members")
    return members, similar_sets(sets, share, least, spent=True)


def near_duplicate_pairs(df: DataFrame, key: str = "entry_id", text: str = "text", least: int = 50, share: float = 0.6) -> DataFrame:
    """All pairs ``entry_a < entry_b`` of records alike beyond ``share``.

    A record delivered twice counts once.  Null and empty texts, and texts of
    fewer than ``least`` distinct words, have no partner; an empty table gives
    no rows; other columns of ``df`` are ignored.  Copies are paired in blocks
    of ``COPIES``, so that no task holds all pairs of one text.
    """
    members, pairs = _alike(df, key, text, least, share)
    count = members.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("b"), F.count(F.lit(1)).alias("k"))
    copies = count.where("k > 1").select(F.col("doc").alias("da"), F.col("doc").alias("db"))
    blocks = count.select("doc", "b")
    placed = members.join(blocks, "doc").withColumn("h", F.pmod(F.xxhash64("id"), "b").cast("int"))
    cells = pairs.union(copies).join(blocks.toDF("da", "ba"), "da").join(blocks.toDF("db", "bb"), "db")
    cells = cells.withColumn("ha", F.explode(F.sequence(F.lit(0), F.col("ba") - 1))).withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("bb") - 1)))
    left = cells.join(placed.select(F.col("id").alias("a"), F.col("doc").alias("da"), F.col("h").alias("ha")), ["da", "ha"]).withColumn("lane", F.pmod("ha", "bb"))
    right = placed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select(F.col("id").alias("b"), F.col("doc").alias("db"), F.col("h").alias("hb"), "lane")
    both = left.join(right, ["db", "hb", "lane"]).where("da <> db or a < b")
    return both.select(F.least("a", "b").alias("entry_a"), F.greatest("a", "b").alias("entry_b")).where("entry_a <> entry_b").distinct()


def near_duplicate_classes(df: DataFrame, key: str = "entry_id", text: str = "text", least: int = 50, share: float = 0.6) -> DataFrame:
    """``entry_id, class_id, links`` of all records with ``least`` words or more.

    A class is the records of one word set, named by its smallest key;
    ``links`` counts the other classes that it is alike to beyond ``share``.
    The form that stays small where one text has many copies.
    """
    members, pairs = _alike(df, key, text, least, share)
    links = pairs.select(F.explode(F.array("da", "db")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("links"))
    named = members.groupBy("doc").agg(F.min("id").alias("class_id")).join(links, "doc", "left")
    return members.join(named, "doc").select(F.col("id").alias("entry_id"), "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
