"""Keyword-stuffed and link-list pages (problem 8).

Each text is cut into blocks of about ``BLOCK`` characters at white space.  A
block's compression ratio is taken with what came before it on the page as
context, so that repeats of earlier blocks are seen: the bytes that its skeleton
(tags and link targets masked, digits and case folded, glued tag words parted,
white space collapsed) adds to the compressed page, over the bytes that it had.
The ratio is divided by the median of sentence-like blocks of the same language
and length of context over the whole corpus.  Only blocks of low ratio can be
junk; a block is where

* the ratio is extreme (``EXTREME``) and most rarer words came in the block
  before (``AGAIN``), or
* it is low (``LOW``), and the block has few sentence ends (``FEW_ENDS``) and
  few usual words (``FEW_USUAL``), or
* it is below the norm (``BELOW``), and the share of rarer words, by letters,
  that came in the block before exceeds the share of usual words by ``STUFFED``
  (without sentence ends, ``STUFFED_BARE``).

A page is junk if junk blocks hold more than half of its characters.

Usual are the words that most pages of a language hold, as counted over the
whole corpus: at most ``MOST_USUAL`` in a language, which in prose are those
that hold sentences together.  They confirm beside punctuation, because some
keyword lists carry as many full stops as prose, and remedy and dose lists as
few as link lists; no list of words or languages is needed for it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.near_duplicates import words_of
from quillspark.plans.scratch import materialize

BLOCK = 320
EXTREME, LOW, BELOW = 0.58, 0.7, 0.9
AGAIN, FEW_USUAL, FEW_ENDS = 0.55, 0.12, 0.6
STUFFED, STUFFED_BARE = 0.3, 0.25
#: A block of fewer rarer words isn't judged by their repetition.
LEAST_WORDS = 16
#: A word is usual that this share of a language's pages hold, of the words the most frequent so many.
USUAL_SHARE, MOST_USUAL = 0.5, 30
#: A language's shares are those of all pages, until it has many more pages than so many.
PRIOR_PAGES = 50
#: A norm needs so many blocks, else that of all languages holds.
NORM_BLOCKS = 20
#: Words counted in a task before they are handed on.
COUNTED = 300_000

#: How the four languages are written in ``lang``.
LANGUAGES = {"en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de", "ger": "de", "deutsch": "de", "german": "de", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "es": "es", "spa": "es", "spanish": "es", "español": "es"}

_TARGET = re.compile(r"<[^<>]{1,400}>|(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_GLUED = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"\w[.!?…]+[\"”’)\]]*(?=\s|$)")


def _blocks(text: str) -> list[str]:
    """Pieces of nearly equal length, cut at the next white space if one is near."""
    k = max(1, round(len(text) / BLOCK))
    cuts = [0]
    for i in range(1, k):
        at = i * len(text) // k
        space = _SPACE.search(text, at, at + BLOCK // 2)
        at = space.end() if space else at
        if at > cuts[-1]:
            cuts.append(at)
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def _masked(block: str) -> tuple[str, int]:
    plain = _SPACE.sub(" ", block)
    return _DIGIT.sub("0", _GLUED.sub(" ", _TARGET.sub("@", plain))).lower(), max(40, len(plain.encode()))


def _added(parts: list[bytes]) -> list[tuple[int, int]]:
    """The compressed bytes that each part adds to those before it, and how many bytes came before; the first has the second before it."""
    def run(some: list[bytes]) -> list[tuple[int, int]]:
        c, out, before = zlib.compressobj(6, zlib.DEFLATED, -15), [], 0
        for p in some:
            out.append((max(1, len(c.compress(p)) + len(c.flush(zlib.Z_SYNC_FLUSH)) - 4), before))
            before += len(p)
        return out

    return run(parts) if len(parts) < 2 else [run([parts[1], parts[0]])[1], *run(parts)[1:]]


def features(text: str, usual: frozenset) -> Iterator[tuple[int, float, int, float, float, float]]:
    """Of each block: characters, ratio, class of the context's length, share of usual words, sentence ends a 100 characters, share of repeated rarer words by letters."""
    blocks = [b for b in _blocks(text) if b.strip()]
    masked = [_masked(b) for b in blocks]
    for block, (plain, size), (added, before) in zip(blocks, masked, _added([m.encode() for m, _ in masked])):
        words = _WORD.findall(plain)
        rare = [w for w in words if len(w) > 2 and w not in usual]
        again = 1 - len("".join(set(rare))) / len("".join(rare)) if len(rare) >= LEAST_WORDS else 0.0
        share = sum(w in usual for w in words) / max(1, len(words))
        yield len(block), added / size, before.bit_length(), share, 100 * len(_END.findall(block)) / max(40, len(block)), again


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n``: pages of a task with each word, and under the word '' all its pages."""
    seen: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            plain = [w.decode() if isinstance(w, bytes) else w for w in words]
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(plain, pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            count = seen.setdefault(lang, Counter())
            count.update(words_of(text))
            count[""] += 1
        if sum(map(len, seen.values())) > COUNTED:
            yield from out()
    yield from out()


def usual_words(texts: DataFrame) -> dict[str, frozenset]:
    """The usual words of each language of ``id, lang, text``; the driver gets ``MOST_USUAL`` a language."""
    counts = materialize(texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    pages = {r.lang: r.n for r in counts.where("word = ''").collect()}  # a row a language
    total = sum(pages.values())
    every = counts.where("word <> ''").groupBy("word").agg(F.sum("n").alias("all"))
    often = every.where(F.col("all") >= USUAL_SHARE * total)  # the prior's words that may be usual where a language says nothing
    found: dict[str, frozenset] = {}
    for lang, n in pages.items():
        own = counts.where((F.col("lang") == lang) & (F.col("word") != "") & ((F.col("n") + PRIOR_PAGES) >= USUAL_SHARE * (n + PRIOR_PAGES))).select("word", "n")
        both = own.join(every, "word").select("word", "n", "all").union(often.join(own, "word", "left_anti").select("word", F.lit(0), "all"))
        share = (F.col("n") + PRIOR_PAGES * F.col("all") / total) / (n + PRIOR_PAGES)
        rows = both.select("word", share.alias("s")).where(F.col("s") >= USUAL_SHARE).orderBy(F.desc("s"), "word").limit(MOST_USUAL).collect()
        found[lang] = frozenset(r.word for r in rows)
    return found


def _run(usual: dict[str, frozenset]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for row in features(text, usual.get(lang, frozenset())):
                    for column, value in zip(out, (key, lang, *row)):
                        column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float32(), pa.int32(), *[pa.float32()] * 3]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds)], names=["id", "lang", "chars", "ratio", "context", "usual", "ends", "again"])

    return run


def language(column: Column) -> Column:
    """One of the four languages, or null."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(names, F.lower(F.trim(column)))


def junk_shares(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id, chars, junk_share`` of every text that is not blank.

    Null and blank texts have no row; a key that comes twice counts as one
    page of both texts; null or unknown languages share one norm.
    """
    known = F.coalesce(language(F.col(lang)), F.lit("?"))
    texts = df.where(F.col(text).rlike(r"\S")).select(F.col(key).cast("long").alias("id"), known.alias("lang"), F.col(text).alias("text"))
    blocks = materialize(texts.mapInArrow(_run(usual_words(texts)), "id long, lang string, chars int, ratio float, context int, usual float, ends float, again float"), "blocks")
    prose = blocks.where((F.col("usual") >= FEW_USUAL) & (F.col("ends") >= 0.5))
    median = F.when(F.count(F.lit(1)) >= NORM_BLOCKS, F.percentile_approx("ratio", 0.5, 1000))
    norms = prose.groupBy("lang", "context").agg(median.alias("norm"))  # 5 languages by 32 classes
    wider = prose.groupBy("context").agg(median.alias("wide"))
    overall = prose.groupBy().agg(F.percentile_approx("ratio", 0.5, 1000).alias("any"))
    rated = blocks.join(F.broadcast(norms), ["lang", "context"], "left").join(F.broadcast(wider), "context", "left").join(F.broadcast(overall)).withColumn("rel", F.col("ratio") / F.coalesce("norm", "wide", "any", F.lit(0.62)))
    junk = (
        ((F.col("rel") <= EXTREME) & (F.col("again") >= AGAIN))
        | ((F.col("rel") <= LOW) & (F.col("ends") <= FEW_ENDS) & (F.col("usual") <= FEW_USUAL))
        | ((F.col("rel") <= BELOW) & (F.col("again") - F.col("usual") >= F.when(F.col("ends") == 0, STUFFED_BARE).otherwise(STUFFED)))
    )
    return rated.groupBy("id").agg(F.sum("chars").alias("chars"), (F.sum(F.when(junk, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("junk_share"))


def junk_pages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id`` of the pages that are junk for more than half of their characters."""
    return junk_shares(df, key, text, lang).where("junk_share > 0.5").select("id")
