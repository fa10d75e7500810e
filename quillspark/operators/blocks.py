"""Many cases scored against blocks of documents, with no row for a pair of them.

A block is a matrix of bytes, a row for each term and a column for each
document.  A rule of a case is then a few operations on whole rows, and of a
case only its best documents leave a task.  Cases come in turns of a bounded
number of plan rows, so that what is sent to the workers doesn't grow.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Plan rows of a turn, as far as whole cases allow.
TURN = 100_000
#: Bytes of a block's matrix, and tokens that a task remembers.
MATRIX, KNOWN = 1 << 26, 200_000
#: Rows of an Arrow batch that is sent back.
SENT = 20_000


def token_sets(posted: DataFrame, key: str) -> DataFrame:
    """``key, tokens``: one row a document; ``posted`` may be so already, or have a row for each token."""
    found = posted if "tokens" in posted.columns else posted.groupBy(key).agg(F.collect_set("token").alias("tokens"))
    return found.select(F.col(key).alias("key"), "tokens").where("key is not null")


def turns(plan: DataFrame, case: str = "case") -> Iterator[DataFrame]:
    """``plan`` in parts of whole cases of some ``TURN`` rows each."""
    n = max(1, -(-plan.count() // TURN))
    for k in range(n):
        yield plan.where(F.pmod(F.xxhash64(case), F.lit(n)) == k)


def _contained(terms: list[str]) -> Callable[[str], list[int]]:
    """The numbers of the terms that a token contains, found by their first three letters."""
    by: dict[str, list[tuple[int, str]]] = {}
    for i, t in enumerate(terms):
        by.setdefault(t[:3], []).append((i, t))
    lengths, known = sorted({len(x) for x in by}), {}

    def found(token: str) -> list[int]:
        if token not in known:
            if len(known) >= KNOWN:
                known.clear()
            known[token] = sorted({i for k in range(len(token)) for n in lengths for i, t in by.get(token[k : k + n], ()) if token.startswith(t, k)})
        return known[token]

    return found


def _blocks(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[tuple[list, np.ndarray]]:
    """Keys in order and the matrix of each block; documents without a term are left out."""
    contained, most = _contained(terms), max(64, MATRIX // max(1, len(terms)))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            tokens = part.column("tokens")
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            coded = tokens.flatten().dictionary_encode()
            lists = [contained(t) if t is not None else [] for t in coded.dictionary.to_pylist()]
            n_of = np.array([len(x) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            if not len(flat):
                continue
            code, doc = coded.indices.fill_null(0).to_numpy(zero_copy_only=False), np.repeat(np.arange(part.num_rows), lengths)
            some = n_of[code] > 0
            code, doc = code[some], doc[some]
            reps, starts = n_of[code], (np.cumsum(n_of) - n_of)[code]
            term = flat[np.repeat(starts - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
            met, place = np.unique(np.repeat(doc, reps), return_inverse=True)
            keys = part.column("key").take(pa.array(met)).to_pylist()
            order = sorted(range(len(keys)), key=keys.__getitem__)
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys))
            h = np.zeros((len(terms), len(keys)), np.uint8)
            h[term, rank[place]] = 1
            yield [keys[i] for i in order], h


def _some(h: np.ndarray, ids: list[int]) -> np.ndarray:
    """1 for the documents with any of the terms."""
    found = h[ids[0]]
    for i in ids[1:]:
        found = found | h[i]
    return found


def _every(h: np.ndarray, ids: list[int]) -> np.ndarray:
    found = h[ids[0]]
    for i in ids[1:]:
        found = found & h[i]
    return found


def _units(points: dict[str, float]) -> tuple[dict[str, int], int]:
    """Points as whole numbers of their greatest common unit, and that in ten-thousandths."""
    whole = {k: int((Decimal(repr(float(v))) * 10_000).quantize(Decimal(1), ROUND_HALF_UP)) for k, v in points.items()}
    unit = gcd(*whole.values()) or 1
    return {k: v // unit for k, v in whole.items()}, unit


def _number(rows: list[dict]) -> tuple[list[str], list[list[int]]]:
    """The terms that can be in a token, and those of each plan row by their numbers, repeats too; -1 is a term that can't."""
    terms: dict[str, int] = {}
    of = [[terms.setdefault(t, len(terms)) if t is not None and re.fullmatch("[a-z]+", t) else -1 for t in r["terms"] or []] for r in rows]
    return list(terms), of


#: Rules that need all terms of their row, with the points for several terms and for one.
_WHOLE = {"ailments": ("ailments_all", "ailments_one"), "constitution": ("constitution_all", "constitution_one"), "checked": ("checked_all", "checked_one")}


def _compiled(rows: list[dict], p: dict[str, int]) -> tuple[list[str], list[tuple], int]:
    """Terms, a program for each case, and a bound of what a case can score.

    A program is ``(case, ids, sums, alls, symptoms, rows)``: its terms, points
    for each of some terms, points for all of some terms, what depends on place
    and sensation, and the rows for the labels, their terms by place in ``ids``.
    """
    terms, of = _number(rows)
    cases: dict = {}
    for r, ids in zip(rows, of, strict=True):
        cases.setdefault(r["case"], []).append((r, ids))
    programs, bound = [], 0
    for case, its in cases.items():
        own = sorted({i for _, ids in its for i in ids if i >= 0})
        place = {i: k for k, i in enumerate(own)}
        sums: dict[int, list[int]] = {}
        alls: dict[tuple, int] = {}
        symptoms: dict = {}
        kept = []
        for r, ids in its:
            rule, real, distinct = r["rule"], [i for i in ids if i >= 0], sorted(set(ids))
            if not real:
                continue
            kept.append((r["seq"], r["at"], rule, r["label"], r["both"], r["placed"], r["felt"], len(ids), len({*(r["terms"])}), [place[i] for i in sorted(set(real))]))
            each = {"word": "word", "free": "free", "habit": "habit", "constitution": "constitution_any"}.get(rule)
            if rule in ("loc", "sens", "side", "modality"):
                s = symptoms.setdefault(r["seq"], [r["placed"], r["felt"], [], [], [], []])
                s[("loc", "sens", "side", "modality").index(rule) + 2] += real if rule in ("loc", "sens", "side") else [sorted(set(real))]
                if rule == "loc" and not r["felt"] or rule == "sens" and not r["placed"]:
                    sums.setdefault(p.get("location_only" if rule == "loc" else "sensation_only", 0), []).extend(real)
            elif each in p:
                sums.setdefault(p[each], []).extend(real)
            elif rule == "window" or rule in _WHOLE:
                points = p.get("window" if rule == "window" else _WHOLE[rule][len(ids) < 2], 0)
                if distinct[0] >= 0:
                    alls[tuple(distinct)] = alls.get(tuple(distinct), 0) + points
        for ids in [k for k in alls if len(k) == 1]:
            sums.setdefault(alls.pop(ids), []).append(ids[0])
        most = sum(k * len(v) for k, v in sums.items()) + sum(alls.values()) + sum(3 * sum(p.get(k, 0) for k in ("both", "location_rest", "sensation_rest")) + p.get("side", 0) * len(s[4]) + 2 * len(s[5]) * sum(p.get(f"modality_{k}", 0) for k in ("in", "out", "alone")) for s in symptoms.values())
        bound = max(bound, most)
        programs.append((case, own, [(k, v[i : i + 255]) for k, v in sums.items() if k for i in range(0, len(v), 255)], [(k, list(v)) for v, k in alls.items() if k], list(symptoms.values()), kept))
    return terms, programs, bound


def _score(h: np.ndarray, program: tuple, p: dict[str, int], kind: type) -> np.ndarray:
    _, _, sums, alls, symptoms, _ = program
    s = np.zeros(h.shape[1], kind)
    times = lambda c, n: np.multiply(c, kind(n), dtype=kind)
    for points, ids in sums:
        n = h[ids[0]].copy()
        for i in ids[1:]:
            n += h[i]
        s += times(n, points)
    for points, ids in alls:
        s += times(_every(h, ids), points)
    for placed, felt, loc, sens, side, modality in symptoms:
        here = _some(h, loc) if loc else None
        there = _some(h, sens) if sens else None
        if placed and felt:
            both, here_alone, there_alone = (p.get(k, 0) for k in ("both", "location_rest", "sensation_rest"))
            if loc:
                s += times(here, here_alone)
            if sens:
                s += times(there, there_alone)
            if loc and sens:
                s += times(here & there, both - here_alone - there_alone)
        if side and loc:
            n = np.zeros_like(s)
            for i in side:
                n += h[i]
            s += times(n, p.get("side", 0)) * here
        if modality:
            n = np.zeros_like(s)
            for ids in modality:
                n += _some(h, ids)
            if not placed:
                s += times(n, p.get("modality_alone", 0))
            elif loc:
                s += n * (times(here, p.get("modality_in", 0) - p.get("modality_out", 0)) + kind(p.get("modality_out", 0)))
            else:
                s += times(n, p.get("modality_out", 0))
    return s


def _best(s: np.ndarray, top: int, least: int) -> np.ndarray:
    """The places of the ``top`` highest scores from ``least``, earlier ones first among equals."""
    at = np.flatnonzero(s >= least)
    if len(at) > top:
        found = s[at]
        bar = np.partition(found, len(found) - top)[len(found) - top]
        over = at[found > bar]
        at = np.concatenate([over, at[found == bar][: top - len(over)]])
    return at


def top_documents(turn: DataFrame, docs: DataFrame, points: dict[str, float], top: int) -> tuple[DataFrame, object]:
    """``case, key, units, seen`` of the best documents of each task and case, and what ``labels`` needs.

    ``units`` is the sum in ten-thousandths, ``seen`` has a bit for each term of
    the case.  All points are above zero, so a document without an award is one
    whose sum is zero.
    """
    spark = turn.sparkSession
    p, unit = _units(points)
    terms, programs, bound = _compiled(turn.toArrow().to_pylist(), p)
    kind = np.int16 if bound < 2**15 else np.int32 if bound < 2**31 else np.int64
    sent = spark.sparkContext.broadcast((terms, programs))
    schema = StructType([turn.schema["case"], docs.schema["key"]]).add("units", "long").add("seen", "binary")
    arrow = to_arrow_schema(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, programs = sent.value
        best: list[list[tuple]] = [[] for _ in programs]
        for keys, h in _blocks(batches, terms):
            for k, program in enumerate(programs):
                if not program[1]:
                    continue
                s = _score(h, program, p, kind)
                full = len(best[k]) == top
                # a document as good as the last one may still have a smaller key
                at = _best(s, top, max(1, -best[k][-1][0]) if full else 1)
                if len(at):
                    seen = np.packbits(h[np.ix_(program[1], at)], axis=0).T
                    found = [(-int(s[i]), keys[i], seen[j].tobytes()) for j, i in enumerate(at)]
                    best[k] = sorted(best[k] + found, key=lambda x: x[:2])[:top]
        rows = [(program[0], key, -score * unit, seen) for program, its in zip(programs, best, strict=True) for score, key, seen in its]
        for at in range(0, len(rows), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + SENT], strict=True), arrow.types, strict=True)], schema=arrow)

    return docs.mapInArrow(scored, schema), sent


def _label_list(program: tuple, seen: bytes, points: dict[str, float], most: int) -> list[str]:
    """The labels of a document's awards, those first awarded first."""
    bits = np.unpackbits(np.frombuffer(seen, np.uint8))
    rows = [(r, n) for r in program[5] if (n := int(bits[r[9]].sum()))]
    here, there = {r[0] for r, _ in rows if r[2] == "loc"}, {r[0] for r, _ in rows if r[2] == "sens"}
    first: dict[str, tuple] = {}
    for (seq, at, rule, label, both, placed, felt, size, need, _), n in rows:
        in_loc, in_sens = seq in here, seq in there
        if rule == "loc":
            name = "location_only" if not felt else "both" if in_sens else "location_rest"
        elif rule == "sens":
            name = "sensation_only" if not placed else None if in_loc else "sensation_rest"
        elif rule == "side":
            name = "side" if in_loc else None
        elif rule == "modality":
            name = "modality_alone" if not placed else "modality_in" if in_loc else "modality_out"
        elif rule == "constitution" and "constitution_any" in points:
            name = "constitution_any"
        elif rule == "window" or rule in _WHOLE:
            name = None if n < need else "window" if rule == "window" else _WHOLE[rule][size < 2]
        else:
            name = rule
        if name in points:
            shown, place = both if name == "both" else label, (seq, at is not None, at or 0)
            first[shown] = min(first.get(shown, place), place)
    return sorted(first, key=lambda x: (first[x], x))[:most]


def labels(best: DataFrame, sent: object, points: dict[str, float], most: int) -> DataFrame:
    """``best`` with ``matched``, up to ``most`` labels, in place of ``seen``."""
    kept = [c for c in best.columns if c != "seen"]
    schema = best.select(*kept).schema.add("matched", ArrayType(StringType()))
    arrow = to_arrow_schema(schema)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programs = {x[0]: x for x in sent.value[1]}
        for batch in batches:
            found = [_label_list(programs[c], s, points, most) for c, s in zip(batch.column("case").to_pylist(), batch.column("seen").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, arrow.types[-1])], schema=arrow)

    return best.mapInArrow(labelled, schema)


def rows_met(turn: DataFrame, docs: DataFrame, whole: tuple[str, ...]) -> DataFrame:
    """``row``: plan rows with a document that has all their terms (rules of ``whole``) or any (other rules)."""
    rows = turn.select("row", "rule", "terms").toArrow().to_pylist()
    terms, of = _number(rows)
    wanted: dict[tuple, list[int]] = {}
    for r, ids in zip(rows, of, strict=True):
        if r["rule"] in whole:
            if ids and min(ids) >= 0:
                wanted.setdefault(tuple(sorted(set(ids))), []).append(r["row"])
        else:
            for i in {*ids} - {-1}:
                wanted.setdefault((i,), []).append(r["row"])
    sent = turn.sparkSession.sparkContext.broadcast((terms, list(wanted.items())))
    arrow = pa.schema([("row", pa.int64())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, missing = sent.value
        for _, h in _blocks(batches, terms):
            found = [bool(_every(h, list(ids)).any()) for ids, _ in missing]
            rows = sorted({r for ok, (_, its) in zip(found, missing, strict=True) if ok for r in its})
            missing = [x for ok, x in zip(found, missing, strict=True) if not ok]
            for at in range(0, len(rows), SENT):
                yield pa.RecordBatch.from_arrays([pa.array(rows[at : at + SENT], pa.int64())], schema=arrow)

    return docs.mapInArrow(met, "row long").distinct()


def plan_awards(turn: DataFrame, docs: DataFrame) -> DataFrame:
    """``case, seq, at, key, points, label``: awards of groups, ``case, seq, label, weight, bonus_points, required, bonus``.

    A bonus goes to the documents that the same or an earlier group of the case has scored.
    """
    rows = turn.toArrow().to_pylist()
    terms, of = _number([{"terms": r["required"] + r["bonus"]} for r in rows])
    cases: dict = {}
    for r, ids in zip(rows, of, strict=True):
        n = len(r["required"])
        cases.setdefault(r["case"], []).append((r["seq"], r["label"], r["weight"], r["bonus_points"], sorted(set(ids[:n])), list(zip(r["bonus"], ids[n:], strict=True))))
    sent = turn.sparkSession.sparkContext.broadcast((terms, [(k, sorted(v, key=lambda x: x[0])) for k, v in cases.items()]))
    schema = StructType([turn.schema["case"], turn.schema["seq"]]).add("at", "integer").add(docs.schema["key"]).add(StructField("points", turn.schema["weight"].dataType)).add("label", "string")
    arrow = to_arrow_schema(schema)

    def awarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, cases = sent.value
        for keys, h in _blocks(batches, terms):
            keyed = pa.array(keys, arrow.field("key").type)
            for case, groups in cases:
                scored = np.zeros(h.shape[1], np.uint8)
                for seq, label, weight, bonus_points, required, bonus in groups:
                    awards = []
                    if required[0] >= 0:
                        full = _every(h, required)
                        scored = scored | full
                        awards.append((0, weight, label, full))
                    awards += [(k + 1, bonus_points, f"+ {term}", h[i] & scored) for k, (term, i) in enumerate(bonus) if i >= 0]
                    for at, points, name, its in awards:
                        got = keyed.take(pa.array(np.flatnonzero(its)))
                        same = [pa.repeat(pa.scalar(x, arrow.field(c).type), len(got)) for c, x in (("case", case), ("seq", seq), ("at", at), ("points", points), ("label", name))]
                        if len(got):
                            yield pa.RecordBatch.from_arrays([*same[:3], got, *same[3:]], schema=arrow)

    return docs.mapInArrow(awarded, schema)
