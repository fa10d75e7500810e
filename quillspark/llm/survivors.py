"""Best representative of each duplicate group (problem 3).

``fused`` is the method named: Bayesian fusion with copy detection.  The
accuracy of each source is estimated from how often its values win, with the
book's trust rank as prior; two sources are taken for dependent when they share
more false values than chance explains; copied votes are discounted, and the
value of the largest posterior survives, field by field.  Estimates are
repeated until they settle; ``sources`` and ``copies`` report them.

``survivors`` is the rule that the statement of the problem fixes (lowest trust
rank of the row's sources, then the latest merge, then the smallest row).  A
posterior estimated from the data can't reproduce a fixed order, so
``survivors`` doesn't use it; both share what counts as a complete value, and
``agreement`` tells for how many fields they choose the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.scratch import materialize, shared_dir

#: What stands for a missing value, without brackets and outer signs.
STAND_INS = ["n/a", "na", "nil", "none", "null", "unknown", "untitled", "unnamed", "tbd", "tba", "todo", "text wanting", "wanting", "see preceding", "illegible", "page missing", "missing", "no text", "not given", "not available", "no name", "blank", "empty", "xxx"]
#: Marks of omission at the end of a cut value.
OMISSION = r"(?U)\s*(?:\.{3,}|…|\(cont\.?\)|\(more\)|\[…\]|\[\.{3}\]|\(…\)|\(\.{3}\)|\(continued\)|\[cont\.?\]|\[more\])+\s*$"
#: Sources; the driver holds tables of at most so many squared counts.
MOST_SOURCES = 500
COPY_RATE, PRIOR_COPY, FALSE_VALUES = 0.8, 0.1, 10
#: Accuracy before any claim is seen: of the most and the least trusted source, and of rows without a known one; it weighs as so many claims.
MOST_TRUSTED, LEAST_TRUSTED, UNTRUSTED, PRIOR_CLAIMS = 0.85, 0.65, 0.6, 5
#: Estimates have settled when none moves by so much; so many rounds at most.
SETTLED, MOST_ROUNDS = 0.005, 10


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_value(c: Column) -> Column:
    """Not null, not blank and no stand-in."""
    bare = F.lower(F.regexp_replace(c, r"(?U)^[^\w]+|[^\w]+$", ""))
    return c.isNotNull() & (bare != "") & ~bare.isin(STAND_INS)


def _cut(known: dict[int, list[tuple]]):
    """Rows come in falling order of (id, field, s); ``v`` is null for a value, else the probe's own value.

    The first output pass (``known`` is None) hands on each part's last two values,
    the second knows those of the parts before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: list[tuple] = list(known[part]) if known is not None else []
        for batch in batches:
            out: list[list] = [[], [], []]
            for i, f, s, v in zip(*(c.to_pylist() for c in batch.columns)):
                if v is None:
                    if not seen or seen[-1] != (i, f, s):
                        seen = [*seen[-1:], (i, f, s)]
                elif known is not None and any(x[0] == i and x[1] == f and x[2] != v and len(x[2]) > len(s) and x[2].startswith(s) for x in seen):
                    for column, value in zip(out, (i, f, v)):
                        column.append(value)
            if known is not None:
                yield pa.record_batch([pa.array(c, pa.string()) for c in out], names=["id", "field", "v"])
        if known is None and seen:
            yield pa.record_batch([pa.array([part] * len(seen), pa.int32()), *[pa.array([x[k] for x in seen], pa.string()) for k in range(3)]], names=["part", "id", "field", "s"])

    return run


def cut_off(values: DataFrame) -> DataFrame:
    """Those of ``id, field, v`` whose value, without a mark of omission, begins another value of that id and field.

    One global sort with two carried values instead of a window by id, so one
    id of any size is spread over all tasks.  What goes to the driver is two
    values for each part of the sort.
    """
    spark = values.sparkSession
    shared_dir(spark)
    distinct = values.distinct()
    probes = distinct.select("id", "field", F.regexp_replace("v", OMISSION, "").alias("s"), "v").where("s <> ''")
    both = distinct.select("id", "field", F.col("v").alias("s"), F.lit(None).cast("string").alias("v")).union(probes)
    order = [F.desc("id"), F.desc("field"), F.desc("s")]
    rows = both.repartitionByRange(*order).sortWithinPartitions(*order, F.asc_nulls_last("v")).checkpoint()
    parts = rows.rdd.getNumPartitions()
    tails: dict[int, list[tuple]] = {}
    for r in rows.mapInArrow(_cut(None), "part int, id string, field string, s string").collect():
        tails.setdefault(r.part, []).append((r.id, r.field, r.s))
    known: dict[int, list[tuple]] = {}
    last: list[tuple] = []
    for p in range(parts):
        known[p] = last
        last = [*last, *tails.get(p, [])][-2:]
    return rows.mapInArrow(_cut(known), "id string, field string, v string")


def _checked(book: DataFrame) -> DataFrame:
    """The table of sources, which is broadcast; more than ``MOST_SOURCES`` are an error."""
    if book.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return book


def field_values(entity: DataFrame, book: DataFrame) -> DataFrame:
    """``id, field, row_id, v, rank, merged_at`` of all values that may be complete.

    ``v`` of the field ``sources`` is the known sources in order.
    """
    trust = _checked(book).select(F.lower(trimmed(F.col("source_id"))).alias("source"), "trust_rank")
    rows = entity.select(
        F.lower(trimmed(F.col("id"))).alias("id"),
        "row_id",
        "merged_at",
        F.col("names.primary").alias("primary"),
        F.get_json_object("traditional", "$.keynotes[0].text").alias("keynotes"),
        F.transform(F.coalesce("provenance.sources", F.array().cast("array<string>")), lambda s: F.lower(trimmed(s))).alias("sources"),
    ).where("id is not null")
    known = rows.select("row_id", F.explode(F.array_distinct("sources")).alias("source")).join(F.broadcast(trust), "source")
    ranks = known.groupBy("row_id").agg(F.min("trust_rank").alias("rank"), F.array_join(F.sort_array(F.collect_set("source")), "\n").alias("known"))
    ranked = rows.join(ranks, "row_id", "left")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("v")) for f, c in (("primary", trimmed(F.col("primary"))), ("keynotes", trimmed(F.col("keynotes"))), ("sources", F.col("known")))]))
    long = ranked.select("id", "row_id", "merged_at", "rank", "known", fields.alias("x")).select("id", "row_id", "merged_at", "rank", "known", "x.field", "x.v")
    return long.where(F.when(F.col("field") == "sources", F.col("v").isNotNull()).otherwise(is_value(F.col("v"))))


def duplicates(entity: DataFrame) -> DataFrame:
    """Ids of two or more rows."""
    return entity.groupBy(F.lower(trimmed(F.col("id"))).alias("id")).agg(F.count(F.lit(1)).alias("k")).where("id is not null and k > 1").select("id")


def complete_values(entity: DataFrame, book: DataFrame) -> DataFrame:
    """``field_values`` of ids with duplicates, without cut-off values."""
    values = materialize(field_values(entity, book).join(duplicates(entity), "id", "left_semi"), "values")
    short = cut_off(values.where("field <> 'sources'").select("id", "field", "v"))
    return values.join(short, ["id", "field", "v"], "left_anti")


def survivors(entity: DataFrame, book: DataFrame) -> DataFrame:
    """``id, field, row_id`` of the surviving value of each field of each id with two or more rows.

    Null ids are no group; a field without a complete value has no row; ties
    go to the smallest ``row_id``; an empty table gives no rows.
    """
    best = F.min_by("row_id", F.struct(F.col("rank").isNull(), "rank", F.col("merged_at").isNull(), -F.unix_micros(F.col("merged_at").cast("timestamp")), "row_id"))
    return complete_values(entity, book).groupBy("id", "field").agg(best.alias("row_id"))


def _votes(weights: np.ndarray, dependence: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(-weights, kind="stable")
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        for batch in batches:
            votes = []
            for sources in batch.column(3).to_pylist():
                taken, vote = [], 0.0
                for s in sorted(sources, key=place.__getitem__):
                    vote += weights[s] * float(np.prod(1 - COPY_RATE * dependence[s, taken])) if taken else weights[s]
                    taken.append(s)
                votes.append(vote)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(votes, pa.float64())], names=["id", "field", "v", "sources", "vote"])

    return run


@dataclass
class Fusion:
    """Claims and what was estimated from them; sources are numbered, the last stands for rows without a known one."""

    values: DataFrame
    names: list[str]
    accuracy: np.ndarray
    dependence: np.ndarray
    claims: np.ndarray
    shared: dict[tuple[int, int], tuple[int, int, int]] = field(default_factory=dict)
    rounds: int = 0


def prior_accuracy(ranks: list[int]) -> np.ndarray:
    """Falls evenly with the place in the order of trust; the last is that of rows without a known source."""
    place = np.argsort(np.argsort(ranks, kind="stable"), kind="stable") / max(1, len(ranks) - 1)
    return np.append(MOST_TRUSTED - (MOST_TRUSTED - LEAST_TRUSTED) * place, UNTRUSTED)


_VOTED = "id string, field string, v string, sources array<int>, vote double"


def _voted(f: Fusion) -> DataFrame:
    return f.values.mapInArrow(_votes(np.log(FALSE_VALUES * f.accuracy / (1 - f.accuracy)), f.dependence), _VOTED)


def _shares(f: Fusion, told: DataFrame) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Of each two sources: true values, false values and fields with different values that they have in common; at most ``MOST_SOURCES`` squared."""
    pairs = told.select("right", F.explode("sources").alias("a"), "sources").select("right", "a", F.explode(F.filter("sources", lambda b: b > F.col("a"))).alias("b"))
    same = {(r.a, r.b): (r.good, r.bad) for r in pairs.groupBy("a", "b").agg(F.count_if("right").alias("good"), F.count_if(~F.col("right")).alias("bad")).collect()}
    items = told.select("id", "field", F.explode("sources").alias("a")).groupBy("id", "field").agg(F.collect_set("a").alias("s"))
    met = items.select(F.explode("s").alias("a"), "s").select("a", F.explode(F.filter("s", lambda b: b > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    return {(r.a, r.b): (*same.get((r.a, r.b), (0, 0)), max(0, r.k - sum(same.get((r.a, r.b), (0, 0))))) for r in met.collect()}


def copy_probability(shared: tuple[int, int, int], x: float, y: float) -> float:
    """How likely sources of these accuracies copy, given their common true, false and different values."""
    right, wrong, other = shared
    pt, pf, a = x * y, (1 - x) * (1 - y) / FALSE_VALUES, (x + y) / 2
    logs = right * np.log(pt / (a * COPY_RATE + pt * (1 - COPY_RATE))) + wrong * np.log(pf / ((1 - a) * COPY_RATE + pf * (1 - COPY_RATE))) - other * np.log(1 - COPY_RATE)
    return float(1 / (1 + (1 - PRIOR_COPY) / PRIOR_COPY * np.exp(min(600.0, logs))))


def fit(entity: DataFrame, book: DataFrame) -> Fusion:
    """Accuracies and dependences, estimated in turns until they settle.

    A row without a known source votes as one source of its own kind.  Groups
    are pre-aggregated to distinct (value, source), so an id of any size holds
    at most sources x values claims; what the driver gets are counts by source
    and by two sources.
    """
    trust = {r.s: r.trust_rank for r in _checked(book).select(F.lower(trimmed(F.col("source_id"))).alias("s"), "trust_rank").where("s is not null").orderBy(F.desc_nulls_first("trust_rank")).collect()}
    names = sorted(trust)
    number = F.create_map(*[F.lit(x) for k, s in enumerate(names) for x in (s, k)]) if names else F.create_map().cast("map<string,int>")
    n = len(names) + 1
    claims = complete_values(entity, book).withColumn("source", F.explode(F.split(F.coalesce("known", F.lit("?")), "\n"))).select("id", "field", "v", F.coalesce(F.try_element_at(number, "source"), F.lit(n - 1)).alias("source"))
    values = materialize(claims.groupBy("id", "field", "v").agg(F.sort_array(F.collect_set("source")).alias("sources")), "claims")
    prior = prior_accuracy([trust[s] if trust[s] is not None else 1 << 31 for s in names])
    f = Fusion(values, [*names, "?"], prior.copy(), np.zeros((n, n)), np.zeros(n, np.int64))
    for f.rounds in range(1, MOST_ROUNDS + 1):
        won = _voted(f).groupBy("id", "field").agg(F.max_by("v", F.struct("vote", "v")).alias("best"), F.count(F.lit(1)).alias("rivals"))
        won = materialize(won.where("rivals > 1 and field <> 'sources'").select("id", "field", "best"), "truths")  # what sources say of themselves is no evidence
        told = values.join(won, ["id", "field"]).withColumn("right", F.col("v") == F.col("best"))
        f.shared = _shares(f, told)
        tally = {r.a: (r.good, r.all) for r in told.select("right", F.explode("sources").alias("a")).groupBy("a").agg(F.count_if("right").alias("good"), F.count(F.lit(1)).alias("all")).collect()}  # a row a source
        accuracy, dependence = f.accuracy.copy(), np.zeros((n, n))
        # copying is judged before accuracies are: sources that outvote others by copying look right
        for (a, b), shared in f.shared.items():
            dependence[a, b] = dependence[b, a] = copy_probability(shared, f.accuracy[a], f.accuracy[b])
        for s in range(n):
            good, f.claims[s] = tally.get(s, (0, 0))
            if f.rounds > 1:
                accuracy[s] = min(0.99, max(0.05, (good + PRIOR_CLAIMS * prior[s]) / (f.claims[s] + PRIOR_CLAIMS)))
        moved = max(np.abs(accuracy - f.accuracy).max(), np.abs(dependence - f.dependence).max())
        f.accuracy, f.dependence = accuracy, dependence
        if f.rounds > 1 and moved < SETTLED:
            break
    return f


def fused(entity: DataFrame, book: DataFrame, fitted: Fusion | None = None) -> DataFrame:
    """``id, field, v, posterior, votes`` of the value of largest posterior; equal ones go to the larger value."""
    f = fitted or fit(entity, book)
    won = _voted(f).groupBy("id", "field").agg(F.max_by("v", F.struct("vote", "v")).alias("best"), F.sum(F.exp(F.least("vote", F.lit(600.0)))).alias("mass"), F.max("vote").alias("top"), F.count(F.lit(1)).alias("rivals"))
    lone = F.greatest(F.lit(0.0), F.lit(float(FALSE_VALUES + 1)) - F.col("rivals"))
    return won.select("id", "field", F.col("best").alias("v"), (F.exp(F.least("top", F.lit(600.0))) / (F.col("mass") + lone)).alias("posterior"), F.round("top", 6).alias("votes"))


def sources(entity: DataFrame, book: DataFrame, fitted: Fusion | None = None) -> DataFrame:
    """``source, accuracy, claims, copies_of, dependence, rounds``: the estimates of each source, with the source that it most likely shares its values with."""
    f = fitted or fit(entity, book)
    most = f.dependence.argmax(1)
    rows = [(s, float(f.accuracy[k]), int(f.claims[k]), f.names[most[k]] if f.dependence[k, most[k]] > 0.5 else None, float(f.dependence[k, most[k]]), f.rounds) for k, s in enumerate(f.names)]
    return entity.sparkSession.createDataFrame(rows, "source string, accuracy double, claims long, copies_of string, dependence double, rounds int")


def agreement(entity: DataFrame, book: DataFrame) -> DataFrame:
    """``field, groups, same``: for how many ids the fused value is that of the surviving row."""
    ruled = survivors(entity, book).join(field_values(entity, book).select("row_id", "field", F.col("v").alias("ruled")), ["row_id", "field"])
    both = ruled.join(fused(entity, book), ["id", "field"])
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("v") == F.col("ruled")).alias("same"))
