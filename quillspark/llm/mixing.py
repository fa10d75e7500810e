"""Mixing sources to target weights (problem 7).

Weighted fair queueing: the documents of each source are shuffled by hash, as
often as the source may be repeated, pass after pass.  A draw's virtual finish
time is the running sum of its source's tokens over the source's weight; the
draws, range-sorted by finish time and cut at the budget, keep every source at
its share for as long as it lasts.  A source that runs out falls short, and the
others share what it leaves in proportion to their weights.

The virtual time at which the budget is spent follows from the sources' totals
alone, so only the passes that begin before it are drawn.  No source is one
task's work: running sums are taken in hash buckets, and over the parts of the
range sort, whose totals are added up first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.token_counts import VOCABULARY, count_tokens
from quillspark.plans.scratch import materialize

BUCKET_ROWS = 20_000
#: Sources with a target: so many rows are broadcast and held by the driver.
MOST_TARGETS = 10_000
#: The budget, if none is given, as a share of the tokens of all mixed sources.
BUDGET_SHARE = 0.5


def _source(name: str) -> Column:
    return F.lower(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""))


def _weights(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.where("source is not null and target_share > 0 and max_repeat > 0").select(_source("source").alias("source"), "target_share", "max_repeat").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return [tuple(r) for r in rows]


def end_time(totals: dict[str, int], weights: list[tuple[str, float, int]], budget: int) -> float:
    """The virtual time at which the budget is spent: each source gives its weight times the time, as long as it lasts."""
    lasting = sorted((most * totals[s] / share, share, most * totals[s]) for s, share, most in weights if totals.get(s))
    spent, rate = 0, sum(share for _, share, _ in lasting)
    for end, share, tokens in lasting:
        if spent + rate * end >= budget:
            return (budget - spent) / rate
        spent, rate = spent + tokens, rate - share
    return math.inf


def draws(sizes: DataFrame, targets: DataFrame, seed: int = 7, budget: int | None = None) -> DataFrame:
    """``source, use, doc_id, tokens, finish`` of every draw that may be made; with a ``budget``, without the passes that begin after it is spent."""
    spark = sizes.sparkSession
    weights = _weights(targets)
    totals = {r.source: r.t for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t")).join(F.broadcast(spark.createDataFrame(weights, "source string, target_share double, max_repeat int")), "source", "left_semi").collect()} if weights else {}
    until = math.inf if budget is None else end_time(totals, weights, budget)
    rows = [(s, share, most if math.isinf(until) else min(most, math.floor(until * share / totals[s]) + 1)) for s, share, most in weights if totals.get(s)]
    mixed = sizes.join(F.broadcast(spark.createDataFrame(rows, "source string, target_share double, passes int")), "source")
    buckets = max(8, math.ceil(sizes.count() / BUCKET_ROWS))
    each = mixed.withColumn("use", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("place", F.xxhash64("doc_id", "use", F.lit(seed)))
    each = each.withColumn("bucket", F.pmod("place", F.lit(buckets)))
    totals_of = each.groupBy("source", "use", "bucket").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("use", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals_of.withColumn("offset", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    inner = Window.partitionBy("source", "use", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.join(offset, ["source", "use", "bucket"]).withColumn("finish", (F.col("offset") + F.sum("tokens").over(inner)) / F.col("target_share"))
    return summed.select("source", "use", "doc_id", "tokens", "finish")


def _cut(all_draws: DataFrame, budget: int) -> DataFrame:
    """The draws of lowest finish time whose tokens stay within the budget: a range sort, with the sums of the parts before."""
    order = ["finish", "source", "use", "doc_id"]
    part = materialize(all_draws.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = part.groupBy("_part").agg(F.sum("tokens").alias("_t"))  # one row a part
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before")).where(F.col("_before") <= budget)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = part.join(F.broadcast(before), "_part").withColumn("_sum", F.col("_before") + F.sum("tokens").over(inside))
    return summed.where(F.col("_sum") <= budget).select("source", "use", "doc_id", "tokens", "finish")


def mix(df: DataFrame, targets: DataFrame, budget: int | None = None, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``source, use, doc_id, tokens, finish`` of the draws of the mixture, in order of finish time.

    Sources are compared without outer blanks and case.  Documents of sources
    without a target, and null or empty texts, are never drawn; a source that
    isn't there draws nothing; draws of equal finish time are ordered by
    source, use and key.
    """
    keep = [F.col(key).cast("long").alias("doc_id"), _source("source").alias("source")]
    wanted = df.sparkSession.createDataFrame([(s,) for s, *_ in _weights(targets)], "source string").distinct()
    sizes = materialize(count_tokens(df.withColumn("source", _source("source")).join(F.broadcast(wanted), "source", "left_semi"), text, keep, path), "sizes")
    if budget is None:
        budget = int((sizes.agg(F.sum("tokens")).first()[0] or 0) * BUDGET_SHARE)
    return _cut(draws(sizes, targets, budget=budget), budget).orderBy("finish", "source", "use", "doc_id")


def shares(drawn: DataFrame, targets: DataFrame, df: DataFrame, text: str = "text") -> DataFrame:
    """``source, target_share, documents, draws, tokens, share, most_uses, state`` of each source with a target.

    ``state`` tells why a share is what it is: ``lasted`` to the end of the
    budget, ``used up`` (every document of ``df`` as often as allowed), or ``absent``.
    """
    there = df.where(F.length(text) > 0).groupBy(_source("source").alias("source")).agg(F.count(F.lit(1)).alias("_there"))
    by = drawn.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("draws"), F.sum("tokens").alias("tokens"), (F.max("use") + 1).alias("most_uses"))
    everything = Window.partitionBy()  # over one row a source
    full = targets.select(_source("source").alias("source"), "target_share", "max_repeat").join(by, "source", "left").join(there, "source", "left").withColumn("_all", F.sum("tokens").over(everything))
    zero = F.lit(0).cast("long")
    state = F.when(F.col("draws").isNull(), "absent").when(F.col("draws") == F.col("_there") * F.col("max_repeat"), "used up").otherwise("lasted")
    return full.select("source", "target_share", F.coalesce("documents", zero).alias("documents"), F.coalesce("draws", zero).alias("draws"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), state.alias("state"))


def check(drawn: DataFrame, targets: DataFrame, df: DataFrame, text: str = "text") -> DataFrame:
    """``source, target_share, repeated, too_often, off_share`` of each source with a target.

    Draws that come twice, documents drawn more often than allowed, and whether
    a source that lasted is off its share among those that lasted by more than
    the last, unfinished draws of these explain: 0 in a right mixture.
    """
    twice = drawn.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("use").alias("uses"), F.max("tokens").alias("large"))
    by = twice.groupBy("source").agg(F.sum(F.col("n") - F.col("uses")).alias("repeated"), F.max("n").alias("most"), F.max("large").alias("large"))
    s = shares(drawn, targets, df, text).withColumn("_lasting", F.col("state") == "lasted")
    among = Window.partitionBy("_lasting")
    right = F.col("target_share") / F.sum("target_share").over(among)
    slack = F.max("large").over(among) * F.greatest(F.lit(1.0), F.count(F.lit(1)).over(among) * right)
    off = F.col("_lasting") & (F.abs(F.col("tokens") - right * F.sum("tokens").over(among)) > slack)
    full = s.join(by, "source", "left").withColumn("off", off).join(targets.select(_source("source").alias("source"), "max_repeat"), "source")
    return full.select("source", "target_share", F.coalesce("repeated", F.lit(0)).cast("int").alias("repeated"), F.coalesce(F.greatest(F.lit(0), F.col("most") - F.col("max_repeat")), F.lit(0)).cast("int").alias("too_often"), F.coalesce("off", F.lit(False)).cast("int").alias("off_share"))
