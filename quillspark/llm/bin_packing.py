"""Filling fixed-capacity containers with items (problem 6).

Vector bin packing with the dot-product heuristic: an item is the vector of
its tokens, one segment and its loss-bearing tokens, and a container has a
limit in each; the open container takes the fitting item whose product with the
container's remaining room is largest, until none fits.  Loss-bearing are all
tokens but those of the prompt, the first of several lines.

All three limits bind: long answers fill the loss limit before the tokens,
short ones the segments, so they are put together with others; ``fill`` reports
how many containers are full in each.  An item that alone exceeds the loss
limit, but not the capacity, may not be split and gets a container of its own.

Items are spread by hash over shards of a bounded number of containers, packed
shard by shard, so no task grows with the data.  Containers that stay loose are
emptied and packed again with those of other shards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.token_counts import VOCABULARY, count_tokens
from quillspark.plans.scratch import materialize

#: Containers a shard is meant to fill; a shard's work is bounded by it.
SHARD_BINS = 1500
#: A container has a segment to at least so many tokens of capacity, and two at least.
SEGMENT_TOKENS = 64
#: The share of the capacity that may be loss-bearing.
LOSS_SHARE = 0.95
#: Kinds of container; each takes all items once more.
MOST_KINDS = 1_000
#: A container is full in a dimension from this share of its limit.
FULL = 0.995
#: A container with a larger unused share is packed again.
LOOSE = 0.005
OUT = "bin_kind string, bin_id long, slot int, doc_id long, piece int, token_start int, tokens int, loss_tokens int, unused int"


def limits(capacity: int, segment_tokens: int = SEGMENT_TOKENS, loss_share: float = LOSS_SHARE) -> tuple[int, int, int]:
    """Tokens, segments and loss-bearing tokens that a container may hold."""
    return capacity, max(2, capacity // segment_tokens), max(1, math.ceil(capacity * loss_share))


def pack(tokens: np.ndarray, loss: np.ndarray, most: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Container and slot of each item under the limits; items that alone exceed the last one stay alone."""
    bins, slots = np.empty(len(tokens), np.int64), np.zeros(len(tokens), np.int32)
    alone = np.flatnonzero(loss > most[2])
    bins[alone] = np.arange(len(alone))
    number = len(alone)
    rest = np.flatnonzero(loss <= most[2])
    if not len(rest):
        return bins, slots
    most = np.array(most, float)
    order = rest[np.lexsort((loss[rest], tokens[rest]))[::-1]]
    kinds, first, count = np.unique(np.stack([tokens[order], loss[order]], 1), axis=0, return_index=True, return_counts=True)
    left = count.copy()
    t, q = kinds[:, 0].astype(float), kinds[:, 1].astype(float)
    alive = np.arange(len(kinds))
    size = np.stack([t / most[0], np.full(len(t), 1 / most[1]), q / most[2]])
    while len(alive):
        room = most.copy()
        slot = 0
        fit = alive
        while len(fit) and room[1] >= 1:
            fit = fit[(t[fit] <= room[0]) & (q[fit] <= room[2]) & (left[fit] > 0)]
            if not len(fit):
                break
            k = fit[np.argmax((room / most) @ size[:, fit])]
            item = order[first[k] + left[k] - 1]
            left[k] -= 1
            bins[item], slots[item] = number, slot
            slot += 1
            room -= (t[k], 1, q[k])
        number += 1
        alive = alive[left[alive] > 0]
    return bins, slots


def _shard(most: dict[str, tuple[int, int, int]]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        limit = most[pdf["bin_kind"].iat[0]]
        bins, slots = pack(pdf["tokens"].to_numpy(), pdf["loss_tokens"].to_numpy(), limit)
        pdf["unused"] = (limit[0] - np.bincount(bins, pdf["tokens"])[bins]).astype("int32")
        pdf["bin_id"] = (pdf["shard"].to_numpy().astype("int64") << 24) + bins
        pdf["slot"] = slots
        return pdf[["bin_kind", "bin_id", "slot", "doc_id", "piece", "token_start", "tokens", "loss_tokens", "unused"]]

    return run


def _capacities(bins: DataFrame) -> dict[str, int]:
    rows = bins.where("bin_kind is not null and capacity_tokens > 0").select("bin_kind", "capacity_tokens").limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    return {r.bin_kind: r.capacity_tokens for r in rows}


def _packed(items: DataFrame, most: dict[str, tuple[int, int, int]], turn: int) -> DataFrame:
    sums = {r.bin_kind: r.t for r in items.groupBy("bin_kind").agg(F.sum("tokens").alias("t")).collect()}
    if not sums:
        return items.sparkSession.createDataFrame([], OUT)
    shards = F.create_map(*[F.lit(x) for k, t in sums.items() for x in (k, max(1, math.ceil(t / most[k][0] / SHARD_BINS)))])
    hashed = items.withColumn("shard", (F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.try_element_at(shards, "bin_kind")) + F.lit(turn << 36)).cast("long"))
    return hashed.groupBy("bin_kind", "shard").applyInPandas(_shard(most), OUT)


def containers(df: DataFrame, bins: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, segment_tokens: int = SEGMENT_TOKENS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """``bin_kind, bin_id, slot, doc_id, piece, token_start, tokens, loss_tokens, unused`` of all texts in each kind of container.

    ``bins`` holds few kinds (``bin_kind, capacity_tokens``), each takes all
    texts.  A text larger than the capacity is cut into full pieces and a rest;
    no other is cut.  Null and empty texts hold no token and come in no
    container; a key that comes twice is two items; kinds with no or no
    positive capacity are left out.
    """
    capacities = _capacities(bins)
    most = {k: limits(c, segment_tokens, loss_share) for k, c in capacities.items()}
    if not capacities:
        return df.sparkSession.createDataFrame([], OUT)
    sizes = materialize(count_tokens(df.where(F.col(key).isNotNull()), text, [F.col(key).cast("long").alias("doc_id")], path), "tokens")
    kinds = F.explode(F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])).alias("bin_kind", "capacity")
    cut = sizes.select("doc_id", "tokens", "prompt", kinds).select("*", F.posexplode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("capacity")).cast("int"))).alias("piece", "_p"))
    start = F.col("piece") * F.col("capacity")
    piece = F.least("capacity", F.col("tokens") - start)
    asked = F.greatest(F.lit(0), F.least(piece, F.col("prompt") - start))
    items = cut.select("bin_kind", "doc_id", F.col("piece").cast("int").alias("piece"), start.cast("int").alias("token_start"), piece.cast("int").alias("tokens"), (piece - asked).cast("int").alias("loss_tokens"))
    first = materialize(_packed(items, most, 0), "packed")
    share = F.col("unused") / F.try_element_at(F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair]), "bin_kind")
    loose = first.where(share > LOOSE)
    again = _packed(loose.drop("bin_id", "slot", "unused"), most, 1)
    return first.where(share <= LOOSE).unionByName(again)


def _used(packed: DataFrame) -> DataFrame:
    return packed.groupBy("bin_kind", "bin_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("segments"), F.sum("loss_tokens").alias("loss"))


def _with_limits(df: DataFrame, bins: DataFrame, segment_tokens: int, loss_share: float) -> DataFrame:
    rows = [(k, *limits(c, segment_tokens, loss_share)) for k, c in _capacities(bins).items()]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, "bin_kind string, capacity long, most_segments long, most_loss long")), "bin_kind")


def fill(packed: DataFrame, bins: DataFrame, segment_tokens: int = SEGMENT_TOKENS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """``bin_kind, capacity, containers, tokens, unused_share, least_containers`` of a packing, and how many containers are full in each dimension (``full_tokens, full_segments, full_loss``)."""
    one = _with_limits(_used(packed), bins, segment_tokens, loss_share)
    full = lambda used, most: F.count_if(F.col(used) >= F.col(most) * FULL)
    total = one.groupBy("bin_kind", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), full("t", "capacity").alias("full_tokens"), full("segments", "most_segments").alias("full_segments"), full("loss", "most_loss").alias("full_loss"))
    return total.select("bin_kind", "capacity", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "full_tokens", "full_segments", "full_loss")


def check(packed: DataFrame, bins: DataFrame, segment_tokens: int = SEGMENT_TOKENS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """``bin_kind, capacity, documents, over_tokens, over_segments, over_loss, torn, cut`` of a packing.

    Containers over a limit (of those over the loss limit only such as hold
    more than one item), texts whose pieces don't follow one another without a
    gap, and texts cut although a container holds them: all but ``documents``
    are 0 in a right packing.
    """
    over = lambda used, most, more=F.lit(True): F.count_if((F.col(used) > F.col(most)) & more)
    one = _with_limits(_used(packed), bins, segment_tokens, loss_share)
    boxes = one.groupBy("bin_kind", "capacity").agg(over("t", "capacity").alias("over_tokens"), over("segments", "most_segments").alias("over_segments"), over("loss", "most_loss", F.col("segments") > 1).alias("over_loss"))
    texts = packed.groupBy("bin_kind", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("k"), F.sum("tokens").alias("t"), F.max(F.col("token_start") + F.col("tokens")).alias("end"))
    limit = _with_limits(texts, bins, segment_tokens, loss_share)
    torn = limit.groupBy("bin_kind").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("t") != F.col("end")) | (F.col("pieces") != F.col("k"))).alias("torn"), F.count_if((F.col("k") > 1) & (F.col("t") <= F.col("capacity"))).alias("cut"))
    return boxes.join(torn, "bin_kind").select("bin_kind", "capacity", "documents", "over_tokens", "over_segments", "over_loss", "torn", "cut")
