"""A fixed-window limiter over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limited(events: DataFrame, cap: int = 100, ts: str = "ts", key: str = "event_id", late: str = "1 day") -> DataFrame:
    """``event_id, ts, allowed``: the first ``cap`` events of each UTC day to arrive pass.

    The state is one counter a day, dropped when the watermark has passed the
    day.  Events behind the watermark are dropped.  Inside one batch events are
    counted in order of time and key.

    A day comes in Arrow batches and is read twice by bounded memory: of what
    has come, only the ``cap`` smallest are held; every other event is handed
    on at once as not allowed, since ``cap`` others of the batch come before
    it.
    """

    def count(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        left = max(0, cap - seen)
        held, total, end = None, 0, None
        for part in parts:
            if part.empty:
                continue
            end = int(part["_end"].iloc[0].timestamp() * 1000) if end is None else end
            total += len(part)
            rows = part[[key, ts]] if held is None else pd.concat([held, part[[key, ts]]], ignore_index=True)
            rows = rows.sort_values([ts, key], ignore_index=True)
            held, over = rows.iloc[:left], rows.iloc[left:].copy()
            if len(over):
                over["allowed"] = False
                yield over[[key, ts, "allowed"]]
        state.update((min(cap, seen + total),))
        if end is not None and end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        if held is not None and len(held):
            yield held.assign(allowed=True)[[key, ts, "allowed"]]

    marked = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(key, ts, F.to_date(ts).alias("_day"), (F.date_trunc("day", ts) + F.expr("interval 1 day")).alias("_end"))
    shape = f"{key} long, {ts} timestamp, allowed boolean"
    return marked.groupBy("_day").applyInPandasWithState(count, shape, "n int", "append", GroupStateTimeout.EventTimeTimeout)
