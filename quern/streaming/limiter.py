"""Sliding-window admission per key: a rejected event does not count against later ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: Iterable[float], limit: int, window: float, recent: deque | None = None) -> tuple[list[bool], deque]:
    """Whether each event, in order of time, is admitted; and the admitted ones still counting."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    recent = deque() if recent is None else recent
    out = []
    for now in times:
        while recent and recent[0] <= now - window:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(now)
    return out, recent


def admit_batch(events: DataFrame, key: str, time: str, order: str, limit: int, window_seconds: float) -> DataFrame:
    """events (key, time in seconds, order to break ties) with ``admitted``. The rule is recursive,
    so the events of a key are walked in order; they stream through in batches, and the state is
    at most ``limit`` times, whatever the number of events."""
    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for pdf in batches:
            keys, times = pdf[key].to_numpy(), pdf[time].to_numpy()
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            out: list[bool] = []
            for a, b in zip(starts, starts[1:]):
                if a < b:
                    if keys[a] != current:
                        current, recent = keys[a], deque()
                    ok, recent = admit(times[a:b], limit, window_seconds, recent)
                    out += ok
            yield pdf.assign(admitted=out)

    return events.repartition(key).sortWithinPartitions(key, time, order).mapInPandas(run, f"{schema}, admitted boolean")


def admit_stream(events: DataFrame, key: str, time: str, limit: int, window_seconds: float) -> DataFrame:
    """The same over a stream of (key string, time double); state is kept per key and dropped
    once idle for a window."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        ok, recent = admit(iter(rows[time]), limit, window_seconds, recent)
        state.update((list(recent),))
        state.setTimeoutDuration(int(window_seconds * 1000))
        yield pd.DataFrame({key: k[0], time: rows[time], "admitted": ok})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} string, {time} double, admitted boolean", "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
