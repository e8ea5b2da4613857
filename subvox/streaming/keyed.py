"""Runs the small state machines of the batch operators on Structured Streaming.

Each key keeps one compact state row. A micro-batch brings its new rows, they are put in
order and fed through the same step the batch twin uses, so both give the same answers.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[Any, Any], tuple[Any, list[tuple]]]
Feed = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


def keyed(stream: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, start: Callable[[], Any], step: Step, idle_ms: int | None = None) -> DataFrame:
    """``step(state, row) -> (state, rows)`` per row of a key, in the given order.

    With ``idle_ms`` a key that is silent that long gives its state back; use it for
    queries that run all the time, not for ``availableNow`` runs, which would wait for it.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def feed(state: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        out: list[tuple] = []
        for row in rows.itertuples(index=False):
            state, more = step(state, row)
            out.extend(more)
        return state, pd.DataFrame(out, columns=names)

    return keyed_frames(stream, keys, order, schema, start, feed, idle_ms)


def keyed_frames(stream: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, start: Callable[[], Any], feed: Feed, idle_ms: int | None = None) -> DataFrame:
    """``feed(state, frame) -> (state, frame)`` once for the new rows of a key in a micro-batch, in the given order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], saved: GroupState) -> Iterator[pd.DataFrame]:
        if saved.hasTimedOut:
            saved.remove()
            return
        state = pickle.loads(saved.get[0]) if saved.exists else start()
        state, out = feed(state, pd.concat(list(batches)).sort_values(list(order), kind="stable"))
        saved.update((pickle.dumps(state),))
        if idle_ms:
            saved.setTimeoutDuration(idle_ms)
        yield out

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", timeout)
