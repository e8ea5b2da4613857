"""Carry-in states of a linear recurrence over the blocks of every session.

``state_after = P(n) state_before + own_state``. Composition is associative, so runs of
``RUN`` blocks are folded in parallel, the folded runs of a session (one small row per
``RUN`` blocks) are scanned, and the result is pushed back into the runs. Samples never
take part: one row of a few hundred numbers stands for a block. A block with lost samples has a row per contiguous run,
and a gap may reset the state.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subvox.plans.inorder import in_order

RUN = 1024
Power = Callable[[str, float, int], "np.ndarray | float"]
Begin = Callable[[str, float, int], np.ndarray]


def _matrix(values, channels: int) -> np.ndarray:
    return np.asarray(values, dtype=np.float64).reshape(-1, int(channels))


def _after(power: Power, row, state: np.ndarray) -> np.ndarray:
    p = power(row.mode, float(row.fs_hz), int(row.n))
    return (p @ state if np.ndim(p) == 2 else p * state) + _matrix(row.state, row.channels)


class _Fold:
    """End state of a whole run of blocks from a zero start; ``fixed`` where a gap inside makes it independent of the start."""

    def __init__(self, power: Power, begin: Begin, reset: bool):
        self.power, self.begin, self.reset = power, begin, reset
        self.state, self.n, self.first, self.row, self.fixed = None, 0, 0, None, False

    def __call__(self, row) -> list[tuple]:
        if self.row is None:
            self.state, self.first = _matrix(row.state, row.channels), int(row.first)
        else:
            if self.reset and row.first != self.row.last:
                self.fixed, self.state = True, self.begin(row.mode, float(row.fs_hz), int(row.channels))
            self.state = _after(self.power, row, self.state)
        self.n, self.row = self.n + int(row.n), row
        return []

    def finish(self) -> list[tuple]:
        r = self.row
        return [(r.session_id, r.run, self.first, r.last, self.n, self.fixed, r.mode, r.fs_hz, r.channels, self.state.ravel())]


def _walk(power: Power, first: Callable, fresh: Callable | None, out: Callable):
    """Emits ``out(row, state before it)``; starts from ``first(row)``, and from ``fresh(row)`` after a gap if that is given."""
    held: list = [None, None]

    def step(row) -> list[tuple]:
        state, end = held
        if state is None:
            state = first(row)
        elif fresh is not None and row.first != end:
            state = fresh(row)
        held[:] = _matrix(row.state, row.channels) if getattr(row, "fixed", False) else _after(power, row, state), row.last
        return [out(row, state)]

    return step


def carry_states(parts: DataFrame, power: Power, begin: Begin, run: int = RUN, *, on_gap: str = "carry") -> DataFrame:
    """``parts(session_id, block, start_sample, n_frames, n, mode, fs_hz, channels, state)`` to ``(session_id, block, start_sample, carry)``.

    A row of ``parts`` is a contiguous run of samples inside a block. ``state`` is the flattened ``(numbers, channels)`` end state of the row from
    a zero start, ``n`` the number of steps in it. Where samples are missing before a row, ``on_gap="reset"`` starts it from ``begin`` again, and
    ``"carry"`` goes on as if nothing were lost. The scan is a segmented one: a fold of rows with a gap inside has an end state of its own.
    """
    if on_gap not in ("carry", "reset"):
        raise ValueError(f"on_gap is carry or reset, not {on_gap!r}")
    reset = on_gap == "reset"
    sid = parts.schema["session_id"].dataType.simpleString()
    rows = parts.withColumn("run", F.floor(F.col("block") / run).cast("long"))
    rows = rows.withColumn("first", F.col("start_sample").cast("long")).withColumn("last", (F.col("start_sample") + F.col("n_frames")).cast("long")).drop("n_frames", "start_sample")
    rest = lambda row: begin(row.mode, float(row.fs_hz), int(row.channels))
    folded = in_order(
        rows, ["session_id", "run"], ["first"],
        f"session_id {sid}, run bigint, first bigint, last bigint, n bigint, fixed boolean, mode string, fs_hz double, channels int, state array<double>",
        lambda: _Fold(power, begin, reset),
    )
    starts = in_order(
        folded, ["session_id"], ["run"], f"session_id {sid}, run bigint, start array<double>",
        lambda: _walk(power, rest, rest if reset else None, lambda row, state: (row.session_id, row.run, state.ravel())),
    )
    return in_order(
        rows.join(starts, ["session_id", "run"]), ["session_id", "run"], ["first"], f"session_id {sid}, block bigint, start_sample bigint, carry array<double>",
        lambda: _walk(power, lambda row: _matrix(row.start, row.channels), rest if reset else None, lambda row, state: (row.session_id, row.block, row.first, state.ravel())),
    )
