"""Ordered machines whose keys may hold any share of the rows: chunks are summarised in parallel, composed, and replayed.

A key's rows are cut into chunks along their order. What a chunk does to the machine's state is a small summary that can be applied to any
state, such as ``x -> min(high, max(low, scale x + shift))`` for a clamped linear step or a table of jumps for a throttle.
Summaries of all chunks are made at once; a walk over one small row per chunk gives the state before each of them; then all chunks run
at once from those states. A state whose summary depends on another one is a later stage, which sees the earlier states.

Keys of one chunk, which are nearly all, take part in the last pass only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subvox.plans.inorder import in_order, in_order_frames

CHUNK = "_chunk"


class Stage(NamedTuple):
    """``summary(states, frame)`` of a chunk, given the states of earlier stages before it; ``advance(state, summary)``."""

    start: Any
    summary: Callable[[list, pd.DataFrame], Any]
    advance: Callable[[Any, Any], Any]


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right["_k" + name])
    return out


def chunked(rows: DataFrame, keys: Sequence[str], order: str, chunk: Column, stages: Sequence[Stage], replay: Callable[[list], Callable], schema: str) -> DataFrame:
    """Runs ``replay(states)``, a function from a frame of next rows to a frame of output, through every chunk of every key.

    ``states`` holds one state per stage, as it is before the chunk. A chunk's rows come in ``order``; ``chunk`` never decreases along it.
    A chunk is held by one task while it is summarised, so ``chunk`` bounds its rows. Null keys are a key.
    """
    keys = list(keys)
    each = [*keys, CHUNK]
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    laid = rows.withColumn(CHUNK, chunk.cast("long"))
    line = Window.partitionBy(*keys).orderBy(CHUNK)
    table = laid.groupBy(*each).agg(F.min(order).alias("_first")).withColumn("_before", F.lag(CHUNK).over(line)).withColumn("_more", F.lead(CHUNK).over(line).isNotNull())
    known = table.select(*[F.col(c).alias("_k" + c) for c in each], "_first", "_before", "_more", F.array().cast("array<binary>").alias("_states"))
    # Chunks that have another one behind them.
    open_ = known.where("_more")
    earlier = laid.join(open_.select(*["_k" + c for c in each]), _same(laid, open_, each), "left_semi")
    for i, stage in enumerate(stages):
        states = _states_before(earlier, known, each, order, stage, stages[:i], fields)
        after = states.select(*[F.col(c).alias("_s" + c) for c in keys], F.col(CHUNK).alias("_sbefore"), F.col("_state"))
        met = F.col("_before") == F.col("_sbefore")
        for k in keys:
            met = met & F.col("_k" + k).eqNullSafe(F.col("_s" + k))
        known = known.join(after, met, "left").select(*["_k" + c for c in each], "_first", "_before", "_more", F.concat("_states", F.array("_state")).alias("_states"))

    joined = laid.join(known, _same(laid, known, each), "left").select(laid["*"], F.when(F.col(order) == F.col("_first"), F.col("_states")).alias("_states"))

    def machine():
        held: list = []

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            if not held:
                held.append(replay(_loaded(pdf["_states"].iloc[0], stages)))
            return held[0](pdf.drop(columns=[CHUNK, "_states"]))

        return step

    return in_order_frames(joined, each, [order], schema, machine)


def _loaded(blobs, stages: Sequence[Stage]) -> list:
    if blobs is None or not hasattr(blobs, "__len__"):
        return [s.start for s in stages]
    return [s.start if b is None else pickle.loads(b) for s, b in zip(stages, blobs)]


def _states_before(earlier: DataFrame, known: DataFrame, each: list[str], order: str, stage: Stage, before: Sequence[Stage], fields: str) -> DataFrame:
    """``keys, _chunk, _state`` after each chunk that has another one behind it."""
    keys = each[:-1]

    def summarise(key: tuple, pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(states):
            return pd.DataFrame({c: [] for c in [*each, "_sum"]})
        made = stage.summary(_loaded(states["_states"].iloc[0], before), pdf.sort_values(order, kind="stable"))
        return pd.DataFrame([[*key, pickle.dumps(made)]], columns=[*each, "_sum"])

    here = known.where("_more").select(*[F.col("_k" + c).alias(c) for c in each], "_states")
    sums = earlier.groupBy(*each).cogroup(here.groupBy(*each)).applyInPandas(summarise, f"{fields}, {CHUNK} long, _sum binary")

    def walk():
        held = [stage.start]

        def step(row) -> list[tuple]:
            held[0] = stage.advance(held[0], pickle.loads(row[len(each)]))
            return [(*row[: len(each)], pickle.dumps(held[0]))]

        return step

    return in_order(sums, keys, [CHUNK], f"{fields}, {CHUNK} bigint, _state binary", walk)
