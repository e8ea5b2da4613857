"""Causal and zero-phase filters and running normalisation over whole recordings.

Inputs are block rows with ``mode`` and ``fs_hz`` attached. Session-scope operators run
the block scan of :mod:`subvox.plans.scan`; event-scope operators work row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from subvox.functions.design import LinearFilter, low_filter, mode_filter
from subvox.functions.kernels import chunk_motion, frames, zscore
from subvox.plans.joins import spread_join
from subvox.plans.scan import carry_states

EMA_CHUNK = 128
Maker = Callable[[str, float], LinearFilter]


def with_session(blocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attaches ``mode`` and ``fs_hz`` of the session to its blocks."""
    facts = sessions.select("session_id", "mode", F.col("fs_hz").cast("double").alias("fs_hz"))
    return spread_join(blocks, facts, ["session_id"], salt_by=["block"])


def _sid(df: DataFrame) -> str:
    return df.schema["session_id"].dataType.simpleString()


#: A row of a recording: a contiguous run of samples of one block.
ROW = ["session_id", "block", "start_sample"]


def _carries(blocks: DataFrame, make: Maker, at_rest: bool, on_gap: str = "carry") -> DataFrame:
    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [
                make(m, fs).end_state(frames(x, c)).ravel()
                for m, fs, c, x in zip(pdf["mode"], pdf["fs_hz"], pdf["channels"], pdf["samples"])
            ]
            yield pdf[[*ROW, "n_frames", "mode", "fs_hz", "channels"]].assign(n=pdf["n_frames"], state=ends)

    parts = blocks.select(*ROW, "n_frames", "mode", "fs_hz", "channels", "samples").mapInPandas(
        states, f"session_id {_sid(blocks)}, block bigint, start_sample bigint, n_frames int, n int, mode string, fs_hz double, channels int, state array<double>"
    )

    def begin(mode: str, fs: float, channels: int) -> np.ndarray:
        flt = make(mode, fs)
        return flt.begin(channels) if at_rest else np.zeros((flt.size, channels))

    return carry_states(parts, lambda mode, fs, n: make(mode, fs).power(n), begin, on_gap=on_gap)


def filter_sessions(blocks: DataFrame, make: Maker = mode_filter, *, at_rest: bool = True, on_gap: str = "carry") -> DataFrame:
    """Runs one causal filter through each whole session and returns block rows.

    Equal to filtering the session sample by sample from the rest state (``at_rest``) or
    from zero. Where samples are lost the filter goes on from the state before (``on_gap="carry"``, as a live chain that is not told)
    or starts anew (``"reset"``). Cost: a pass for the end states, a scan over one small row per block, and
    one join that brings each block its carry-in state.
    """
    joined = blocks.join(_carries(blocks, make, at_rest, on_gap), ROW)
    keep = ["session_id", "block", "start_sample", "n_frames", "channels", "mode", "fs_hz"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                make(m, fs).run(frames(x, c), frames(s, c))[0].ravel()
                for m, fs, c, x, s in zip(pdf["mode"], pdf["fs_hz"], pdf["channels"], pdf["samples"], pdf["carry"])
            ]
            yield pdf[keep].assign(samples=out)

    return joined.select(*keep, "samples", "carry").mapInPandas(
        run,
        f"session_id {_sid(blocks)}, block bigint, start_sample bigint, n_frames int, channels int, mode string, "
        "fs_hz double, samples array<double>",
    )


def bandpass_causal(blocks: DataFrame, harmonics: bool = False, on_gap: str = "carry") -> DataFrame:
    """Band-pass of the session's mode, then the line notch."""
    return filter_sessions(blocks, lambda mode, fs: mode_filter(mode, fs, harmonics=harmonics), on_gap=on_gap)


def motion_sessions(blocks: DataFrame, cut_hz: float = 5.0, on_gap: str = "carry") -> DataFrame:
    """Motion index, baseline wander and RMS power of whole sessions (means over channels).

    The low-pass runs through the block scan, but only sums of squares leave the tasks.
    Sessions whose rate cannot carry the cut have no motion.
    """
    carries = _carries(blocks.where(F.col("fs_hz") / 2 > cut_hz), lambda mode, fs: low_filter(4, cut_hz, fs), False, on_gap)
    joined = blocks.join(carries, ROW, "left")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s, fs, c, x, z in zip(pdf["session_id"], pdf["fs_hz"], pdf["channels"], pdf["samples"], pdf["carry"]):
                data = frames(x, c)
                y = np.zeros_like(data) if z is None else low_filter(4, cut_hz, fs).run(data, frames(z, c))[0]
                rows += zip([s] * c, range(c), [len(data)] * c, (data**2).sum(axis=0), (y**2).sum(axis=0))
            yield pd.DataFrame(rows, columns=["session_id", "channel", "n", "xx", "yy"])

    parts = joined.select("session_id", "fs_hz", "channels", "samples", "carry").mapInPandas(
        sums, f"session_id {_sid(blocks)}, channel int, n bigint, xx double, yy double"
    )
    per = parts.groupBy("session_id", "channel").agg(
        F.sqrt(F.sum("xx") / F.sum("n")).alias("rms"), F.sqrt(F.sum("yy") / F.sum("n")).alias("wander")
    )
    index = F.least(F.lit(1.0), F.col("wander") / (F.col("rms") + 1e-6))
    return per.groupBy("session_id").agg(
        F.avg(index).alias("motion_index"), F.avg("wander").alias("baseline_wander"), F.avg("rms").alias("signal_power")
    )


def ema_normalize(blocks: DataFrame, alpha: float = 0.01, gate: DataFrame | None = None, on_gap: str = "carry") -> DataFrame:
    """Running mean and variance per 128-frame chunk, then ``(y - mu) / (sqrt(var) + 1e-6)``.

    Mean and variance are two linear recurrences over chunks; each is one block scan. Chunks are counted from the start of a row,
    and a gap carries or resets both as in :func:`filter_sessions`.
    ``gate(session_id, block, start_sample, factor array<double>)`` multiplies the chunks afterwards.
    """
    sid = _sid(blocks)
    keep = 1.0 - alpha

    def chunk_list(x: np.ndarray) -> list[np.ndarray]:
        return [x[i : i + EMA_CHUNK] for i in range(0, len(x), EMA_CHUNK)]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m1, m2, ends = [], [], []
            for c, x in zip(pdf["channels"], pdf["samples"]):
                parts = chunk_list(frames(x, c))
                a, b = np.array([p.mean(axis=0) for p in parts]), np.array([(p**2).mean(axis=0) for p in parts])
                mu = np.zeros(c)
                for row in a:
                    mu = keep * mu + alpha * row
                m1.append(a.ravel()), m2.append(b.ravel()), ends.append(mu)
            out = pdf[[*ROW, "n_frames", "mode", "fs_hz", "channels"]]
            yield out.assign(n=[len(a) // c for a, c in zip(m1, pdf["channels"])], m1=m1, m2=m2, state=ends)

    stats = blocks.select(*ROW, "n_frames", "mode", "fs_hz", "channels", "samples").mapInPandas(
        moments,
        f"session_id {sid}, block bigint, start_sample bigint, n_frames int, mode string, fs_hz double, channels int, n int, m1 array<double>, "
        "m2 array<double>, state array<double>",
    )
    decay = lambda mode, fs, n: keep**n  # noqa: E731 - passed to two scans
    mu_in = carry_states(stats.drop("m1", "m2"), decay, lambda mode, fs, c: np.zeros((1, c)), on_gap=on_gap)
    with_mu = stats.drop("state").join(mu_in.withColumnRenamed("carry", "mu"), ROW)

    def variances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = []
            for c, a, b, mu in zip(pdf["channels"], pdf["m1"], pdf["m2"], pdf["mu"]):
                var, mu = np.zeros(c), np.asarray(mu)
                for p, q in zip(np.reshape(a, (-1, c)), np.reshape(b, (-1, c))):
                    mu = keep * mu + alpha * p
                    var = keep * var + alpha * (q - 2 * mu * p + mu**2)
                ends.append(var)
            yield pdf[[*ROW, "n_frames", "n", "mode", "fs_hz", "channels", "mu"]].assign(state=ends)

    spread = with_mu.mapInPandas(
        variances,
        f"session_id {sid}, block bigint, start_sample bigint, n_frames int, n int, mode string, fs_hz double, channels int, mu array<double>, state array<double>",
    )
    var_in = carry_states(spread.drop("mu"), decay, lambda mode, fs, c: np.ones((1, c)), on_gap=on_gap)
    carried = spread.select(*ROW, "mu").join(var_in.withColumnRenamed("carry", "var"), ROW)
    joined = blocks.join(carried, ROW)
    if gate is None:
        joined = joined.withColumn("factor", F.array().cast("array<double>"))
    else:
        joined = joined.join(gate, ROW)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, x, mu, var, factor in zip(pdf["channels"], pdf["samples"], pdf["mu"], pdf["var"], pdf["factor"]):
                mu, var, done = np.asarray(mu), np.asarray(var), []
                for i, part in enumerate(chunk_list(frames(x, c))):
                    mu = keep * mu + alpha * part.mean(axis=0)
                    var = keep * var + alpha * ((part - mu) ** 2).mean(axis=0)
                    scale = factor[i] if len(factor) else 1.0
                    done.append(scale * (part - mu) / (np.sqrt(var) + 1e-6))
                out.append(np.vstack(done).ravel())
            yield pdf[["session_id", "block", "start_sample", "n_frames", "channels", "mode", "fs_hz"]].assign(samples=out)

    return joined.mapInPandas(
        apply,
        f"session_id {sid}, block bigint, start_sample bigint, n_frames int, channels int, mode string, fs_hz double, "
        "samples array<double>",
    )


def motion_gate(blocks: DataFrame, threshold: float = 0.35, attenuation: float = 0.15) -> DataFrame:
    """Per chunk of the raw signal: motion index and the factor its output is multiplied by."""

    def gates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index = []
            for fs, c, x in zip(pdf["fs_hz"], pdf["channels"], pdf["samples"]):
                data = frames(x, c)
                index.append([chunk_motion(data[i : i + EMA_CHUNK], fs) for i in range(0, len(data), EMA_CHUNK)])
            yield pdf[ROW].assign(
                motion=index, factor=[[attenuation if m >= threshold else 1.0 for m in row] for row in index]
            )

    return blocks.select(*ROW, "fs_hz", "channels", "samples").mapInPandas(
        gates, f"session_id {_sid(blocks)}, block bigint, start_sample bigint, motion array<double>, factor array<double>"
    )


def preprocess_streaming(blocks: DataFrame, alpha: float = 0.01, gated: bool = False, on_gap: str = "carry") -> DataFrame:
    """The causal chain used live: band-pass and notch, running normalisation, optional motion gate."""
    gate = motion_gate(blocks).select(*ROW, "factor") if gated else None
    return ema_normalize(bandpass_causal(blocks, on_gap=on_gap), alpha, gate, on_gap)


def bandpass_zero_phase(events: DataFrame, *, normalize: str | None = "zscore", rectify: bool = False) -> DataFrame:
    """Forward-backward band-pass and notch of every event row, then normalisation.

    Rows too short for the edge padding come back with ``reject`` set and their samples
    null instead of failing the job.
    """
    kept = events.select(*[c for c in events.columns if c != "samples"]).schema
    schema = StructType([*kept, StructField("samples", ArrayType(DoubleType())), StructField("reject", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, notes = [], []
            for m, fs, c, x in zip(pdf["mode"], pdf["fs_hz"], pdf["channels"], pdf["samples"]):
                try:
                    y = mode_filter(m, float(fs)).both_ways(frames(x, c))
                except ValueError as error:
                    out.append(None), notes.append(str(error))
                    continue
                y = np.abs(y) if rectify else y
                if normalize == "zscore":
                    y = zscore(y)
                elif normalize == "minmax":
                    y = (y - y.min(axis=0)) / (np.ptp(y, axis=0) + 1e-8)
                out.append(y.ravel()), notes.append(None)
            yield pdf.assign(samples=out, reject=notes)[[f.name for f in schema]]

    return events.mapInPandas(run, schema)
