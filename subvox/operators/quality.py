"""Signal-to-noise, motion and power of recordings and of single events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from subvox.functions import kernels as k
from subvox.functions.fixed import NOTE_MOTION, NOTE_SNR
from subvox.operators.filtering import motion_sessions
from subvox.plans.joins import spread_join
from subvox.plans.ordered import exact_percentiles

NOISE_BAND = (0.5, 5.0)
#: Sessions of at least this many frames use segments of 256 frames.
LONG = 1024


def _sid(df: DataFrame) -> str:
    return df.schema["session_id"].dataType.simpleString()


def _decibel(ratio: Column) -> Column:
    return F.lit(10.0) * F.log10(ratio)


def welch_snr(blocks: DataFrame, lengths: DataFrame, noise: tuple[float, float] = NOISE_BAND) -> DataFrame:
    """Per session and channel: mean in-band over mean noise-band density, ``ratio`` and ``snr_db``.

    ``blocks`` carry ``fs_hz, low_hz, high_hz``; ``lengths(session_id, n_samples)``. Half-
    overlapping segments are transformed where their block lies; only the 128 border
    frames of a row move to meet those of the row that begins where it ends, and each row gives two sums
    per channel; no segment of a long session crosses lost samples. Undefined bands give NULL.
    """
    sid = _sid(blocks)
    sized = spread_join(blocks, lengths, ["session_id"], salt_by=["block"])
    long, short = sized.where(F.col("n_samples") >= LONG), sized.where(F.col("n_samples") < LONG)
    facts = ["session_id", "fs_hz", "low_hz", "high_hz"]
    sums = f"session_id {sid}, channel int, n bigint, signal double, noise double"
    names = ["session_id", "channel", "n", "signal", "noise"]

    def add(rows: list, s, fs: float, band: tuple[float, float], segments: np.ndarray) -> None:
        if not len(segments):
            return
        n = segments.shape[1]
        f = np.fft.rfftfreq(n, 1 / fs)
        psd = k.segment_power(segments, fs).sum(axis=0)
        for c in range(psd.shape[1]):
            parts = []
            for low, high in (band, noise):
                inside = (f >= low) & (f <= high)
                parts.append(float(psd[inside, c].mean()) if inside.any() else None)
            rows.append((s, c, len(segments), *parts))

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list = []
            for s, fs, low, high, c, x in zip(*(pdf[n] for n in [*facts, "channels", "samples"])):
                data = k.frames(x, c)
                if len(data) >= 256:
                    add(rows, s, fs, (low, high), k.half_overlapping(data, 256))
            yield pd.DataFrame(rows, columns=names)

    within = long.select(*facts, "channels", "samples").mapInPandas(inner, sums)
    half = 128 * F.col("channels")
    ends = long.select(*facts, "channels", F.explode(F.array(
        F.struct(F.col("start_sample").alias("edge"), F.lit(1).alias("side"), F.slice("samples", 1, half).alias("v")),
        F.struct((F.col("start_sample") + F.col("n_frames")).alias("edge"), F.lit(0).alias("side"), F.slice("samples", -half, half).alias("v")),
    )).alias("e"), "n_frames")
    whole_end = ends.where((F.size("e.v") == half) & (F.col("n_frames") % 128 == 0))
    met = whole_end.groupBy(*facts, "channels", F.col("e.edge").alias("edge")).agg(
        F.sort_array(F.collect_list(F.struct("e.side", "e.v"))).alias("h")
    )
    crossing = met.where(F.size("h") == 2).withColumn("samples", F.flatten("h.v"))
    # The last block may be short: its head half is still a whole half segment.
    heads = ends.where((F.col("e.side") == 1) & (F.size("e.v") == half) & (F.col("n_frames") % 128 != 0))
    tails = whole_end.where(F.col("e.side") == 0)
    late = (
        tails.select(*facts, "channels", F.col("e.edge").alias("edge"), F.col("e.v").alias("a"))
        .join(heads.select("session_id", F.col("e.edge").alias("edge"), F.col("e.v").alias("b")), ["session_id", "edge"])
        .withColumn("samples", F.concat("a", "b"))
    )
    both = crossing.select(*facts, "channels", "samples").unionByName(late.select(*facts, "channels", "samples"))
    between = both.mapInPandas(inner, sums)

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list = []
            for s, fs, low, high, c, x in zip(*(pdf[n] for n in [*facts, "channels", "samples"])):
                data = k.frames(x, c)
                n = k.segment_length(len(data))
                if n >= 4:
                    add(rows, s, fs, (low, high), k.half_overlapping(data, n))
            yield pd.DataFrame(rows, columns=names)

    # Under LONG frames a session is a handful of blocks, so it fits one row.
    rows = short.groupBy(*facts).agg(
        F.max("channels").alias("channels"), F.sort_array(F.collect_list(F.struct("start_sample", "samples"))).alias("r")
    )
    brief = rows.select(*facts, "channels", F.flatten("r.samples").alias("samples")).mapInPandas(small, sums)
    total = within.unionByName(between).unionByName(brief).groupBy("session_id", "channel").agg(
        (F.sum("signal") / F.sum("n")).alias("_s"), (F.sum("noise") / F.sum("n")).alias("_n")
    )
    # ``greatest`` skips nulls, so an undefined band has to be kept apart.
    ratio = F.when(F.col("_n").isNotNull(), F.col("_s") / F.greatest("_n", F.lit(1e-12)))
    out = total.select("session_id", "channel", ratio.alias("ratio"))
    return out.withColumn("snr_db", F.when(F.col("ratio").isNotNull(), _decibel(F.greatest("ratio", F.lit(1e-12)))))


def session_snr(per_channel: DataFrame) -> DataFrame:
    """Overall SNR of a session and its per-channel list (channels are few)."""
    out = per_channel.groupBy("session_id").agg(
        F.avg("ratio").alias("_m"), F.sort_array(F.collect_list(F.struct("channel", "snr_db"))).alias("_c")
    )
    return out.select("session_id", _decibel(F.col("_m")).alias("snr_db"), F.col("_c.snr_db").alias("snr_db_per_channel"))


def quality_notes(snr: Column, motion: Column) -> Column:
    low = F.format_string(NOTE_SNR, snr)
    high = F.format_string(NOTE_MOTION, motion)
    return F.array_compact(F.array(F.when(snr < 10, low), F.when(motion > 0.3, high)))


def quality_sessions(blocks: DataFrame, lengths: DataFrame, noise: tuple[float, float] = NOISE_BAND, cut_hz: float = 5.0) -> DataFrame:
    """SNR, motion and power of every session with notes on what is wrong."""
    snr = session_snr(welch_snr(blocks, lengths, noise))
    out = motion_sessions(blocks, cut_hz).join(snr, "session_id", "left")
    out = out.withColumn(
        "noise_power", F.when(F.col("snr_db").isNotNull(), F.col("signal_power") * F.pow(F.lit(10.0), -F.col("snr_db") / 10)).otherwise(0.0)
    )
    return out.withColumn("notes", quality_notes(F.col("snr_db"), F.col("motion_index")))


_NUMBERS = ["snr_db", "band_snr_db", "motion_index", "baseline_wander", "signal_power", "noise_power"]
_LISTS = ["snr_db_per_channel", "motion_index_per_channel"]


def quality_events(events: DataFrame, noise: tuple[float, float] = NOISE_BAND, cut_hz: float = 5.0) -> DataFrame:
    """The same for every event row (``fs_hz, low_hz, high_hz, channels, samples``)."""
    keep = [c for c in events.columns if c != "samples"]
    added = [StructField(n, DoubleType()) for n in _NUMBERS] + [StructField(n, ArrayType(DoubleType())) for n in _LISTS]
    schema = StructType([*events.select(*keep).schema, *added])

    def assess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for fs, low, high, c, x in zip(*(pdf[n] for n in ["fs_hz", "low_hz", "high_hz", "channels", "samples"])):
                data, fs = k.frames(x, c), float(fs)
                ratio = k.welch_ratio(data, fs, (low, high), noise)
                index, wander = k.motion(data, fs, cut_hz)
                power = float(np.sqrt((data**2).mean(axis=0)).mean()) if len(data) else 0.0
                known = ratio is not None and np.isfinite(ratio).all()
                snr = float(10 * np.log10(ratio.mean())) if known and ratio.mean() > 0 else None
                per = list(10 * np.log10(np.maximum(ratio, 1e-12))) if known else None
                rows.append((
                    snr, k.band_snr_time(data, fs, (low, high)), float(index.mean()), float(wander.mean()), power,
                    power * 10 ** (-snr / 10) if snr is not None else 0.0, per, list(index),
                ))
            done = pd.DataFrame(rows, columns=[*_NUMBERS, *_LISTS])
            yield pd.concat([pdf[keep].reset_index(drop=True), done], axis=1)

    return events.mapInPandas(assess, schema)


def weak_channels(channels: DataFrame, deficit_db: float = 6.0, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Channels more than ``deficit_db`` below the median of the finite channels of their session."""
    finite = channels.where(F.col("snr_db").isNotNull() & ~F.isnan("snr_db") & (F.abs("snr_db") != float("inf")))
    medians = exact_percentiles(finite, keys, "snr_db", {"median_snr_db": 0.5})
    joined = spread_join(finite, medians, keys, salt_by=[c for c in finite.columns if c not in keys])
    return joined.where(F.col("snr_db") < F.col("median_snr_db") - deficit_db)
