"""Scaling, moments and packet gaps of recordings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from subvox.functions.kernels import frames
from subvox.plans.joins import spread_join
from subvox.plans.ordered import drop_halo, halo_window, running_sum, with_halo

EPS = 1e-8


def normalize_values(df: DataFrame, scope: Sequence[str], value: str, mode: str = "zscore", salt_by: Sequence[str] | None = None) -> DataFrame:
    """Z-score or min-max of a number column over each scope.

    The scope is reduced map-side to one row before it is joined back, so a scope of any
    size is never gathered.
    """
    x = F.col(value).cast("double")
    if mode == "zscore":
        stats = df.groupBy(*scope).agg(F.avg(x).alias("_a"), F.stddev_pop(x).alias("_b"))
    elif mode == "minmax":
        stats = df.groupBy(*scope).agg(F.min(x).alias("_a"), (F.max(x) - F.min(x)).alias("_b"))
    else:
        raise ValueError(f"unknown mode {mode}")
    out = spread_join(df, stats, scope, salt_by=salt_by)
    return out.withColumn(value, (x - F.col("_a")) / (F.col("_b") + F.lit(EPS))).drop("_a", "_b")


def moments(rows: DataFrame, scope: Sequence[str], channels: int, samples: str = "samples") -> DataFrame:
    """Count, sums, and sums of products of all channel pairs of each scope.

    Every Arrow batch is folded to one row per scope with a matrix product; the partial
    rows are added element by element. Result: ``(scope, i, j, n, si, sj, sij)`` for ``i <= j``.
    """
    scope = list(scope)
    fields = ", ".join(f"{s} {rows.schema[s].dataType.simpleString()}" for s in scope)
    up = np.triu_indices(channels)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(scope, sort=False):
                x = np.vstack([frames(v, channels) for v in part[samples]])
                out.append((*key, len(x), x.sum(axis=0), (x.T @ x)[up]))
            yield pd.DataFrame(out, columns=[*scope, "n", "s", "p"])

    parts = rows.select(*scope, samples).mapInPandas(fold, f"{fields}, n bigint, s array<double>, p array<double>")
    pairs = F.arrays_zip(F.array(*map(F.lit, up[0].tolist())).alias("i"), F.array(*map(F.lit, up[1].tolist())).alias("j"), F.col("p").alias("p"))
    long = parts.select(*scope, "n", "s", F.explode(pairs).alias("e")).select(
        *scope, "n", F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.get("s", F.col("e.i")).alias("si"),
        F.get("s", F.col("e.j")).alias("sj"), F.col("e.p").alias("sij"),
    )
    return long.groupBy(*scope, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def channel_rms(moment_rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    return moment_rows.where("i = j").select(*scope, F.col("i").alias("channel"), F.sqrt(F.col("sij") / F.col("n")).alias("rms"))


def mean_abs_offdiag_corr(moment_rows: DataFrame, scope: Sequence[str], min_frames: int = 32) -> DataFrame:
    """Mean absolute correlation over channel pairs; scopes with too few frames are left out."""
    scope = list(scope)
    n = F.col("n")
    own = moment_rows.where("i = j").select(*scope, F.col("i").alias("_c"), (F.col("sij") - F.col("si") * F.col("si") / n).alias("_v"))
    pairs = moment_rows.where((F.col("i") < F.col("j")) & (n >= min_frames))
    pairs = pairs.join(own.withColumnsRenamed({"_c": "i", "_v": "vi"}), [*scope, "i"]).join(
        own.withColumnsRenamed({"_c": "j", "_v": "vj"}), [*scope, "j"]
    )
    corr = (F.col("sij") - F.col("si") * F.col("sj") / n) / F.sqrt(F.col("vi") * F.col("vj"))
    return pairs.groupBy(*scope).agg(F.avg(F.abs(corr)).alias("corr_offdiag_mean"), F.count(F.lit(1)).alias("n_pairs"))


def normalize_blocks(blocks: DataFrame, mode: str = "zscore", scope: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per-channel normalisation of block rows over a scope (session or trial).

    A block gives one row of sums per channel; scopes are merged from those, and the few
    numbers per channel are joined back to the blocks.
    """
    scope = list(scope)
    fields = ", ".join(f"{s} {blocks.schema[s].dataType.simpleString()}" for s in scope)
    names = [*scope, "channel", "n", "s", "q", "lo", "hi"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, c, x in pdf[[*scope, "channels", "samples"]].itertuples(index=False):
                data = frames(x, c)
                stats = zip(data.sum(axis=0), (data**2).sum(axis=0), data.min(axis=0), data.max(axis=0))
                rows += [(*key, i, len(data), *row) for i, row in enumerate(stats)]
            yield pd.DataFrame(rows, columns=names)

    parts = blocks.select(*scope, "channels", "samples").mapInPandas(
        sums, f"{fields}, channel int, n bigint, s double, q double, lo double, hi double"
    )
    stats = parts.groupBy(*scope, "channel").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    mean = F.col("s") / F.col("n")
    if mode == "zscore":
        shift, width = mean, F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    else:
        shift, width = F.col("lo"), F.col("hi") - F.col("lo")
    # Channels are few, so their numbers fit one row per scope.
    table = stats.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("channel", shift.alias("a"), width.alias("b")))).alias("t"))
    table = table.select(*scope, F.col("t.a").alias("shift"), F.col("t.b").alias("width"))
    joined = spread_join(blocks, table, scope, salt_by=["block"])
    kept = [f for f in blocks.schema if f.name != "samples"]

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                ((frames(x, c) - np.asarray(a)) / (np.asarray(b) + EPS)).ravel()
                for c, x, a, b in zip(pdf["channels"], pdf["samples"], pdf["shift"], pdf["width"])
            ]
            yield pdf[[f.name for f in kept]].assign(samples=out)

    return joined.mapInPandas(scale, StructType([*kept, StructField("samples", ArrayType(DoubleType()))]))


def detect_gaps(packets: DataFrame, chunk: int = 65_536) -> DataFrame:
    """Samples lost before each packet of a device in arrival order, and the running total.

    A packet that starts before the expected sample loses nothing and sets the
    expectation anew.
    """
    near = with_halo(packets, ["device_id"], "arrival_no", chunk=chunk, before=1)
    expected = F.lag(F.col("sample_index") + F.col("frames")).over(halo_window(["device_id"], "arrival_no"))
    lost = F.greatest(F.col("sample_index") - F.coalesce(expected, F.col("sample_index")), F.lit(0)).cast("long")
    gaps = drop_halo(near.withColumn("lost", lost))
    return running_sum(gaps, ["device_id"], "arrival_no", {"lost_total": F.col("lost")}, chunk=chunk)
