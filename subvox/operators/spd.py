"""Covariance features of events in a log-Euclidean eigenbasis."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from subvox.functions import kernels as k
from subvox.functions.arrays import once
from subvox.functions.fixed import SPD_ETA, SPD_STEP_MS, SPD_WINDOW_MS
from subvox.plans.draws import draw, drawn_rows, uniform
from subvox.plans.joins import spread_join
from subvox.plans.ordered import drop_halo, halo_window, with_halo


def window_cov(events: DataFrame, win: int, step: int, keys: Sequence[str] = ("session_id", "event_id")) -> DataFrame:
    """Covariance of every full window of every event: ``(keys, frame, channels, cov)`` with
    ``cov`` the upper triangle, row by row. Windows are merged from moments of the panes they share."""
    keys = list(keys)
    fields = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *of, channels, samples in zip(*[pdf[c] for c in (*keys, "channels", "samples")]):
                cov = k.upper(k.covariances(k.frames(samples, channels), win, step))
                if len(cov):
                    yield pd.DataFrame({**{c: [v] * len(cov) for c, v in zip(keys, of)}, "frame": range(len(cov)), "channels": int(channels), "cov": list(cov)})

    return events.select(*keys, "channels", "samples").mapInPandas(run, f"{fields}, frame int, channels int, cov array<double>")


def diagonal_places(channels: Column) -> Column:
    """Positions of the diagonal in an upper triangle."""
    return F.transform(F.sequence(F.lit(0), channels - 1), lambda i: (i * channels - i * (i - 1) / 2).cast("int"))


def spd_regularize(df: DataFrame, eta: float = SPD_ETA, cov: str = "cov") -> DataFrame:
    """``(1 - eta) E + eta * trace(E) / C * I`` on upper triangles."""
    df = once(df, _p=diagonal_places(F.col("channels")))
    df = once(df, _t=F.aggregate("_p", F.lit(0.0), lambda s, p: s + F.get(cov, p)) * F.lit(eta) / F.col("channels"))
    value = F.transform(cov, lambda v, i: v * F.lit(1 - eta) + F.when(F.array_contains("_p", i), F.col("_t")).otherwise(0.0))
    return df.withColumn(cov, value).drop("_p", "_t")


#: Matrices a task unfolds at once; what it holds beside its Arrow batch grows with this, not with the batch.
SLICE = 64


def _rows(lists: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as views of its values."""
    if lists.null_count:
        raise ValueError("a matrix is null")
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [values[i:j] for i, j in zip(ends, ends[1:])]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), np.concatenate(rows))


@F.pandas_udf(ArrayType(DoubleType()))
def _basis(mean_log: pd.Series) -> pd.Series:
    return mean_log.map(lambda v: k.eigen_basis(k.from_upper(np.asarray(v))).ravel())


def log_euclidean_mean(covs: DataFrame, keys: Sequence[str], eta: float = SPD_ETA) -> DataFrame:
    """Mean of the matrix logarithms per key, as an upper triangle (``mean_log``).

    The mean of arrays is a mergeable aggregate, so a key of any size is reduced map-side.
    Matrices are shrunk once more before the logarithm.
    """
    keys = list(keys)
    fields = ", ".join(f"{c} {covs.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                logs: list = []
                for _, same in groupby(_rows(part["cov"]), len):
                    logs += list(k.upper(k.log_spd(k.from_upper(np.vstack(list(same))), eta)))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keys), _lists(logs)], [*keys, "_l"])

    logs = covs.select(*keys, "cov").mapInArrow(run, f"{fields}, _l array<double>").select(*keys, array_to_vector("_l").alias("_l"))
    return logs.groupBy(*keys).agg(Summarizer.mean(F.col("_l")).alias("_m"), F.count(F.lit(1)).alias("n_matrices")).select(
        *keys, vector_to_array("_m").alias("mean_log"), "n_matrices"
    )


def fit_basis(
    covs: DataFrame, keys: Sequence[str], row_key: Sequence[str], *, cap: int | None = None, seed: int = 1337, eta: float = SPD_ETA
) -> DataFrame:
    """Eigenbasis ``q`` (row-major C x C) per key from all its matrices, or from ``cap`` repeatably drawn ones."""
    keys = list(keys)
    means = log_euclidean_mean(covs if cap is None else drawn_rows(covs, keys, row_key, cap, seed), keys, eta)
    return means.select(*keys, _basis("mean_log").alias("q"), "n_matrices")


def project_sigma(covs: DataFrame, basis: DataFrame, keys: Sequence[str], mode: str = "diag") -> DataFrame:
    """``Q' E Q`` of each matrix: log diagonal, raw upper triangle or full log matrix."""

    @F.pandas_udf("array<float>")
    def sigma(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for covs, bases in batches:
            for at in range(0, len(covs), SLICE):
                out: list = []
                pairs = zip(covs.iloc[at : at + SLICE], bases.iloc[at : at + SLICE])
                for flat, same in groupby(pairs, lambda p: np.asarray(p[1]).tobytes()):
                    q = np.frombuffer(flat)
                    c = int(np.sqrt(len(q)))
                    out += list(k.project(k.from_upper(np.vstack([v for v, _ in same])), q.reshape(c, c), mode).astype(np.float32))
                yield pd.Series(out)

    joined = spread_join(covs, basis.select(*keys, "q"), keys, salt_by=["frame"])
    return joined.withColumn("sigma", sigma("cov", "q")).drop("q", "cov")


def append_deltas(sigma: DataFrame, keys: Sequence[str], frame: str = "frame", chunk: int = 4096) -> DataFrame:
    """Each feature row followed by its change since the frame before (0 for the first)."""
    near = with_halo(sigma, keys, frame, chunk=chunk, before=1)
    prev = F.lag("sigma").over(halo_window(keys, frame))
    delta = F.when(prev.isNull(), F.transform("sigma", lambda v: v * 0)).otherwise(F.zip_with("sigma", prev, lambda a, b: a - b))
    near = near.withColumn("_d", delta)
    return drop_halo(near).withColumn("sigma", F.concat("sigma", "_d")).drop("_d")


def sigma_sequences(
    events: DataFrame, basis: DataFrame, basis_keys: Sequence[str], *, mode: str = "diag_delta", eta: float = SPD_ETA,
    window_ms: float = SPD_WINDOW_MS, step_ms: float = SPD_STEP_MS,
) -> DataFrame:
    """Feature frames of every event: windows, covariance, shrinkage and projection in one pass.

    An event row travels once together with its basis; frames without a window give one
    zero row, events under 8 frames give none. Input rows are already filtered.
    """
    joined = spread_join(events.where("n_frames >= 8"), basis.select(*basis_keys, "q"), list(basis_keys), salt_by=["event_id"])
    sid = events.schema["session_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                c = int(row.channels)
                win, step = k.window_frames(float(row.fs_hz), window_ms, step_ms)
                cov = k.shrink(k.covariances(k.frames(row.samples, c), win, step), eta)
                if len(cov):
                    seq = k.project(cov, np.reshape(row.q, (c, c)), mode)
                else:
                    seq = np.zeros((1, {"full": c * c, "upper_tri": c * (c + 1) // 2}.get(mode, c)))
                if mode == "diag_delta":
                    seq = k.with_deltas(seq)
                yield pd.DataFrame(
                    {"session_id": row.session_id, "event_id": row.event_id, "frame": range(len(seq)), "sigma": list(seq.astype(np.float32))}
                )

    return joined.select("session_id", "event_id", "fs_hz", "channels", "samples", "q").mapInPandas(
        run, f"session_id {sid}, event_id bigint, frame int, sigma array<float>"
    )


def augment_sigma(
    sequences: DataFrame, *, copies: int = 1, seed: int = 0, noise: float = 0.02, time_share: float = 0.08, feature_share: float = 0.05
) -> DataFrame:
    """Noisy, masked copies of training feature rows.

    Every draw is a hash of the seed, copy, event and place, so a row is changed without
    gathering its event: Gaussian noise, time masks of width up to ``T / 8`` and feature
    masks that hold for the whole event. ``n_rows`` is the number of frames of the event.
    """
    keyed = sequences.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(int(copies)))))

    def unit(*parts: Column | str) -> Column:
        cols = [F.col(p) if isinstance(p, str) else p for p in parts]
        return uniform(draw(seed, "copy", "session_id", "event_id", *cols))

    t, d = F.col("n_rows"), F.size("sigma")
    n_time = F.when(t > 4, F.greatest(F.lit(1), F.bround(t * F.lit(time_share)))).otherwise(0).cast("int")
    n_feat = F.when(d > 4, F.greatest(F.lit(1), F.bround(d * F.lit(feature_share)))).otherwise(0).cast("int")

    def hit(m: Column) -> Column:
        width = 1 + F.floor(unit(F.lit("w"), m) * F.greatest(F.lit(1), F.floor(t / 8)))
        start = F.floor(unit(F.lit("s"), m) * F.greatest(F.lit(1), t - width))
        return (F.col("frame") >= start) & (F.col("frame") < start + width)

    none = F.array().cast("array<int>")
    masked = F.exists(F.when(n_time > 0, F.sequence(F.lit(1), n_time)).otherwise(none), hit)
    dropped = F.transform(
        F.when(n_feat > 0, F.sequence(F.lit(1), n_feat)).otherwise(none), lambda m: F.floor(unit(F.lit("f"), m) * d).cast("int")
    )
    marked = once(keyed, _t=masked, _f=dropped)

    def noisy(v: Column, i: Column) -> Column:
        u1, u2 = unit("frame", i, F.lit("a")), unit("frame", i, F.lit("b"))
        gauss = F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * np.pi * u2)
        return F.when(F.col("_t") | F.array_contains("_f", i), 0.0).otherwise(v + F.lit(noise) * gauss).cast("float")

    return marked.withColumn("sigma", F.transform("sigma", noisy)).drop("_t", "_f")
