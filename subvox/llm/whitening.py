"""Whitening of embeddings by polarisation covariance.

Vectors become whole numbers ``x = floor(256 c)``. Each distinct one counts once: ``n`` vectors with sums ``S``. A second pass sums, for every
dimension and for every pair of dimensions, the squares of the centred values ``n x_i - S_i`` and ``(n x_i - S_i) + (n x_j - S_j)``. All of these
are whole numbers and summed exactly, so neither order nor partitioning matters. The difference of the variance of a sum and those of its parts
is twice the covariance; the matrix so assembled goes to a symmetric eigensolver on the driver.

What reaches the driver are ``d (d + 1) / 2`` sums, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subvox.llm.common import saved

SCALE = 256
COMPONENTS = 4
#: Whole numbers are squared in limbs of 21 bits, and sums travel in limbs of 60 bits.
_LIMB, _WIDE = 21, 60


@dataclass
class Whitening:
    """``n`` and ``sums`` of the fit list; unit ``axes`` (d x k), their eigenvalues and shares of the trace; ``error`` of the identity."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    covariance: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    error: float = 0.0

    @property
    def scales(self) -> np.ndarray:
        """One over the root of each eigenvalue; not a number where the vectors do not vary along the axis."""
        flat = self.values <= len(self.sums) * np.finfo(float).eps * max(np.trace(self.covariance), 0.0)
        return np.where(flat, np.nan, 1.0 / np.sqrt(np.where(flat, 1.0, self.values)))


def quantised(vectors: DataFrame, key: str = "vec_id", data: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``_id, _x`` of the rows whose vector is there, not empty, and holds finite numbers only."""
    rows = vectors.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{data}`").cast("array<double>").alias("_c")).where(F.size("_c") > 0)
    rows = rows.where(F.forall("_c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return rows.select("_id", F.transform("_c", lambda v: F.floor(v * scale).cast("long")).alias("_x"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` as 64-bit numbers, or as unbounded ones where these could be too small."""
    peak = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * peak + max((abs(s) for s in sums), default=0) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(values: np.ndarray, axis: int = 0) -> np.ndarray:
    """Exact sums of squares along an axis, as unbounded whole numbers."""
    if values.dtype == object or values.size == 0:
        return (values.astype(object) ** 2).sum(axis=axis)
    v = np.abs(values)
    peak, rows = int(v.max()), values.shape[axis]
    if peak * peak * rows < 1 << 63:
        return (v * v).sum(axis=axis).astype(object)
    limbs = [(v >> (_LIMB * i)) & ((1 << _LIMB) - 1) for i in range(-(-peak.bit_length() // _LIMB))]
    total = np.zeros(np.delete(values.shape, axis), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs[i:], i):
            total = total + ((a * b).sum(axis=axis).astype(object) << (_LIMB * (i + j))) * (1 if i == j else 2)
    return total


def _polarised(d: np.ndarray) -> np.ndarray:
    """Sums of squares of all dimensions, then of all sums of two dimensions (i < j, by i)."""
    out = [square_sums(d)]
    for i in range(d.shape[1] - 1):
        out.append(square_sums(d[:, i : i + 1] + d[:, i + 1 :]))
    return np.concatenate(out)


def _summed(rows: DataFrame, numbers) -> dict[int, int]:
    """Exact sums over all rows of the whole numbers that ``numbers(matrix)`` gives; one set per task is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = _matrix(batch["_x"])
            if len(x):
                part = numbers(x)
                total = part if total is None else total + part
        if total is not None:
            sign = [1 if t >= 0 else -1 for t in total]
            limbs = [[s * ((abs(t) >> (_WIDE * k)) & ((1 << _WIDE) - 1)) for t, s in zip(total, sign)] for k in range(3)]
            yield pd.DataFrame({"_at": np.arange(len(total)), "_a": limbs[0], "_b": limbs[1], "_c": limbs[2]}).astype("int64")

    parts = rows.select("_x").mapInPandas(run, "_at long, _a long, _b long, _c long")
    sums = parts.groupBy("_at").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("_a", "_b", "_c")])
    return {r["_at"]: int(r["_a"]) + (int(r["_b"]) << _WIDE) + (int(r["_c"]) << 2 * _WIDE) for r in sums.collect()}


def fit(vectors: DataFrame, key: str = "vec_id", data: str = "embedding", *, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Axes of the distinct vectors, by falling eigenvalue; the sign makes the largest entry of an axis positive.

    Nulls, vectors with null or non-finite entries and empty vectors are left out. Vectors of several lengths: those of the most common length are
    fitted (of equally common ones the longest). Without any vector the model is empty.
    """
    rows = quantised(vectors, key, data, scale).select("_x")
    lengths = rows.groupBy(F.size("_x").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max(F.struct("_n", "_d")).alias("_m")).first()["_m"]
    if lengths is None:
        return Whitening()
    d = lengths["_d"]
    once = saved(rows.where(F.size("_x") == d).distinct(), "vectors")

    counted = _summed(once, lambda x: np.concatenate([[len(x)], x.astype(object).sum(axis=0)]))
    n, sums = counted[0], [counted[i + 1] for i in range(d)]
    squares = _summed(once, lambda x: _polarised(_centred(x, n, sums)))
    # Sums of squares of n x - S: covariances are n^3 times smaller, and the quotient of whole numbers is rounded once.
    cov = np.zeros((d, d))
    at = d
    for i in range(d):
        cov[i, i] = squares[i] / n**3
        for j in range(i + 1, d):
            cov[i, j] = cov[j, i] = (squares[at] - squares[i] - squares[j]) / (2 * n**3)
            at += 1
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    model = Whitening(n, sums, axes, values, values / trace if trace > 0 else np.zeros_like(values), cov)
    model.error = _identity_error(once, model)
    return model


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Coordinates of whole-number vectors on the axes, each over the root of its eigenvalue."""
    return (_centred(x, model.n, model.sums) / model.n).astype(float) @ model.axes * model.scales


def _identity_error(once: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, over the axes along which it varies."""
    use = ~np.isnan(model.scales)
    k = int(use.sum())
    if not k:
        return 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k + k * k)
        for batch in batches:
            x = _matrix(batch["_x"])
            if len(x):
                z = whitened(x, model)[:, use]
                total += np.concatenate([z.sum(0), (z.T @ z).ravel()])
        yield pd.DataFrame({"_at": np.arange(len(total)), "_v": total})

    sums = once.select("_x").mapInPandas(run, "_at int, _v double").groupBy("_at").agg(F.sum("_v").alias("_v")).orderBy("_at").collect()
    v = np.array([r["_v"] for r in sums]) / model.n
    mean, square = v[:k], v[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, key: str = "vec_id", data: str = "embedding", *, scale: int = SCALE) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row per sound vector and component, from 1.

    Rows that ``fit`` leaves out are left out here, and so are vectors of another length than the model's; repeated rows and null keys stay.
    ``deviation`` is null where it passes 64 bits; ``whitened`` is null on an axis along which the fit list does not vary. Empty model: no rows.
    """
    d, k = len(model.sums), len(model.values)
    rows = quantised(vectors, key, data, scale).where(F.size("_x") == d)

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(column: pd.Series) -> pd.DataFrame:
        x = _matrix(column)
        if not len(x):
            return pd.DataFrame({"deviation": pd.Series([], dtype="Int64"), "whitened": []})
        far = square_sums(_centred(x, model.n, model.sums), axis=1)
        z = whitened(x, model)
        return pd.DataFrame({"deviation": pd.array([v if v < 1 << 63 else None for v in far], dtype="Int64"), "whitened": list(z)})

    found = rows.select("_id", project("_x").alias("_p")).select("_id", "_p.deviation", F.posexplode("_p.whitened").alias("_at", "_z"))
    share = F.array(*[F.lit(float(v)) for v in model.explained]) if k else F.array().cast("array<double>")
    return found.select(
        F.col("_id").alias(key), (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("_z"), F.col("_z")).alias("whitened"), F.get(share, F.col("_at")).alias("explained"), F.lit(model.error).alias("identity_error"),
    )
