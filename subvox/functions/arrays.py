"""Column helpers for samples and feature vectors held in arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later lambdas read many times and that must be computed once per row.

    The optimizer inlines a plain projection into every use, also inside lambdas where it
    would run per element; a generator of one element keeps the value.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def microvolts_per_count(bits: int = 16, vref: float = 2.4, gain: float = 24.0) -> float:
    return vref / gain / (2 ** (bits - 1) - 1) * 1e6


def scale_counts(counts: Column, **afe: float) -> Column:
    """ADC counts to microvolts, element by element."""
    k = F.lit(microvolts_per_count(**afe))
    return F.transform(counts, lambda c: (c * k).cast("float"))


def quantize_value(x: Column, **afe: float) -> Column:
    """One microvolt value to a clipped ADC count, halves to even."""
    bits = int(afe.get("bits", 16))
    hi = 2 ** (bits - 1) - 1
    count = F.bround(x / F.lit(microvolts_per_count(**afe)))
    return F.greatest(F.least(count, F.lit(float(hi))), F.lit(float(-hi - 1))).cast("long")


def quantize(samples: Column, **afe: float) -> Column:
    return F.transform(samples, lambda x: quantize_value(x, **afe))


def rectify(samples: Column) -> Column:
    return F.transform(samples, F.abs)


def select_channels(samples: Column, channels: Column, picks: Sequence[int]) -> Column:
    """Keeps the given channels of row-major ``(frame, channel)`` samples; a bad index raises."""
    ok = (F.lit(max(picks)) < channels) & F.lit(min(picks) >= 0)
    wanted = F.array(*[F.lit(int(p)) for p in picks])
    frames = F.sequence(F.lit(0), (F.size(samples) / channels).cast("int") - 1)
    kept = F.flatten(
        F.transform(frames, lambda f: F.transform(wanted, lambda c: F.get(samples, f * channels + c)))
    )
    return F.when(ok, kept).otherwise(F.raise_error(F.lit("channel index out of range")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(gap)
