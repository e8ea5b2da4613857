"""Joins against small tables without trusting that they are small or well spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", *, salts: int = 16, salt_by: Sequence[str] | None = None
) -> DataFrame:
    """Join a long table with a short one whose keys may be few and hot.

    No broadcast is forced: Spark broadcasts the right side only when its measured
    size is under the threshold. When it is not, the salt spreads each key of the
    left side over ``salts`` tasks and the short side is repeated that many times.
    ``salt_by`` names the columns to hash for the salt (default: all).
    Supported: inner, left, left_semi, left_anti.
    """
    on = list(on)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*(salt_by or left.columns)), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
