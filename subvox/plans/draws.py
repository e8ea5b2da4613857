"""Repeatable random choices: md5 of a seed and a key instead of a generator.

The draw of a row depends only on its key, so re-runs, lost executors and other
partitionings give the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subvox.plans.joins import spread_join


def draw(seed: int, *cols: str | Column) -> Column:
    """md5 text of ``seed:col:col``; its text order is the random order."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(int(seed))), *parts))


def uniform(digest: Column) -> Column:
    """First 32 bits of an md5 text as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_int(digest: Column) -> Column:
    """First 32 bits of an md5 text as a whole number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def quota_cut(
    rows: DataFrame, keys: Sequence[str], digest: str, quotas: DataFrame, quota: str, *, digits: int = 4
) -> DataFrame:
    """The digest up to which a group must be taken to get exactly ``quota`` rows.

    Returns one row ``(keys, _cut)`` per group with a positive quota. Groups of any
    size work: digests are counted by their first hex digits, only the rows of the
    one prefix that holds the quota-th row are ranked, and no wide row moves.
    """
    keys = list(keys)
    narrow = rows.select(*keys, F.col(digest).alias("_d"), F.substring(digest, 1, digits).alias("_p"))
    counts = narrow.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_n").over(running))
    wanted = quotas.select(*keys, F.col(quota).cast("long").alias("_q")).where("_q > 0")
    edge = (
        counts.join(wanted, keys)
        .where("_upto - _n < _q AND _q <= _upto")
        .select(*keys, "_p", (F.col("_q") - (F.col("_upto") - F.col("_n"))).alias("_need"))
    )
    inside = narrow.join(edge, [*keys, "_p"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_d"))
    )
    part = inside.where("_r = _need").select(*keys, F.col("_d").alias("_cut"))
    whole = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(digest).alias("_top"))
        .join(wanted, keys).where("_q > _n").select(*keys, F.col("_top").alias("_cut"))
    )
    return part.unionByName(whole)


def drawn_rows(rows: DataFrame, keys: Sequence[str], row_key: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` repeatably drawn rows of each key, or all of a smaller one."""
    drawn = rows.withColumn("_draw", draw(seed, *row_key))
    cuts = quota_cut(drawn, keys, "_draw", drawn.groupBy(*keys).agg(F.lit(int(n)).alias("_q")), "_q")
    return spread_join(drawn, cuts, keys, salt_by=["_draw"]).where("_draw <= _cut").drop("_draw", "_cut")
