"""Ordered computations that never put one whole key into one task.

A plain ``Window.partitionBy(key).orderBy(pos)`` sorts every row of a key in a
single task, which fails when one session, device or trial holds a large part of
all rows. Everything here splits a key into ordered chunks first:

* per-chunk partial results are aggregated map-side,
* the small chunk table is scanned in order (one row per key and chunk),
* the carried value is joined back on ``(key, chunk)`` and the rest is a window
  inside the chunk. The join and the window share one hash partitioning, so the
  wide rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows one window task should hold; below this a plain window is used.
ROWS_PER_BUCKET = 2_000_000
#: Rows of a table that one task should sort.
ROWS_PER_TASK = 500_000
#: Most cut points asked for at once (their number, not the data, reaches the driver).
MAX_BUCKETS = 4096

BUCKET = "_bucket"
CHUNK = "_chunk"
HALO = "_halo"


def depth_cuts(df: DataFrame, on: Column, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Cut points of ``on`` that leave about ``rows_per_bucket`` rows between two cuts.

    The points come from one mergeable quantile sketch; at most ``MAX_BUCKETS``
    numbers are returned. An empty list means one bucket is enough.
    """
    wanted = min(MAX_BUCKETS, df.count() // max(rows_per_bucket, 1))
    if wanted < 2:
        return []
    points = [i / wanted for i in range(1, wanted)]
    sketch = F.percentile_approx(on.cast("double"), points, 20_000)
    return sorted(set(df.agg(sketch.alias("q")).first()["q"] or []))


def bucketed(df: DataFrame, on: Column, cuts: Sequence[float]) -> DataFrame:
    """Adds ``_bucket``, the index of the interval of ``cuts`` that holds ``on``."""
    splits = [float("-inf"), *cuts, float("inf")]
    tool = Bucketizer(splits=splits, inputCol="_on", outputCol=BUCKET, handleInvalid="keep")
    return tool.transform(df.withColumn("_on", on.cast("double"))).drop("_on")


def dealt(df: DataFrame, keys: Sequence[str], rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` by hash of ``keys`` in partitions whose number grows with ``rows``, its number of rows, so that their size does
    not; as it is while the session's number of shuffle partitions is enough."""
    n = -(-rows // rows_per_task)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def add_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    on: Column,
    name: str = "pos",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """0-based position of each row inside its key, in the given total order.

    ``on`` is a numeric column that never decreases along ``order``; it is only
    used to split large inputs.
    """
    cuts = depth_cuts(df, on, rows_per_bucket)
    keys = list(keys)
    if not cuts:
        return df.withColumn(
            name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
        )
    parts = bucketed(df, on, cuts)
    before = (
        parts.groupBy(*keys, BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(_earlier(keys, BUCKET)), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    return (
        dealt(parts, [*keys, BUCKET], (len(cuts) + 1) * rows_per_bucket)
        .join(before, [*keys, BUCKET])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_before", BUCKET)
    )


def _earlier(keys: Sequence[str], chunk: str):
    return Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)


def with_halo(
    df: DataFrame, keys: Sequence[str], pos: str, *, chunk: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Splits each key into runs of ``chunk`` positions and copies the few border
    rows into the neighbour run, so that a window over ``(keys, _chunk)`` that looks
    at most ``before`` positions back and ``after`` ahead is exact. Drop the rows
    with ``_halo`` afterwards.
    """
    if before > chunk or after > chunk:
        raise ValueError("before and after must not exceed chunk")
    own = F.floor(F.col(pos) / chunk).cast("long")
    offset = F.col(pos) - own * chunk
    no_copy = F.lit(None).cast("struct<c:bigint,h:boolean>")
    homes = [F.struct(own.alias("c"), F.lit(False).alias("h"))]
    if before:
        homes.append(
            F.when(offset >= chunk - before, F.struct((own + 1).alias("c"), F.lit(True).alias("h"))).otherwise(no_copy)
        )
    if after:
        homes.append(F.when(offset < after, F.struct((own - 1).alias("c"), F.lit(True).alias("h"))).otherwise(no_copy))
    if len(homes) == 1:
        return df.withColumn(CHUNK, own).withColumn(HALO, F.lit(False))
    return (
        df.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
        .withColumn(CHUNK, F.col("_home.c"))
        .withColumn(HALO, F.col("_home.h"))
        .drop("_home")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO, CHUNK)


def halo_window(keys: Sequence[str], pos: str):
    return Window.partitionBy(*keys, CHUNK).orderBy(pos)


def running_sum(
    df: DataFrame, keys: Sequence[str], pos: str, sums: dict[str, Column], *, chunk: int
) -> DataFrame:
    """Inclusive running sums along ``pos`` inside each key."""
    keys = list(keys)
    marked = df.withColumn(CHUNK, F.floor(F.col(pos) / chunk).cast("long"))
    for name, value in sums.items():
        marked = marked.withColumn(f"_v_{name}", value)
    carried = marked.groupBy(*keys, CHUNK).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    carried = carried.select(
        *keys, CHUNK, *[F.coalesce(F.sum(f"_s_{n}").over(_earlier(keys, CHUNK)), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(carried, [*keys, CHUNK])
    for name in sums:
        out = out.withColumn(name, F.col(f"_c_{name}") + F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)))
    return out.drop(CHUNK, *[f"_v_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def last_known(
    df: DataFrame, keys: Sequence[str], pos: str, values: dict[str, Column], *, chunk: int
) -> DataFrame:
    """Latest non-null value at or before each row (the as-of side of an as-of join)."""
    keys = list(keys)
    marked = df.withColumn(CHUNK, F.floor(F.col(pos) / chunk).cast("long"))
    for name, value in values.items():
        marked = marked.withColumn(f"_v_{name}", value)
    ends = marked.groupBy(*keys, CHUNK).agg(
        *[F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(pos, f"_v_{n}"))).alias(f"_e_{n}") for n in values]
    )
    carried = ends.select(
        *keys,
        CHUNK,
        *[
            F.last(F.col(f"_e_{n}")[f"_v_{n}"], ignorenulls=True).over(_earlier(keys, CHUNK)).alias(f"_c_{n}")
            for n in values
        ],
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(carried, [*keys, CHUNK])
    for name in values:
        out = out.withColumn(
            name, F.coalesce(F.last(f"_v_{name}", ignorenulls=True).over(inside), F.col(f"_c_{name}"))
        )
    return out.drop(CHUNK, *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Linear-interpolation percentiles per key over groups of any size.

    The built-in ``percentile`` gathers all distinct values of a group in one task;
    here equal values are counted map-side and the rank is found bucket by bucket.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cuts = depth_cuts(counted, F.col("_x"), rows_per_bucket)
    if cuts:
        counted = bucketed(counted, F.col("_x"), cuts)
        sums = counted.groupBy(*keys, BUCKET).agg(F.sum("_n").alias("_s"))
        sums = sums.select(
            *keys,
            BUCKET,
            F.coalesce(F.sum("_s").over(_earlier(keys, BUCKET)), F.lit(0)).alias("_before"),
            F.sum("_s").over(Window.partitionBy(*keys)).alias("_total"),
        )
        counted = counted.join(sums, [*keys, BUCKET])
    else:
        counted = counted.withColumn(BUCKET, F.lit(0)).withColumn("_before", F.lit(0))
        counted = counted.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, BUCKET).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_hi", F.col("_before") + F.sum("_n").over(inside))
    ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_x")))

    aggs = [F.max("_total").alias("_t")]
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        aggs += [at(F.floor(spot)).alias(f"_a_{name}"), at(F.ceil(spot)).alias(f"_b_{name}")]
    picked = ranked.groupBy(*keys).agg(*aggs)
    outs = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_t") - 1)
        low, high = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        outs.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return picked.select(*keys, *outs)
