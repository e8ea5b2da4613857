"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words: its weight's share of the whole mix, stopped at ``most``
times its own words, the excess going to the others by weight. Inside a source each document is
expected ``rate = target / words of the source`` times. Its ``floor(rate)`` copies are certain;
for one more copy documents compete with inclusion probability ``p = rate - floor(rate)`` (times
their own appetite, if given): they are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with ``u``
uniform and taken from the smallest ratio on until the words that are still to be had are reached.

The order is cut into ratio bins; only the bin in which a source reaches its target is summed
row by row, so a source that holds most rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subvox.llm.common import saved, words_of

#: Weights in the order of the sources, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Bins of the ratio's order; a bin of a source holds about this part of its rows.
BINS = 4096
#: 13 hexadecimal digits of md5 make a uniform number.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """Number in (0, 1) from md5 of the parts; equal parts give equal numbers."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources are ordered by code point, null last. The reshared shares end where every source has
    ``min(level * weight, most * words)``; the level follows from the sources in the order of
    ``most * words / weight``. One row per source is sorted here, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("_k", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_k") + 1)
    stop = F.lit(float(most)) * F.col("source_size")
    rows = listed.withColumn("_w", weight).withColumn("_stop", stop).withColumn("_ratio", F.col("_stop") / F.col("_w"))
    whole = Window.partitionBy()
    climb = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    upto = climb.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_goal", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("_full", F.coalesce(F.sum("_stop").over(upto), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
        .withColumn("_at", F.row_number().over(climb))
        .withColumn("_level", (F.col("_goal") - F.col("_full")) / F.col("_left"))
    )
    level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_at", "_level"))).over(whole)["_level"]
    target = F.least(F.col("_stop"), F.coalesce(level * F.col("_w"), F.col("_stop")))
    return rows.select("source", "source_size", target.alias("target"))


def _allocate(docs: DataFrame, carry: list[str] | None, *, key="doc_id", text="text", source="source", weights=WEIGHTS, share=SHARE, most=MOST, appetite: Column | None = None, seed=SEED) -> DataFrame:
    """``_row`` (key and carried columns), ``size, source, source_size, target, copies`` of each document."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or [key]]).alias("_row"),
        F.xxhash64(f"`{key}`", f"`{text}`").alias("_h"),
        F.col(f"`{source}`").alias("source"),
        words_of(F.col(f"`{text}`")).alias("size"),
        uniform(F.lit(seed), F.col(f"`{key}`")).alias("_u"),
        F.greatest(appetite if appetite is not None else F.lit(1.0), F.lit(0.0)).cast("double").alias("_a"),
    )
    # The narrow columns are needed three times: texts are counted once for the sums (and once more where they are carried).
    narrow = saved(rows.select("source", "size", "_u", "_a") if carry else rows, "mix-sizes")
    rows = rows if carry else narrow
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_a")).alias("_wanted"))
    goals = targets(sums.select("source", "source_size"), weights, share, most)
    goals = goals.alias("g").join(sums.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.*", "s._wanted")

    rate = F.when(F.col("_wanted") > 0, F.col("target") / F.col("_wanted")).otherwise(0.0) * F.col("_a")
    def rated(frame: DataFrame) -> DataFrame:
        frame = frame.alias("r").join(goals.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        frame = frame.select("r.*", "t.source_size", "t.target", F.least(rate, F.lit(float(most))).alias("_rate"))
        p = F.col("_rate") - F.floor("_rate")
        ratio = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
        return (
            frame.withColumn("_sure", F.floor("_rate").cast("long"))
            .withColumn("_ratio", F.when(p > 0, ratio))
            .withColumn("_bin", F.when(p > 0, F.floor(F.lit(BINS) * F.col("_ratio") / (1 + F.col("_ratio"))).cast("int")))
        )

    # Words still to be had when a bin begins, from one row per source and bin.
    bins = rated(narrow).groupBy("source", "_bin", "target").agg(F.sum(F.when(F.col("_ratio").isNotNull(), F.col("size")).otherwise(0)).alias("_n"), F.sum(F.col("_sure") * F.col("size")).alias("_s"))
    of = Window.partitionBy("source")
    before = of.orderBy(F.col("_bin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        bins.withColumn("_need", F.col("target") - F.sum("_s").over(of) - F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_bin").isNotNull())
        .select(F.col("source").alias("_src"), F.col("_bin").alias("_b"), "_need", "_n")
    )
    placed = rated(rows).join(bins, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_bin") == F.col("_b")), "left")
    run = Window.partitionBy("_src", "_b", "_split").orderBy("_ratio", "size", "_h").rowsBetween(Window.unboundedPreceding, 0)
    # Bins wholly inside or outside the target need no order; they are split by chance so that no window is large.
    edge = (F.col("_need") > 0) & (F.col("_need") < F.col("_n"))
    placed = placed.withColumn("_split", F.when(edge, F.lit(-1)).otherwise(F.floor(F.col("_u") * 1e6) % 997))
    upto = F.sum("size").over(run)
    extra = F.when(F.col("_need").isNull() | (F.col("_need") <= 0), 0).when(~edge, 1).otherwise(
        F.when(upto - F.col("size") / F.lit(2.0) <= F.col("_need"), 1).otherwise(0)
    )
    copies = (F.col("_sure") + extra).cast("long")
    return placed.select("_row", "size", "source", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``key, size, source, source_size, target, copies, taken``: one row per document.

    Null text: size 0. Null source: a source of its own. Null key: takes part like any other.
    Repeated rows: each is a document; ties of the ratio are ordered by size. Empty table: no rows.
    Options: ``key, text, source`` (columns), ``weights, share, most, seed``, and ``appetite`` (a column, at least 0,
    default 1) that makes inclusion odds differ inside a source; expected copies stay at ``most`` or below.
    """
    rows = _allocate(docs, None, **options)
    taken = F.col("copies") * F.col("size")
    return rows.select("_row.*", "size", "source", "source_size", "target", "copies", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns; see ``mix``."""
    rows = _allocate(docs, docs.columns, **options).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
