"""Labelled spans: reading markers, cleaning, filtering, counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subvox.functions.fixed import NOTE_LABEL
from subvox.plans.joins import spread_join


def normalize_markers(markers: DataFrame, fs_hz: float, min_duration_s: float = 0.12) -> DataFrame:
    """Any of the four marker layouts to ``start_sample, end_sample, label``.

    The layout is told by the header. Spans with ``end <= start`` are dropped; point
    markers get a length of ``max(1, int(min_duration_s * fs))`` samples.
    """
    cols = {c.strip().lower(): c for c in markers.columns}
    if "label" not in cols:
        raise ValueError("markers need a label column")
    rest = [c for k, c in cols.items() if k not in ("label", "start_sample", "end_sample", "start_s", "end_s", "sample", "time_s")]
    label = F.col(cols["label"]).cast("string").alias("label")
    length = max(1, int(min_duration_s * fs_hz))

    def sample(name: str) -> Column:
        return F.col(cols[name]).cast("bigint")

    def second(name: str) -> Column:
        return (F.col(cols[name]).cast("double") * F.lit(float(fs_hz))).cast("bigint")

    if {"start_sample", "end_sample"} <= cols.keys():
        start, end = sample("start_sample"), sample("end_sample")
    elif {"start_s", "end_s"} <= cols.keys():
        start, end = second("start_s"), second("end_s")
    elif "sample" in cols:
        start = sample("sample")
        end = start + length
    elif "time_s" in cols:
        start = second("time_s")
        end = start + length
    else:
        raise ValueError(f"unknown marker columns {markers.columns}")
    return markers.select(*rest, start.alias("start_sample"), end.alias("end_sample"), label).where(
        "end_sample > start_sample"
    )


def sanitize_trial_events(events: DataFrame) -> DataFrame:
    """Drops rows without a trial; a missing slot becomes 0."""
    if "trial_id" not in events.columns:
        return events
    out = events.where(F.col("trial_id").isNotNull() & ~F.isnan(F.col("trial_id").cast("double")))
    out = out.withColumn("trial_id", F.col("trial_id").cast("bigint"))
    if "word_idx" in out.columns:
        slot = F.nanvl(F.col("word_idx").cast("double"), F.lit(0.0))
        out = out.withColumn("word_idx", F.coalesce(slot, F.lit(0.0)).cast("bigint"))
    return out


def filter_events(events: DataFrame, labels: Sequence[str] | None = None, word_idx: int | None = None) -> DataFrame:
    if labels is not None:
        events = events.where(F.col("label").isin(list(labels)))
    if word_idx is not None:
        events = events.where(F.col("word_idx") == int(word_idx))
    return events


def restrict_to_keys(events: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Events whose key is in ``keys`` (a semi join: no duplicates, no extra columns)."""
    return events.join(keys.select(*on), list(on), "left_semi")


def split_mode_of(meta: Column) -> Column:
    """``split_mode`` of a JSON text; empty when absent or not JSON."""
    return F.coalesce(F.get_json_object(meta, "$.split_mode"), F.lit(""))


def label_counts(events: DataFrame, min_count: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    counts = events.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    note = F.when(F.col("label").isNotNull(), F.format_string(NOTE_LABEL, "label", "n", F.lit(int(min_count))))
    return counts.withColumn("warning", F.when(F.col("n") < min_count, note))


def top_labels(events: DataFrame, k: int, min_n: int = 1) -> DataFrame:
    """The ``k`` most frequent labels with at least ``min_n`` rows; ties by label."""
    counts = events.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    return counts.orderBy(F.desc("n"), "label").limit(int(k))


def keep_top_labels(events: DataFrame, k: int, min_n: int = 1) -> DataFrame:
    return spread_join(events, top_labels(events, k, min_n).select("label"), ["label"], "left_semi", salt_by=events.columns[:2])


def merge_sessions(
    first: DataFrame, second: DataFrame, first_samples: int, split_mode: str = "sim_transfer_merged"
) -> DataFrame:
    """Spans of two recordings laid end to end: samples move by the length of the
    first, trials by its highest trial + 1. Only index columns change."""
    top = first.agg(F.max("trial_id").alias("t")).first()["t"]
    moved = (
        second.withColumn("start_sample", F.col("start_sample") + first_samples)
        .withColumn("end_sample", F.col("end_sample") + first_samples)
        .withColumn("trial_id", F.col("trial_id") + (int(top) + 1 if top is not None else 0))
    )
    both = first.withColumn("part", F.lit("first")).unionByName(moved.withColumn("part", F.lit("second")))
    return both.withColumn("split_mode", F.lit(split_mode))
