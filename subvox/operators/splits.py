"""Train, validation and test splits without leaks, and repeatable samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subvox.functions.fixed import SIM_TRIALS, TEST_TRIALS, TRAIN_TRIALS, VAL_TRIALS
from subvox.plans.draws import draw, quota_cut
from subvox.plans.joins import spread_join
from subvox.plans.ordered import dealt


def _val_quota(n: Column, fraction: float) -> Column:
    wanted = F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction))).cast("long"))
    return F.when(n <= 1, F.lit(0)).otherwise(F.least(wanted, n - 1))


def split_stratified(events: DataFrame, key: Sequence[str], fraction: float, seed: int, label: str = "label") -> DataFrame:
    """Adds ``split``: every label gives ``round(n * fraction)`` rows to validation,
    at least one and never all; single rows stay in training."""
    if fraction <= 0:
        return events.withColumn("split", F.lit("train"))
    drawn = events.withColumn("_draw", draw(seed, *key))
    quotas = drawn.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumn("_val", _val_quota(F.col("_n"), fraction))
    cuts = quota_cut(drawn, [label], "_draw", quotas, "_val")
    marked = spread_join(drawn, cuts, [label], "left", salt_by=["_draw"])
    side = F.when(F.col("_draw") <= F.col("_cut"), "val").otherwise("train")
    return marked.withColumn("split", side).drop("_draw", "_cut")


def dominant_labels(events: DataFrame, group: Sequence[str], label: str = "label") -> DataFrame:
    """Most frequent label of each group; ties go to the smallest label."""
    counts = events.groupBy(*group, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(label).alias("l"))).alias("_b")).select(
        *group, F.col("_b.l").alias(label)
    )


def split_grouped(events: DataFrame, group: Sequence[str], fraction: float, seed: int, label: str = "label") -> DataFrame:
    """Stratified split of whole groups by their dominant label."""
    events = dealt(events, group, events.count())
    groups = split_stratified(dominant_labels(events, group, label), group, fraction, seed, label)
    return events.join(groups.select(*group, "split"), list(group))


def official_side(trial: Column, train: int = TRAIN_TRIALS, val: int = VAL_TRIALS, test: int = TEST_TRIALS) -> Column:
    return (
        F.when(trial < train, "train").when(trial < train + val, "val").when(trial < train + val + test, "test")
    )


def merged_side(trial: Column, sim: int = SIM_TRIALS, train: int = TRAIN_TRIALS, val: int = VAL_TRIALS) -> Column:
    return F.when((trial < train) | (trial >= sim), "train").when(trial < train + val, "val").otherwise("test")


def split_official(events: DataFrame, trial: str = "trial_id", **sizes: int) -> DataFrame:
    """Split by trial number; trials past the test range are dropped."""
    return events.withColumn("split", official_side(F.col(trial), **sizes)).where("split IS NOT NULL")


def split_merged(events: DataFrame, session: Sequence[str] = ("session_id",), trial: str = "trial_id") -> DataFrame:
    """Official split, or the merged one for sessions marked so or with trials past the simulated block."""
    tops = events.groupBy(*session).agg(F.max(trial).alias("_top"))
    with_top = spread_join(events, tops, list(session), salt_by=[trial])
    merged = F.col("_top") >= SIM_TRIALS
    if "split_mode" in events.columns:
        merged = merged | (F.lower(F.trim("split_mode")) == "sim_transfer_merged")
    side = F.when(merged, merged_side(F.col(trial))).otherwise(official_side(F.col(trial)))
    return with_top.withColumn("split", side).drop("_top").where("split IS NOT NULL")


def resolve_split(
    events: DataFrame, mode: str, *, key: Sequence[str], fraction: float = 0.2, seed: int = 1337, group: Sequence[str] | None = None
) -> DataFrame:
    """Chooses the split: ``auto``, ``event``, ``group`` or the official trial ranges."""
    mode = (mode or "auto").strip().lower()
    if mode == "auto":
        mode = "group" if group else "event"
    if mode == "event":
        return split_stratified(events, key, fraction, seed)
    if mode in ("group", "gowda", "official") and not group:
        raise ValueError(f"split {mode} needs group columns")
    if mode == "group":
        return split_grouped(events, group, fraction, seed)
    if mode in ("gowda", "official"):
        return split_official(events, group[-1])
    raise ValueError(f"unknown split {mode}")


def sample_trials(
    events: DataFrame, fraction: float, seed: int, session: Sequence[str] = ("session_id",), trial: str = "trial_id",
    train: int = TRAIN_TRIALS,
) -> DataFrame:
    """Whole trials: a share of each session's training trials; 0 gives none, 1 gives all events."""
    fraction = min(1.0, max(0.0, float(fraction)))
    if fraction <= 0:
        return events.limit(0)
    if fraction >= 1:
        return events
    trials = events.where(F.col(trial) < train).select(*session, trial).distinct().withColumn("_draw", draw(seed, *session, trial))
    n = F.count(F.lit(1))
    quotas = trials.groupBy(*session).agg(n.alias("_n")).withColumn(
        "_q", F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)).cast("long"))
    )
    cuts = quota_cut(trials, session, "_draw", quotas, "_q")
    kept = spread_join(trials, cuts, list(session), salt_by=["_draw"]).where("_draw <= _cut").select(*session, trial)
    return events.join(kept, [*session, trial], "left_semi")


def sample_events(events: DataFrame, n: int, seed: int, key: Sequence[str], session: Sequence[str] = ("session_id",)) -> DataFrame:
    """At most ``n`` events of each session."""
    drawn = events.withColumn("_draw", draw(seed, *key))
    quotas = drawn.groupBy(*session).agg(F.lit(int(n)).alias("_q"))
    cuts = quota_cut(drawn, session, "_draw", quotas, "_q")
    return spread_join(drawn, cuts, list(session), salt_by=["_draw"]).where("_draw <= _cut").drop("_draw", "_cut")
