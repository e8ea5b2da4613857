"""Tables that change: user profiles and the manifest of finished work."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PROFILE_FIELDS = (
    "user_id string, updated timestamp, confidence_threshold double, preprocessing_mode string, window_ms int, stride_ms int, "
    "calibration_samples bigint, baseline_snr double, model_path string, deleted boolean"
)


def latest_profiles(history: DataFrame, updated: Sequence[str] = ("updated",), user: str = "user_id") -> DataFrame:
    """Newest row of each user; users whose newest row is a tombstone (``deleted``) are gone.

    A max over a struct is merged map-side, so users with long histories cost no sort.
    """
    rest = [c for c in history.columns if c not in (user, *updated)]
    newest = history.groupBy(user).agg(F.max(F.struct(*updated, F.struct(*rest).alias("_r"))).alias("_m"))
    out = newest.select(user, *[F.col(f"_m.{c}").alias(c) for c in updated], "_m._r.*")
    return out.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in rest else out


def invalid_profiles(profiles: DataFrame) -> DataFrame:
    """Rows that break a range rule, with the reason."""
    rules = F.array(
        F.when(F.coalesce(F.col("user_id").cast("string"), F.lit("")) == "", "user_id must not be empty"),
        F.when(~F.col("confidence_threshold").between(0, 1), "confidence_threshold must be in [0, 1]"),
        F.when(F.col("window_ms") <= 0, "window_ms must be > 0"),
        F.when(F.col("stride_ms") <= 0, "stride_ms must be > 0"),
        F.when(F.col("stride_ms") >= F.col("window_ms"), "stride_ms must be < window_ms"),
    )
    return profiles.withColumn("reason", F.explode(F.array_compact(rules)))


def save_profiles(profiles: DataFrame, path: str) -> None:
    """Appends profile rows; nothing is rewritten."""
    profiles.write.mode("append").parquet(path)


def delete_profiles(spark: SparkSession, users: Sequence[str], path: str) -> None:
    """Appends a tombstone for each user."""
    schema = spark.read.parquet(path).schema
    rows = spark.createDataFrame([(u,) for u in users], "user_id string").withColumn("updated", F.current_timestamp()).withColumn("deleted", F.lit(True))
    cols = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    rows.select(*cols).write.mode("append").parquet(path)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return latest_profiles(spark.read.parquet(path))


def fingerprint(*parts: str | Column) -> Column:
    """Text that changes when any of the parts (size, time, events hash) changes."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("-")) for p in parts]))


def events_fingerprint(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Order-free hash of the spans of each session."""
    row = F.xxhash64("start_sample", "end_sample", "label").cast("decimal(38,0)")
    return events.groupBy(session).agg(F.sum(row).cast("string").alias("events_hash"), F.count(F.lit(1)).alias("n_events"))


def pending(source: DataFrame, done: DataFrame, on: Sequence[str] = ("session_id", "cfg_hash", "fingerprint")) -> DataFrame:
    """Source rows whose input or configuration has no finished work yet."""
    return source.join(done.select(*on), list(on), "left_anti")


def materialize(
    spark: SparkSession, source: DataFrame, stage: Callable[[DataFrame], DataFrame], path: str, cfg_hash: str, *, key: str = "session_id"
) -> int:
    """Runs ``stage`` for the sources that changed and replaces only their partitions.

    ``source(key, fingerprint)``. The manifest row is written after the data, so a job that
    dies in between does the work again. A source counts as done if its latest manifest row has this
    configuration and fingerprint: going back to an earlier one runs it again. Returns how many sources were done.
    """
    manifest = f"{path}/manifest"
    wanted = source.select(key, "fingerprint").withColumn("cfg_hash", F.lit(cfg_hash))
    try:
        rows = spark.read.parquet(manifest)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done, run = spark.createDataFrame([], wanted.schema), 0
    else:
        done = rows.groupBy(key).agg(F.max(F.struct("run", "fingerprint", "cfg_hash")).alias("_m")).select(key, "_m.fingerprint", "_m.cfg_hash")
        run = rows.agg(F.max("run")).first()[0] + 1
    todo = pending(wanted, done, (key, "cfg_hash", "fingerprint")).persist()
    n = todo.count()
    if n:
        result = stage(source.join(todo.select(key), key, "left_semi"))
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/data")
        todo.select(*wanted.columns, F.lit(run).cast("long").alias("run")).write.mode("append").parquet(manifest)
    todo.unpersist()
    return n
