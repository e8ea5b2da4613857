"""Views that let the driver's tables play the roles of recordings, spans and trials.

The operators are the same ones used on real recordings; only the inputs differ.
Each view has a SQL twin used by the DuckDB checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subvox.plans.ordered import add_position, drop_halo, halo_window, running_sum, with_halo


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def px_signal(spark: SparkSession, folder: str) -> DataFrame:
    """One-channel samples: a user is a session, the time order is the sample index."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"), "ts", "event_id", F.col("value").alias("x"), F.col("event_type").alias("label")
    )
    rows = add_position(rows, ["session_id"], ["ts", "event_id"], on=micros("ts"), name="sample")
    return rows.select("session_id", "sample", "x", "label", "ts")


PX_SIGNAL_SQL = """px_signal AS (
  SELECT user_id AS session_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample,
         value AS x, event_type AS label, ts
  FROM events)"""


def px_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one event type as labelled half-open sample spans."""
    chunk = 65_536
    signal = px_signal(spark, folder).select("session_id", "sample", "label")
    near = with_halo(signal, ["session_id"], "sample", chunk=chunk, before=1)
    fresh = F.coalesce(F.lag("label").over(halo_window(["session_id"], "sample")) != F.col("label"), F.lit(True))
    starts = drop_halo(near.withColumn("_new", fresh.cast("long")))
    runs = running_sum(starts, ["session_id"], "sample", {"event_id": F.col("_new")}, chunk=chunk)
    return runs.groupBy("session_id", "event_id").agg(
        F.min("sample").alias("start_sample"),
        (F.max("sample") + 1).alias("end_sample"),
        F.first("label").alias("label"),
    )


PX_SPANS_SQL = (
    PX_SIGNAL_SQL
    + """,
px_new AS (
  SELECT session_id, sample, label,
         CASE WHEN lag(label) OVER (PARTITION BY session_id ORDER BY sample) = label THEN 0 ELSE 1 END AS fresh
  FROM px_signal),
px_runs AS (
  SELECT session_id, sample, label, sum(fresh) OVER (PARTITION BY session_id ORDER BY sample) AS event_id FROM px_new),
px_spans AS (
  SELECT session_id, CAST(event_id AS BIGINT) AS event_id, min(sample) AS start_sample, max(sample) + 1 AS end_sample,
         min(label) AS label
  FROM px_runs GROUP BY session_id, event_id)"""
)


def px_frames(spark: SparkSession, folder: str) -> DataFrame:
    """64-channel frames with a phone number each, in ``vec_id`` order."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("frame"), F.col("embedding").alias("x"), F.col("label").cast("long").alias("phone")
    )


PX_FRAMES_SQL = """px_frames AS (
  SELECT vec_id AS frame, embedding AS x, CAST(label AS BIGINT) AS phone FROM embeddings)"""


def px_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Trials of words: an order is a trial, its lines are the slots, the brand is the word."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("trial_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_shipdate", "l_discount",
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    on = F.col("l_linenumber").cast("double") * F.lit(1e12) + F.col("l_partkey")
    slots = add_position(lines, ["trial_id"], order, on=on, name="word_idx")
    words = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("label"))
    return slots.join(words, "l_partkey").select(
        "trial_id", "word_idx", "label", (F.lit(0.5) + 5 * F.abs("l_discount")).alias("conf")
    )


PX_TRIALS_SQL = """px_trials AS (
  SELECT l_orderkey AS trial_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_shipdate) - 1 AS word_idx,
         p_brand AS label, 0.5 + 5 * abs(l_discount) AS conf
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def px_pred(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions: the guess for a slot is the next word of the trial, the last one is right."""
    near = with_halo(px_trials(spark, folder), ["trial_id"], "word_idx", chunk=4096, after=1)
    guess = F.coalesce(F.lead("label").over(halo_window(["trial_id"], "word_idx")), F.col("label"))
    return drop_halo(near.withColumn("hyp", guess)).select(
        "trial_id", "word_idx", F.col("label").alias("ref"), "hyp", "conf"
    )


PX_PRED_SQL = (
    PX_TRIALS_SQL
    + """,
px_pred AS (
  SELECT trial_id, word_idx, label AS ref,
         coalesce(lead(label) OVER (PARTITION BY trial_id ORDER BY word_idx), label) AS hyp, conf
  FROM px_trials)"""
)


def px_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk rows with a quality reading on some of them."""
    return px_signal(spark, folder).select(
        "session_id", F.col("sample").alias("seq"), F.when(F.col("label") == "error", F.col("x")).alias("snr_db")
    )


PX_QUALITY_SQL = (
    PX_SIGNAL_SQL
    + """,
px_quality AS (
  SELECT session_id, sample AS seq, CASE WHEN label = 'error' THEN x END AS snr_db FROM px_signal)"""
)


def px_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded sessions with rate, channels, mode and the baseline of their user."""
    orders = table(spark, folder, "orders")
    users = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 500).alias("baseline"), "c_mktsegment"
    )
    status, urgency, segment = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("c_mktsegment")
    return orders.join(users, "o_custkey").select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(status == "F", 250).when(status == "O", 1000).otherwise(5000).cast("long").alias("fs_hz"),
        F.when(segment == "BUILDING", 7).when(segment == "MACHINERY", 31).otherwise(8).cast("long").alias("channels"),
        "baseline",
        F.when(urgency == "1-URGENT", "standard")
        .when(urgency == "2-HIGH", "clinical")
        .when(urgency == "3-MEDIUM", "wide")
        .when(urgency == "4-NOT SPECIFIED", "gowda")
        .otherwise("offline")
        .alias("mode"),
        (F.col("o_totalprice") / 10_000).alias("snr_db"),
        F.col("o_totalprice").cast("long").alias("n_samples"),
        F.col("o_orderdate").alias("collected_at"),
    )


PX_SESSIONS_SQL = """px_sessions AS (
  SELECT o_orderkey AS session_id, o_custkey AS user_id,
         CAST(CASE o_orderstatus WHEN 'F' THEN 250 WHEN 'O' THEN 1000 ELSE 5000 END AS BIGINT) AS fs_hz,
         CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 7 WHEN 'MACHINERY' THEN 31 ELSE 8 END AS BIGINT) AS channels,
         c_acctbal / 500 AS baseline,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'standard' WHEN '2-HIGH' THEN 'clinical' WHEN '3-MEDIUM' THEN 'wide'
              WHEN '4-NOT SPECIFIED' THEN 'gowda' ELSE 'offline' END AS mode,
         o_totalprice / 10000 AS snr_db, CAST(trunc(o_totalprice) AS BIGINT) AS n_samples, o_orderdate AS collected_at
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


def px_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of a device in arrival order."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("device_id"), "l_shipdate", F.col("l_orderkey").alias("sample_index"), "l_linenumber",
        "l_partkey", "l_quantity", "l_extendedprice",
    )
    order = ["l_shipdate", "sample_index", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    ranked = add_position(lines, ["device_id"], order, on=micros("l_shipdate"), name="arrival_no")
    return ranked.select(
        "device_id", "arrival_no", "sample_index", F.col("l_quantity").cast("long").alias("frames"),
        F.col("l_extendedprice").alias("x"),
    )


PX_PACKETS_SQL = """px_packets AS (
  SELECT l_suppkey AS device_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity,
                            l_extendedprice) - 1 AS arrival_no,
         l_orderkey AS sample_index, CAST(l_quantity AS BIGINT) AS frames, l_extendedprice AS x
  FROM lineitem)"""
