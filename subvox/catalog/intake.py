"""Queries over packets, profiles, manifests, messages and live runs."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from subvox.catalog.decoding import predictions
from subvox.catalog.registry import SQL as _SQL
from subvox.catalog.registry import query
from subvox.catalog.signals import ISLES_SQL, LOSSY_SQL, lossy, recorded, whole
from subvox.functions.arrays import microvolts_per_count
from subvox.operators import monitor as mon
from subvox.plans import proxies as px
from subvox.plans.ordered import running_sum
from subvox.session import checkpoint_dir
from subvox.sources import packets as pk
from subvox.sources import state as st
from subvox.streaming import live

K_SQL = f"CAST('{microvolts_per_count()!r}' AS DOUBLE)"


def packed(spark, sf):
    """Binary packets from order lines: ``l_linenumber`` frames of two channels; some are damaged."""
    lines = px.px_packets(spark, sf).join(
        px.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("device_id"), "s_nationkey"), "device_id"
    )

    def pack(batches):
        for batch in batches:
            if batch["sample_index"].null_count or batch["frames"].null_count:
                raise ValueError("a packet without sample index or number of frames")
            index, frames = batch["sample_index"].to_numpy(), batch["frames"].to_numpy()
            if len(index) and (index.min() < 0 or index.max() >= 2**32 or frames.min() < 0 or frames.max() >= 2**16):
                raise ValueError("sample index or number of frames does not fit the header")
            head = np.zeros(len(index), pk.HEADER)
            head["magic"] = np.where(index % 11, int.from_bytes(b"OA", "little"), int.from_bytes(b"XX", "little"))
            head["version"] = np.where(index % 7, 1, 2)
            head["channels"], head["n_frames"], head["seq"], head["sample_index"] = 2, frames, index, index
            n = frames * 2
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            words = pk.HEADER.itemsize // 2
            ends = np.cumsum(n + words)
            at = (ends - n - words)[:, None] + np.arange(words)
            data, body = np.zeros(int((n + words).sum()), "<u2"), np.ones(int((n + words).sum()), bool)
            data[at], body[at] = head.view("<u2").reshape(-1, words), False
            data[body] = ((k * 7 + np.repeat(index, n)) % 30_000 - 15_000).astype("<i2").view("<u2")
            cut = batch["s_nationkey"].fill_null(-1).to_numpy(zero_copy_only=False) == 3
            payload = np.delete(data.view(np.uint8), 2 * ends[cut] - 1)
            bounds = np.concatenate([[0], 2 * ends - np.cumsum(cut)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(bounds), pa.py_buffer(payload)])
            yield pa.RecordBatch.from_arrays([batch["device_id"], batch["arrival_no"], binary], ["device_id", "arrival_no", "payload"])

    return lines.select("device_id", "arrival_no", "sample_index", "frames", "s_nationkey").mapInArrow(
        pack, "device_id bigint, arrival_no bigint, payload binary"
    )


@query(
    "decode_packets",
    f"""WITH {px.PX_PACKETS_SQL}, p AS (SELECT p.*, s_nationkey AS nation FROM px_packets p JOIN supplier ON s_suppkey = device_id),
v AS (SELECT *, CASE WHEN sample_index % 11 = 0 THEN 'bad magic' WHEN sample_index % 7 = 0 THEN 'unsupported version 2'
  WHEN nation = 3 THEN 'length mismatch: ' || (19 + frames * 4) || ' bytes, expected ' || (20 + frames * 4) END AS reject FROM p),
c AS (SELECT device_id, arrival_no, sum((k * 7 + sample_index) % 30000 - 15000) AS total
  FROM v, LATERAL (SELECT unnest(range(0, frames * 2)) AS k) WHERE reject IS NULL GROUP BY ALL)
SELECT CAST(v.device_id AS VARCHAR) AS device_id, v.arrival_no, CASE WHEN reject IS NULL THEN frames END AS n_frames,
       CASE WHEN reject IS NULL THEN sample_index END AS sample_index, CAST(total AS BIGINT) AS total, reject
FROM v LEFT JOIN c ON c.device_id = v.device_id AND c.arrival_no = v.arrival_no""",
)
def decode_packets(spark, sf):
    d = pk.decode_packets(packed(spark, sf))

    @F.arrow_udf("bigint")
    def total(samples: pa.Array) -> pa.Array:
        """Sum of the counts of each packet."""
        counts = np.rint(samples.values.to_numpy().astype(np.float64) / microvolts_per_count()).astype(np.int64)
        upto, ends = np.append(0, np.cumsum(counts)), samples.offsets.to_numpy()
        return pa.array(upto[ends[1:]] - upto[ends[:-1]], mask=samples.is_null().to_numpy(zero_copy_only=False))

    return d.select("device_id", "arrival_no", F.col("n_frames").cast("long").alias("n_frames"), "sample_index", total("samples").alias("total"), "reject")


@query(
    "latest_profiles",
    """WITH h AS (SELECT o_custkey AS user_id, o_orderdate AS updated, o_orderkey AS version, o_totalprice / 1000000 AS confidence_threshold, o_orderstatus = 'P' AS deleted FROM orders)
SELECT user_id, version, round(confidence_threshold, 8) AS confidence_threshold FROM h
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, version DESC) = 1 AND NOT deleted""",
)
def latest_profiles(spark, sf):
    o = px.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("updated"), F.col("o_orderkey").alias("version"),
        (F.col("o_totalprice") / 1_000_000).alias("confidence_threshold"), (F.col("o_orderstatus") == "P").alias("deleted"),
    )
    return st.latest_profiles(o, ("updated", "version")).select("user_id", "version", F.round("confidence_threshold", 8).alias("confidence_threshold"))


@query(
    "invalid_profiles",
    """WITH p AS (SELECT l_orderkey AS user_id, l_linenumber, l_quantity / 45 AS th, (l_linenumber - 1) * 100 AS w, CAST(l_quantity AS INTEGER) * 20 - 40 AS s FROM lineitem)
SELECT user_id, reason, count(*) AS n FROM (
  SELECT user_id, 'confidence_threshold must be in [0, 1]' AS reason FROM p WHERE th NOT BETWEEN 0 AND 1
  UNION ALL SELECT user_id, 'window_ms must be > 0' FROM p WHERE w <= 0
  UNION ALL SELECT user_id, 'stride_ms must be > 0' FROM p WHERE s <= 0
  UNION ALL SELECT user_id, 'stride_ms must be < window_ms' FROM p WHERE s >= w) GROUP BY ALL""",
)
def invalid_profiles(spark, sf):
    li = px.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("user_id"), (F.col("l_quantity") / 45).alias("confidence_threshold"),
        ((F.col("l_linenumber") - 1) * 100).alias("window_ms"), (F.col("l_quantity").cast("int") * 20 - 40).alias("stride_ms"),
    )
    return st.invalid_profiles(li).groupBy("user_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pending_work",
    """SELECT o_orderkey AS session_id, md5(o_orderstatus || '|' || o_custkey) AS fingerprint FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND o_orderstatus = 'F')""",
)
def pending_work(spark, sf):
    o = px.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.lit("cfg").alias("cfg_hash"), st.fingerprint("o_orderstatus", "o_custkey").alias("fingerprint"), "o_orderstatus"
    )
    started = px.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("session_id"))
    done = o.where("o_orderstatus = 'F'").join(started, "session_id", "left_semi")
    return st.pending(o, done).select("session_id", "fingerprint")


@query(
    "token_messages",
    f"""WITH {px.PX_SIGNAL_SQL} SELECT session_id, '{{"type":"token","token":"' || label || '","confidence":' || (sample % 100) || ',"seq":' || sample || ',"source":"live"}}' AS value
FROM px_signal WHERE sample % 100 BETWEEN 0 AND 1""",
)
def token_messages(spark, sf):
    s = px.px_signal(spark, sf).select(
        "session_id", F.col("label").alias("token"), (F.col("sample") % 100).alias("confidence"), F.col("sample").alias("seq")
    )
    return pk.token_messages(s, source="live")


def live_run(spark, df, key: str, pos: str, build, slices: int = 3):
    """Plays a table to a live operator in ``slices`` arrivals and reads what it wrote.

    Rows are staged in the shared folder in order of ``pos``; each arrival holds a key's
    rows in one file, so micro-batches never break the order of a key. The table is worked out
    once, not for each arrival.
    """
    folder = f"{checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/all")
    df = spark.read.schema(df.schema).parquet(f"{folder}/all")
    top = df.agg(F.max(pos).alias("m")).first()["m"]
    if top is None:
        return build(df)
    width = (top + slices) // slices
    for i in range(slices):
        part = df.where((F.col(pos) >= i * width) & (F.col(pos) < (i + 1) * width))
        part.repartition(F.col(key)).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 50).parquet(f"{folder}/in")
    out = build(stream)
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
    run = writer.option("path", f"{folder}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("stream_gaps", _SQL["detect_gaps"])
def stream_gaps(spark, sf):
    p = px.px_packets(spark, sf).select("device_id", "arrival_no", "sample_index", "frames")
    return live_run(spark, p, "device_id", "arrival_no", live.stream_gaps)


@query("stream_recalibration", _SQL["recalibration_monitor"])
def stream_recalibration(spark, sf):
    q = px.px_quality(spark, sf)
    nth = running_sum(q, ["session_id"], "seq", {"nth": F.col("snr_db").isNotNull().cast("long")}, chunk=65_536)
    readings = nth.where("snr_db IS NOT NULL").select(
        "session_id", (F.col("nth") - 1).alias("seq"), F.col("nth").cast("double").alias("t"), "snr_db", F.lit(0.0).alias("motion_index"), F.lit(20.0).alias("baseline")
    )
    out = live_run(spark, readings, "session_id", "seq", live.stream_recalibration)
    return out.select("session_id", "seq", "snr_ema", "snr_deficit_db", "low_streak", "suggested")


@query("stream_throttle", _SQL["throttle"])
def stream_throttle(spark, sf):
    e = px.px_signal(spark, sf).select("session_id", "sample", (px.micros("ts") / 1e6).alias("t"))
    return live_run(spark, e, "session_id", "sample", lambda s: live.stream_throttle(s, "session_id", 86_400.0))


@query("stream_tokens")
def stream_tokens(spark, sf):
    cfg = mon.GateConfig(stable_n=2, min_confidence=0.8, cooldown_ms=36e5, adaptive=True)
    out = live_run(spark, predictions(spark, sf), "session_id", "step", lambda s: live.stream_tokens(s, cfg))
    return out.select("session_id", "step", "token", F.round("confidence", 6).alias("confidence"), F.round("gate", 6).alias("gate"))


@query("stream_preprocess")
def stream_preprocess(spark, sf):
    out = live_run(spark, whole(spark, sf), "session_id", "block", live.stream_preprocess)
    return out.select("session_id", "block", "n_frames", F.transform("samples", lambda v: F.round(v, 4)).alias("samples"))


@query("stream_quality")
def stream_quality(spark, sf):
    out = live_run(spark, whole(spark, sf), "session_id", "block", lambda s: live.stream_quality(s, (30.0, 100.0), (0.5, 30.0)))
    return out.select("session_id", "block", "win_end", "n_frames", F.round("snr_db", 4).alias("snr_db"), F.round("motion_index", 6).alias("motion_index"))


@query(
    "stream_windows",
    f"""WITH {px.PX_SIGNAL_SQL}, n AS (SELECT session_id, count(*) AS n FROM px_signal GROUP BY session_id),
k AS (SELECT session_id, unnest(range(16, n + 1, 5)) AS win_end FROM n)
SELECT k.session_id, (win_end - 16) // 5 AS step, k.win_end, round(sum(round(s.x::FLOAT::DOUBLE, 2)), 3) AS total
FROM k JOIN px_signal s ON s.session_id = k.session_id AND s.sample >= k.win_end - 16 AND s.sample < k.win_end GROUP BY ALL""",
)
def stream_windows(spark, sf):
    out = live_run(spark, recorded(spark, sf), "session_id", "block", lambda s: live.stream_windows(s, window_ms=64, stride_ms=20))
    total = F.aggregate(F.transform("samples", lambda v: F.round(v, 2)), F.lit(0.0), lambda a, v: a + v)
    return out.select("session_id", "step", "win_end", F.round(total, 3).alias("total"))


WINDOW_TOTALS = "round(sum(round(s.x::FLOAT::DOUBLE, 2)), 3) AS total"


def _window_totals(out):
    total = F.aggregate(F.transform("samples", lambda v: F.round(v, 2)), F.lit(0.0), lambda a, v: a + v)
    return out.select("session_id", "step", "win_end", F.round(total, 3).alias("total"))


@query(
    "stream_windows_gaps",
    f"""WITH {ISLES_SQL}, n AS (SELECT session_id, origin, count(*) AS n FROM isles GROUP BY ALL),
k AS (SELECT session_id, origin, unnest(range(8, n + 1, 5)) + origin AS win_end FROM n),
w AS (SELECT k.session_id, k.origin, k.win_end, {WINDOW_TOTALS} FROM k JOIN isles s ON s.session_id = k.session_id AND s.origin = k.origin AND s.sample >= k.win_end - 8 AND s.sample < k.win_end GROUP BY ALL)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY win_end) - 1 AS step, win_end, total FROM w""",
)
def stream_windows_gaps(spark, sf):
    """No window crosses lost samples: the windows begin anew behind a gap."""
    return _window_totals(live_run(spark, lossy(spark, sf), "session_id", "block", lambda s: live.stream_windows(s, window_ms=32, stride_ms=20, on_gap="reset")))


@query(
    "stream_windows_carried",
    f"""WITH {px.PX_SIGNAL_SQL}, {LOSSY_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sample) - 1 AS place FROM lossy),
n AS (SELECT session_id, count(*) AS n FROM p GROUP BY session_id), k AS (SELECT session_id, unnest(range(16, n + 1, 5)) AS stop FROM n)
SELECT k.session_id, (k.stop - 16) // 5 AS step, max(s.sample) + 1 AS win_end, {WINDOW_TOTALS}
FROM k JOIN p s ON s.session_id = k.session_id AND s.place >= k.stop - 16 AND s.place < k.stop GROUP BY k.session_id, k.stop""",
)
def stream_windows_carried(spark, sf):
    """Windows over the samples on both sides of a gap, at their true places."""
    return _window_totals(live_run(spark, lossy(spark, sf), "session_id", "block", lambda s: live.stream_windows(s, window_ms=64, stride_ms=20)))


@query("stream_utterances")
def stream_utterances(spark, sf):
    s = px.px_signal(spark, sf)
    kind = F.when(F.col("label") == "signup", "start").when(F.col("label") == "error", "end")
    chunk = F.struct(F.lit("chunk").alias("kind"), F.array_repeat(F.col("x"), 10).alias("samples"))
    control = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.array().cast("array<double>").alias("samples")))
    rows = s.select("session_id", F.col("sample").alias("seq"), F.lit(1).alias("channels"), F.explode(F.array_compact(F.array(chunk, control))).alias("r"))
    rows = rows.select("session_id", "seq", "r.kind", "channels", "r.samples")
    out = live_run(spark, rows, "session_id", "seq", lambda d: live.stream_utterances(d, 250.0, max_ms=500.0))
    return out.select("session_id", "utterance", F.col("n_frames").cast("long").alias("n_frames"))


def loudness_scorer(window):
    """Token by the sign of the mean; a stand-in for any fixed model of one window."""
    level = float(window.mean())
    return ("up" if level >= 0 else "down"), min(1.0, 0.75 + abs(level)), False


@query("stream_decode")
def stream_decode(spark, sf):
    cfg = mon.GateConfig(stable_n=2)
    out = live_run(spark, whole(spark, sf), "session_id", "block", lambda s: live.stream_decode(s, loudness_scorer, cfg=cfg, window_ms=64, stride_ms=20))
    return out.select("session_id", "step", F.round("t", 3).alias("t"), "token", F.round("confidence", 4).alias("confidence"))
