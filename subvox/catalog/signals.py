"""Queries over samples: joins with spans, windows, filters, quality and gaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from subvox.catalog.registry import query
from subvox.functions.design import low_filter, mode_filter
from subvox.operators import blocks as bl
from subvox.operators import filtering as fl
from subvox.operators import quality as ql
from subvox.operators import signal as sg
from subvox.plans import proxies as px
from subvox.plans.ordered import drop_halo, halo_window, last_known, running_sum, with_halo

BLOCK = 16
# The proxy samples stand for a rate at which the standard band and the notch exist.
FS = 250.0
S = px.PX_SIGNAL_SQL


def recorded(spark, sf, mode="standard"):
    """Block rows of the proxy recording, with rate and mode attached."""
    blocks = bl.to_blocks(px.px_signal(spark, sf).select("session_id", "sample", "x"), BLOCK)
    return blocks.withColumn("mode", F.lit(mode)).withColumn("fs_hz", F.lit(FS))


def long(blocks):
    """Block rows back to one value per row."""
    return blocks.select("session_id", "start_sample", F.posexplode("samples").alias("i", "y")).select(
        "session_id", (F.col("start_sample") + F.col("i")).alias("sample"), "y"
    )


@query(
    "normalize_zscore",
    f"""WITH {S} SELECT session_id, sample,
  round((x - avg(x) OVER (PARTITION BY session_id)) / (stddev_pop(x) OVER (PARTITION BY session_id) + 1e-8::DOUBLE), 5) + 0.0 AS z FROM px_signal""",
)
def normalize_zscore(spark, sf):
    s = px.px_signal(spark, sf).select("session_id", "sample", F.col("x").alias("z"))
    z = sg.normalize_values(s, ["session_id"], "z", salt_by=["sample"])
    return z.withColumn("z", F.round("z", 5) + 0.0)


@query(
    "normalize_minmax",
    f"""WITH {S} SELECT session_id, sample, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + 1e-8::DOUBLE), 5) AS z
FROM px_signal WINDOW w AS (PARTITION BY session_id)""",
)
def normalize_minmax(spark, sf):
    s = px.px_signal(spark, sf).select("session_id", "sample", F.col("x").alias("z"))
    return sg.normalize_values(s, ["session_id"], "z", "minmax", salt_by=["sample"]).withColumn("z", F.round("z", 5))


@query(
    "normalize_blocks",
    f"""WITH {S}, f AS (SELECT session_id, sample, x::FLOAT::DOUBLE AS x FROM px_signal)
SELECT session_id, sample, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + 1e-8::DOUBLE), 5) AS z
FROM f WINDOW w AS (PARTITION BY session_id)""",
)
def normalize_blocks(spark, sf):
    z = long(sg.normalize_blocks(recorded(spark, sf), "minmax"))
    return z.select("session_id", "sample", F.round("y", 5).alias("z"))


@query(
    "detect_gaps",
    f"""WITH {px.PX_PACKETS_SQL}, g AS (SELECT device_id, arrival_no, sample_index, frames,
  greatest(0, sample_index - coalesce(lag(sample_index + frames) OVER (PARTITION BY device_id ORDER BY arrival_no), sample_index)) AS lost FROM px_packets)
SELECT device_id, arrival_no, CAST(lost AS BIGINT) AS lost,
       CAST(sum(lost) OVER (PARTITION BY device_id ORDER BY arrival_no) AS BIGINT) AS lost_total FROM g""",
)
def detect_gaps(spark, sf):
    return sg.detect_gaps(px.px_packets(spark, sf).select("device_id", "arrival_no", "sample_index", "frames")).select(
        "device_id", "arrival_no", "lost", "lost_total"
    )


@query(
    "assemble_recordings",
    f"""WITH {px.PX_PACKETS_SQL}, g AS (SELECT DISTINCT device_id, sample_index FROM px_packets),
s AS (SELECT DISTINCT device_id, sample_index * 4 + k AS sample FROM g, range(0, 4) t(k))
SELECT device_id AS session_id, sample // 256 AS block, min(sample) AS start_sample, count(*) AS n_frames, CAST(sum(sample % 1000) AS BIGINT) AS total
FROM s GROUP BY ALL""",
)
def assemble_recordings(spark, sf):
    p = px.px_packets(spark, sf).select(F.col("device_id").alias("session_id"), (F.col("sample_index") * 4).alias("sample_index"))
    values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("sample_index") + i) % 1000).cast("float"))
    chunks = p.select("session_id", "sample_index", F.lit(4).alias("n_frames"), F.lit(1).alias("channels"), values.alias("samples"))
    out = bl.assemble_recordings(chunks, 256)
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))
    return out.groupBy("session_id", "block").agg(F.min("start_sample").alias("start_sample"), F.sum("n_frames").alias("n_frames"), F.sum(total).alias("total"))


@query(
    "assemble_runs",
    f"""WITH {px.PX_PACKETS_SQL}, s AS (SELECT DISTINCT device_id, sample_index * 4 + k AS sample FROM px_packets, range(0, 6) t(k)),
r AS (SELECT *, sample - row_number() OVER (PARTITION BY device_id, sample // 256 ORDER BY sample) AS isle FROM s)
SELECT device_id AS session_id, sample // 256 AS block, min(sample) AS start_sample, count(*) AS n_frames, CAST(sum((sample % 1000) * (sample % 256)) AS BIGINT) AS total
FROM r GROUP BY device_id, sample // 256, isle""",
)
def assemble_runs(spark, sf):
    """Overlapping chunks of six samples, a row per contiguous run; the total weighs each sample by its place."""
    p = px.px_packets(spark, sf).select(F.col("device_id").alias("session_id"), (F.col("sample_index") * 4).alias("sample_index"))
    values = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col("sample_index") + i) % 1000).cast("float"))
    chunks = p.select("session_id", "sample_index", F.lit(6).alias("n_frames"), F.lit(1).alias("channels"), values.alias("samples"))
    out = bl.assemble_recordings(chunks, 256)
    weighed = F.transform("samples", lambda v, i: v.cast("long") * ((F.col("start_sample") + i) % 256))
    total = F.aggregate(weighed, F.lit(0).cast("long"), lambda a, v: a + v)
    return out.select("session_id", "block", "start_sample", F.col("n_frames").cast("long").alias("n_frames"), total.alias("total"))


@query(
    "recording_summary",
    f"WITH {S} SELECT session_id, count(*) AS n_samples, max(sample) + 1 AS end_sample, (max(sample) // 16) + 1 AS n_blocks, count(*) / 250.0::DOUBLE AS duration_s FROM px_signal GROUP BY session_id",
)
def recording_summary(spark, sf):
    return bl.recording_summary(recorded(spark, sf), FS)


WIDE_SPANS = "wide AS (SELECT session_id, event_id, label, greatest(start_sample - 10, 0) AS a, end_sample + 10 AS b FROM px_spans)"


def wide_spans(spark, sf):
    """Spans widened by ten samples, so that they cross blocks and overlap."""
    spans = px.px_spans(spark, sf)
    return spans.withColumn("start_sample", F.greatest(F.col("start_sample") - 10, F.lit(0))).withColumn("end_sample", F.col("end_sample") + 10)


@query(
    "cut_events",
    f"""WITH {px.PX_SPANS_SQL}, {WIDE_SPANS}
SELECT w.session_id, w.event_id, w.label, count(*) AS n_frames, round(sum(s.x), 3) AS total,
       round(arg_min(s.x, s.sample), 3) AS first_x, round(arg_max(s.x, s.sample), 3) AS last_x
FROM wide w JOIN px_signal s ON s.session_id = w.session_id AND s.sample >= w.a AND s.sample < w.b GROUP BY ALL""",
)
def cut_events(spark, sf):
    c = bl.cut_events(recorded(spark, sf), wide_spans(spark, sf), BLOCK)
    cents = F.transform("samples", lambda v: F.round(v.cast("double"), 2))
    total = F.aggregate(cents, F.lit(0.0), lambda a, v: a + v)
    return c.select(
        "session_id", "event_id", "label", F.col("n_frames").cast("long").alias("n_frames"), F.round(total, 3).alias("total"),
        F.round(cents[0], 3).alias("first_x"), F.round(F.element_at(cents, -1), 3).alias("last_x"),
    )


# A recording with holes: four samples of every 29 are lost, and twenty of every 97.
LOSSY_SQL = "lossy AS (SELECT * FROM px_signal WHERE NOT (sample % 29 BETWEEN 11 AND 14 OR sample % 97 BETWEEN 40 AND 59))"


def lossy(spark, sf, frames=BLOCK, mode="standard"):
    """Block rows of the proxy recording with lost samples: a row per contiguous run."""
    s = px.px_signal(spark, sf).where("NOT (sample % 29 BETWEEN 11 AND 14 OR sample % 97 BETWEEN 40 AND 59)")
    blocks = bl.to_blocks(s.select("session_id", "sample", "x"), frames)
    return blocks.withColumn("mode", F.lit(mode)).withColumn("fs_hz", F.lit(FS))


@query(
    "cut_events_gaps",
    f"""WITH {px.PX_SPANS_SQL}, {WIDE_SPANS}, {LOSSY_SQL}
SELECT w.session_id, w.event_id, w.label, max(w.b - w.a) AS n_frames, max(w.b - w.a) - count(*) AS lost, round(sum(s.x * (s.sample - w.a + 1)), 2) AS weighed
FROM wide w JOIN lossy s ON s.session_id = w.session_id AND s.sample >= w.a AND s.sample < w.b GROUP BY ALL""",
)
def cut_events_gaps(spark, sf):
    """Events of a recording with holes, zeros in place of lost samples; each sample is weighed by its place in the event."""
    c = bl.cut_events(lossy(spark, sf), wide_spans(spark, sf), BLOCK, on_gap="fill")
    weighed = F.transform("samples", lambda v, i: F.round(v.cast("double"), 2) * (i + 1))
    total = F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v)
    return c.select("session_id", "event_id", "label", F.col("n_frames").cast("long").alias("n_frames"), "lost", F.round(total, 2).alias("weighed"))


@query(
    "cut_events_runs",
    f"""WITH {px.PX_SPANS_SQL}, {WIDE_SPANS}, {LOSSY_SQL},
m AS (SELECT w.session_id, w.event_id, w.label, w.a, w.b, s.sample, s.x, s.sample - row_number() OVER (PARTITION BY w.session_id, w.event_id ORDER BY s.sample) AS isle
      FROM wide w JOIN lossy s ON s.session_id = w.session_id AND s.sample >= w.a AND s.sample < w.b),
r AS (SELECT session_id, event_id, label, min(sample) AS start_sample, max(sample) + 1 AS end_sample, round(sum(x), 3) AS total, max(b - a) AS n FROM m GROUP BY session_id, event_id, label, isle)
SELECT session_id, event_id, label, row_number() OVER (PARTITION BY session_id, event_id ORDER BY start_sample) AS run, start_sample, end_sample,
       CAST(n - sum(end_sample - start_sample) OVER (PARTITION BY session_id, event_id) AS BIGINT) AS lost, total FROM r""",
)
def cut_events_runs(spark, sf):
    c = bl.cut_events(lossy(spark, sf), wide_spans(spark, sf), BLOCK, on_gap="split")
    total = F.aggregate(F.transform("samples", lambda v: F.round(v.cast("double"), 2)), F.lit(0.0), lambda a, v: a + v)
    return c.select("session_id", "event_id", "label", "run", "start_sample", "end_sample", "lost", F.round(total, 3).alias("total"))


@query(
    "fixed_segments",
    f"""WITH {px.PX_SPANS_SQL}, {WIDE_SPANS},
n AS (SELECT w.session_id, w.event_id, w.a, count(*) AS n FROM wide w JOIN px_signal s ON s.session_id = w.session_id AND s.sample >= w.a AND s.sample < w.b GROUP BY ALL),
c AS (SELECT *, CASE WHEN n >= 16 THEN ('0x' || substr(md5('9:' || session_id || ':' || event_id), 1, 8))::BIGINT % greatest(n - 15, 1) ELSE 0 END AS crop FROM n WHERE n >= 8)
SELECT c.session_id, c.event_id, c.crop AS crop_start, CAST(16 AS BIGINT) AS n_frames, round(sum(s.x), 3) AS total
FROM c JOIN px_signal s ON s.session_id = c.session_id AND s.sample >= c.a + c.crop AND s.sample < c.a + least(c.crop + 16, c.n) GROUP BY ALL""",
)
def fixed_segments(spark, sf):
    cut = bl.cut_events(recorded(spark, sf), wide_spans(spark, sf), BLOCK)
    seg = bl.fixed_segments(cut, 1, 16_000, 9)
    total = F.aggregate(F.transform("samples", lambda v: F.round(v.cast("double"), 2)), F.lit(0.0), lambda a, v: a + v)
    return seg.select("session_id", "event_id", "crop_start", F.col("n_frames").cast("long").alias("n_frames"), F.round(total, 3).alias("total"))


@query(
    "sliding_windows",
    f"""WITH {px.PX_SPANS_SQL}, {WIDE_SPANS},
n AS (SELECT w.session_id, w.event_id, w.a, count(*) AS n FROM wide w JOIN px_signal s ON s.session_id = w.session_id AND s.sample >= w.a AND s.sample < w.b GROUP BY ALL),
k AS (SELECT *, unnest(range(0, n - 7, 4)) AS win_start FROM n)
SELECT k.session_id, k.event_id, CAST(k.win_start // 4 AS BIGINT) AS window, k.win_start, round(sum(s.x), 3) AS total
FROM k JOIN px_signal s ON s.session_id = k.session_id AND s.sample >= k.a + k.win_start AND s.sample < k.a + k.win_start + 8 GROUP BY ALL""",
)
def sliding_windows(spark, sf):
    cut = bl.cut_events(recorded(spark, sf), wide_spans(spark, sf), BLOCK)
    w = bl.sliding_windows(cut, 8, 4)
    total = F.aggregate(F.transform("samples", lambda v: F.round(v.cast("double"), 2)), F.lit(0.0), lambda a, v: a + v)
    return w.select("session_id", "event_id", F.col("window").cast("long").alias("window"), "win_start", F.round(total, 3).alias("total"))


@query(
    "window_means",
    f"""WITH {S}, k AS (SELECT session_id, unnest(range(0, count(*) - 7, 4)) AS win_start FROM px_signal GROUP BY session_id)
SELECT k.session_id, CAST(k.win_start // 4 AS BIGINT) AS window, k.win_start, round(avg(s.x), 5) AS mean, round(stddev_pop(s.x), 4) AS std
FROM k JOIN px_signal s ON s.session_id = k.session_id AND s.sample >= k.win_start AND s.sample < k.win_start + 8 GROUP BY ALL""",
)
def window_means(spark, sf):
    w = bl.window_means(px.px_signal(spark, sf).select("session_id", "sample", "x"), 8, 4)
    return w.select("session_id", "window", "win_start", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"))


@query(
    "asof_quality",
    f"""WITH {px.PX_QUALITY_SQL} SELECT session_id, seq, last_value(snr_db IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS snr_db FROM px_quality""",
)
def asof_quality(spark, sf):
    q = px.px_quality(spark, sf).withColumnRenamed("snr_db", "reading")
    return last_known(q, ["session_id"], "seq", {"snr_db": F.col("reading")}, chunk=65_536).select("session_id", "seq", "snr_db")


@query(
    "rolling_snr",
    f"""WITH {px.PX_QUALITY_SQL} SELECT session_id, seq, round(avg(snr_db) OVER (PARTITION BY session_id ORDER BY seq ROWS 15 PRECEDING), 7) AS snr_mean
FROM px_quality WHERE snr_db IS NOT NULL""",
)
def rolling_snr(spark, sf):
    q = px.px_quality(spark, sf)
    counted = running_sum(q, ["session_id"], "seq", {"nth": F.col("snr_db").isNotNull().cast("long")}, chunk=65_536)
    near = with_halo(counted.where("snr_db IS NOT NULL"), ["session_id"], "nth", chunk=4096, before=15)
    mean = F.avg("snr_db").over(halo_window(["session_id"], "nth").rowsBetween(-15, 0))
    return drop_halo(near.withColumn("snr_mean", F.round(mean, 7))).select("session_id", "seq", "snr_mean")


@query(
    "weak_channels",
    f"""WITH {px.PX_QUALITY_SQL}, m AS (SELECT session_id, quantile_cont(snr_db, 0.5) AS med FROM px_quality WHERE snr_db IS NOT NULL GROUP BY session_id)
SELECT q.session_id, q.seq AS channel, q.snr_db, round(m.med, 5) AS median_snr_db FROM px_quality q JOIN m USING (session_id) WHERE q.snr_db < m.med - 6""",
)
def weak_channels(spark, sf):
    channels = px.px_quality(spark, sf).withColumnRenamed("seq", "channel")
    return ql.weak_channels(channels, 6.0).select("session_id", "channel", "snr_db", F.round("median_snr_db", 5).alias("median_snr_db"))


@query(
    "channel_rms",
    """WITH v AS (SELECT CAST(label AS BIGINT) AS phone, unnest(range(0, 64)) AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT phone, CAST(channel AS BIGINT) AS channel, round(sqrt(avg(x * x)), 6) AS rms FROM v GROUP BY ALL""",
)
def channel_rms(spark, sf):
    m = sg.moments(px.px_frames(spark, sf), ["phone"], 64, "x")
    return sg.channel_rms(m, ["phone"]).select("phone", F.col("channel").cast("long").alias("channel"), F.round("rms", 6).alias("rms"))


@query(
    "mean_abs_offdiag_corr",
    """WITH v AS (SELECT CAST(label AS BIGINT) AS phone, vec_id, unnest(range(0, 64)) AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT a.phone, a.channel AS i, b.channel AS j, corr(a.x, b.x) AS r, count(*) AS n FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.channel < b.channel GROUP BY ALL)
SELECT phone, round(avg(abs(r)), 6) AS corr_offdiag_mean, count(*) AS n_pairs FROM c WHERE n >= 32 GROUP BY phone""",
)
def mean_abs_offdiag_corr(spark, sf):
    m = sg.moments(px.px_frames(spark, sf), ["phone"], 64, "x")
    return sg.mean_abs_offdiag_corr(m, ["phone"]).withColumn("corr_offdiag_mean", F.round("corr_offdiag_mean", 6))


def _recurrence(flt, at_rest: bool) -> str:
    """The state equations of a filter as a recursive query over the samples."""
    d = flt.size
    begin = flt.start if at_rest else np.zeros(d)
    step = [
        " + ".join([f"({flt.a[i, j]!r}::DOUBLE) * s{j}" for j in range(d) if flt.a[i, j]] + [f"({flt.b[i]!r}::DOUBLE) * x"])
        for i in range(d)
    ]
    out = " + ".join([f"({flt.c[j]!r}::DOUBLE) * s{j}" for j in range(d) if flt.c[j]] + [f"({flt.d!r}::DOUBLE) * x"])
    clean = lambda t: t.replace("np.float64(", "(")
    names = ", ".join(f"s{i}" for i in range(d))
    init = ", ".join(f"{float(v)!r}::DOUBLE AS s{i}" for i, v in enumerate(begin))
    return f"""f AS (SELECT session_id, sample, x::FLOAT::DOUBLE AS x FROM px_signal),
r AS (SELECT session_id, sample, x, {init} FROM f WHERE sample = 0
      UNION ALL
      SELECT f.session_id, f.sample, f.x, {", ".join(f"n{i}" for i in range(d))}
      FROM (SELECT session_id, sample + 1 AS sample, {", ".join(f"{clean(e)} AS n{i}" for i, e in enumerate(step))} FROM r) q
      JOIN f ON f.session_id = q.session_id AND f.sample = q.sample),
y AS (SELECT session_id, sample, x, {clean(out)} AS y FROM r)"""


@query(
    "bandpass_causal",
    f"""WITH RECURSIVE {S}, {_recurrence(mode_filter("standard", FS), True)}
SELECT session_id, sample, round(y, 4) + 0.0 AS y FROM y""",
)
def bandpass_causal(spark, sf):
    return long(fl.bandpass_causal(recorded(spark, sf))).withColumn("y", F.round("y", 4) + 0.0)


@query(
    "bandpass_harmonics",
    f"""WITH RECURSIVE {S}, {_recurrence(mode_filter("clinical", FS, harmonics=True), True)}
SELECT session_id, sample, round(y, 4) + 0.0 AS y FROM y""",
)
def bandpass_harmonics(spark, sf):
    return long(fl.bandpass_causal(recorded(spark, sf, "clinical"), harmonics=True)).withColumn("y", F.round("y", 4) + 0.0)


@query(
    "motion_index",
    f"""WITH RECURSIVE {S}, {_recurrence(low_filter(4, 5.0, FS), False)},
m AS (SELECT session_id, sqrt(avg(y * y)) AS w, sqrt(avg(x * x)) AS t FROM y GROUP BY session_id)
SELECT session_id, round(least(1.0, w / (t + 1e-6::DOUBLE)), 6) AS motion_index, round(w, 5) AS baseline_wander FROM m""",
)
def motion_index(spark, sf):
    return fl.motion_sessions(recorded(spark, sf)).select(
        "session_id", F.round("motion_index", 6).alias("motion_index"), F.round("baseline_wander", 5).alias("baseline_wander")
    )


# Each run of a recording with holes as a session of its own, for the recursive equations.
ISLES_SQL = f"""{S}, {LOSSY_SQL},
isles AS (SELECT *, min(sample) OVER (PARTITION BY session_id, isle) AS origin
          FROM (SELECT *, sample - row_number() OVER (PARTITION BY session_id ORDER BY sample) AS isle FROM lossy))"""


@query(
    "bandpass_causal_gaps",
    f"""WITH RECURSIVE {ISLES_SQL},
runs AS (SELECT session_id || ':' || origin AS session_id, sample - origin AS sample, x FROM isles),
{_recurrence(mode_filter("standard", FS), True).replace("FROM px_signal", "FROM runs", 1)}
SELECT CAST(split_part(session_id, ':', 1) AS BIGINT) AS session_id, CAST(split_part(session_id, ':', 2) AS BIGINT) + sample AS sample, round(y, 4) + 0.0 AS y FROM y""",
)
def bandpass_causal_gaps(spark, sf):
    """The filter starts anew behind each gap."""
    return long(fl.bandpass_causal(lossy(spark, sf), on_gap="reset")).withColumn("y", F.round("y", 4) + 0.0)


@query(
    "bandpass_causal_carried",
    f"""WITH RECURSIVE {S}, {LOSSY_SQL},
runs AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY sample) - 1 AS sample, sample AS place, x FROM lossy),
{_recurrence(mode_filter("standard", FS), True).replace("FROM px_signal", "FROM runs", 1)}
SELECT y.session_id, place AS sample, round(y, 4) + 0.0 AS y FROM y JOIN runs USING (session_id, sample)""",
)
def bandpass_causal_carried(spark, sf):
    """The filter goes on across gaps, as a live chain that is not told of them; each output stands at its sample's place."""
    return long(fl.bandpass_causal(lossy(spark, sf))).withColumn("y", F.round("y", 4) + 0.0)


def whole(spark, sf):
    """Blocks of 256 samples, the shape recordings have."""
    blocks = bl.to_blocks(px.px_signal(spark, sf).select("session_id", "sample", "x"), 256)
    return blocks.withColumn("mode", F.lit("standard")).withColumn("fs_hz", F.lit(FS))


@query(
    "ema_normalize",
    f"""WITH RECURSIVE {S}, f AS (SELECT session_id, sample // 128 AS k, sample, x::FLOAT::DOUBLE AS x FROM px_signal),
c AS (SELECT session_id, k, avg(x) AS m1, avg(x * x) AS m2 FROM f GROUP BY ALL),
r AS (SELECT session_id, k, 0.01::DOUBLE * m1 AS mu, 0.99::DOUBLE + 0.01::DOUBLE * (m2 - 2 * (0.01::DOUBLE * m1) * m1 + (0.01::DOUBLE * m1) ** 2) AS v FROM c WHERE k = 0
      UNION ALL
      SELECT q.session_id, q.k, q.mu, 0.99::DOUBLE * q.v + 0.01::DOUBLE * (q.m2 - 2 * q.mu * q.m1 + q.mu ** 2)
      FROM (SELECT c.session_id, c.k, c.m1, c.m2, 0.99::DOUBLE * r.mu + 0.01::DOUBLE * c.m1 AS mu, r.v
            FROM r JOIN c ON c.session_id = r.session_id AND c.k = r.k + 1) q)
SELECT f.session_id, f.sample, round((f.x - r.mu) / (sqrt(r.v) + 1e-6::DOUBLE), 4) + 0.0 AS y FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k""",
)
def ema_normalize(spark, sf):
    return long(fl.ema_normalize(whole(spark, sf))).withColumn("y", F.round("y", 4) + 0.0)


@query(
    "ema_normalize_gaps",
    f"""WITH RECURSIVE {ISLES_SQL},
f AS (SELECT session_id, origin, sample, x::FLOAT::DOUBLE AS x, greatest(origin, sample // 16 * 16) AS a FROM isles),
c AS (SELECT session_id, origin, a, row_number() OVER (PARTITION BY session_id, origin ORDER BY a) - 1 AS k, avg(x) AS m1, avg(x * x) AS m2 FROM f GROUP BY session_id, origin, a),
r AS (SELECT session_id, origin, a, k, 0.01::DOUBLE * m1 AS mu, 0.99::DOUBLE + 0.01::DOUBLE * (m2 - 2 * (0.01::DOUBLE * m1) * m1 + (0.01::DOUBLE * m1) ** 2) AS v FROM c WHERE k = 0
      UNION ALL
      SELECT q.session_id, q.origin, q.a, q.k, q.mu, 0.99::DOUBLE * q.v + 0.01::DOUBLE * (q.m2 - 2 * q.mu * q.m1 + q.mu ** 2)
      FROM (SELECT c.session_id, c.origin, c.a, c.k, c.m1, c.m2, 0.99::DOUBLE * r.mu + 0.01::DOUBLE * c.m1 AS mu, r.v
            FROM r JOIN c ON c.session_id = r.session_id AND c.origin = r.origin AND c.k = r.k + 1) q)
SELECT f.session_id, f.sample, round((f.x - r.mu) / (sqrt(r.v) + 1e-6::DOUBLE), 4) + 0.0 AS y
FROM f JOIN r ON r.session_id = f.session_id AND r.origin = f.origin AND r.a = f.a""",
)
def ema_normalize_gaps(spark, sf):
    """Mean and variance start anew behind each gap; a block row of 16 samples is a chunk."""
    return long(fl.ema_normalize(lossy(spark, sf), on_gap="reset")).withColumn("y", F.round("y", 4) + 0.0)


@query("preprocess_streaming")
def preprocess_streaming(spark, sf):
    return long(fl.preprocess_streaming(whole(spark, sf), gated=True)).withColumn("y", F.round("y", 4) + 0.0)


@query("bandpass_zero_phase")
def bandpass_zero_phase(spark, sf):
    spans = px.px_spans(spark, sf)
    wide = spans.withColumn("start_sample", F.greatest(F.col("start_sample") - 30, F.lit(0))).withColumn("end_sample", F.col("end_sample") + 30)
    cut = bl.cut_events(recorded(spark, sf), wide, BLOCK).withColumn("mode", F.lit("standard")).withColumn("fs_hz", F.lit(FS))
    out = fl.bandpass_zero_phase(cut)
    return out.select("session_id", "event_id", "label", "n_frames", "reject", F.transform("samples", lambda v: F.round(v, 4)).alias("y"))


# Welch on segments of n // 4 samples (n < 1024) written as sums of cosines and sines.
WELCH_SQL = f"""{S}, f AS (SELECT session_id, sample, x::FLOAT::DOUBLE AS x FROM px_signal),
n AS (SELECT session_id, least(256, count(*) // 4) AS p, count(*) AS n FROM f GROUP BY session_id HAVING count(*) // 4 >= 4),
g AS (SELECT session_id, p, unnest(range(0, n - p + 1, p - p // 2)) AS a FROM n),
w AS (SELECT g.session_id, g.p, g.a, f.sample - g.a AS i, f.x - avg(f.x) OVER (PARTITION BY g.session_id, g.a) AS x,
             0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (f.sample - g.a) / g.p) AS h
      FROM g JOIN f ON f.session_id = g.session_id AND f.sample >= g.a AND f.sample < g.a + g.p),
t AS (SELECT session_id, p, a, k, sum(x * h * cos(2 * pi() * k * i / p)) AS re, sum(x * h * sin(2 * pi() * k * i / p)) AS im, sum(h * h) AS hh
      FROM w, range(0, 33) b(k) WHERE k <= p // 2 GROUP BY ALL),
d AS (SELECT session_id, p, k, avg((re * re + im * im) / (250.0::DOUBLE * hh)) * CASE WHEN k = 0 OR (p % 2 = 0 AND k = p // 2) THEN 1 ELSE 2 END AS psd FROM t GROUP BY session_id, p, k),
b AS (SELECT session_id, avg(psd) FILTER (k * 250.0::DOUBLE / p BETWEEN 30 AND 100) AS s, avg(psd) FILTER (k * 250.0::DOUBLE / p BETWEEN 0.5 AND 30) AS z FROM d GROUP BY session_id)
"""


@query("welch_snr", f"WITH {WELCH_SQL} SELECT session_id, CAST(0 AS BIGINT) AS channel, round(10 * log10(greatest(s / greatest(z, 1e-12), 1e-12)), 4) AS snr_db FROM b")
def welch_snr(spark, sf):
    blocks = whole(spark, sf).withColumn("low_hz", F.lit(30.0)).withColumn("high_hz", F.lit(100.0))
    lengths = px.table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n_samples"))
    out = ql.welch_snr(blocks, lengths, (0.5, 30.0))
    return out.select("session_id", F.col("channel").cast("long").alias("channel"), F.round("snr_db", 4).alias("snr_db"))


@query(
    "quality_report",
    f"""WITH RECURSIVE {WELCH_SQL}, {_recurrence(low_filter(4, 5.0, FS), False).replace("f AS (SELECT session_id, sample, x::FLOAT::DOUBLE AS x FROM px_signal),", "", 1)},
m AS (SELECT session_id, sqrt(avg(y * y)) AS wander, sqrt(avg(x * x)) AS power FROM y GROUP BY session_id),
q AS (SELECT m.*, least(1.0, wander / (power + 1e-6::DOUBLE)) AS motion, 10 * log10(s / greatest(z, 1e-12)) AS snr FROM m LEFT JOIN b USING (session_id))
SELECT session_id, round(snr, 4) AS snr_db, round(motion, 6) AS motion_index, round(wander, 5) AS baseline_wander, round(power, 5) AS signal_power,
       round(coalesce(power * 10 ** (-snr / 10), 0.0), 3) AS noise_power, CAST((coalesce(snr < 10, false))::INT + (motion > 0.3)::INT AS BIGINT) AS n_notes FROM q""",
)
def quality_report(spark, sf):
    blocks = whole(spark, sf).withColumn("low_hz", F.lit(30.0)).withColumn("high_hz", F.lit(100.0))
    lengths = px.table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n_samples"))
    out = ql.quality_sessions(blocks, lengths, (0.5, 30.0))
    digits = {"snr_db": 4, "motion_index": 6, "baseline_wander": 5, "signal_power": 5, "noise_power": 3}
    return out.select("session_id", *[F.round(c, d).alias(c) for c, d in digits.items()], F.size("notes").cast("long").alias("n_notes"))
