"""Queries over labels, sessions and text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from subvox.catalog.registry import query
from subvox.functions import arrays, text
from subvox.operators import events as ev
from subvox.operators import sessions as ss
from subvox.plans import proxies as px

K = arrays.microvolts_per_count()
K_SQL = f"CAST('{K!r}' AS DOUBLE)"

MARKERS_SQL = f"""WITH {px.PX_SIGNAL_SQL}
SELECT session_id, 'point' AS layout, sample AS start_sample, sample + 30 AS end_sample, label FROM px_signal
UNION ALL
SELECT session_id, 'time', CAST(trunc(x * 250.0) AS BIGINT), CAST(trunc(x * 250.0) AS BIGINT) + 30, label FROM px_signal
UNION ALL
SELECT session_id, 'seconds', CAST(trunc(x * 250.0) AS BIGINT), CAST(trunc((x * 2 - 20.0) * 250.0) AS BIGINT), label
FROM px_signal WHERE CAST(trunc((x * 2 - 20.0) * 250.0) AS BIGINT) > CAST(trunc(x * 250.0) AS BIGINT)
UNION ALL
SELECT session_id, 'span', sample, CAST(trunc(x) AS BIGINT), label FROM px_signal WHERE CAST(trunc(x) AS BIGINT) > sample"""


@query("normalize_markers", MARKERS_SQL)
def normalize_markers(spark, sf):
    s = px.px_signal(spark, sf)
    layouts = {
        "point": s.select("session_id", "label", "sample"),
        "time": s.select("session_id", "label", F.col("x").alias("time_s")),
        "seconds": s.select("session_id", "label", F.col("x").alias("start_s"), (F.col("x") * 2 - 20.0).alias("end_s")),
        "span": s.select("session_id", "label", F.col("sample").alias("start_sample"), F.col("x").alias("end_sample")),
    }
    parts = [ev.normalize_markers(df, 250.0).withColumn("layout", F.lit(name)) for name, df in layouts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "sanitize_trial_events",
    f"""WITH {px.PX_TRIALS_SQL}
SELECT trial_id, CASE WHEN word_idx % 3 = 0 THEN 0 ELSE word_idx END AS word_idx, label, count(*) AS n
FROM px_trials WHERE label <> 'Brand#7' GROUP BY ALL""",
)
def sanitize_trial_events(spark, sf):
    t = px.px_trials(spark, sf)
    dirty = t.select(
        F.when(F.col("label") != "Brand#7", F.col("trial_id").cast("double")).alias("trial_id"),
        F.when(F.col("word_idx") % 3 != 0, F.col("word_idx").cast("double")).alias("word_idx"),
        "label",
    )
    return ev.sanitize_trial_events(dirty).groupBy("trial_id", "word_idx", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_events",
    f"""WITH {px.PX_TRIALS_SQL}
SELECT trial_id, word_idx, label FROM px_trials WHERE label IN ('Brand#1', 'Brand#2', 'Brand#3') AND word_idx = 1""",
)
def filter_events(spark, sf):
    return ev.filter_events(px.px_trials(spark, sf), ["Brand#1", "Brand#2", "Brand#3"], 1).select("trial_id", "word_idx", "label")


@query(
    "restrict_to_keys",
    f"""WITH {px.PX_TRIALS_SQL}
SELECT trial_id, word_idx, label FROM px_trials
WHERE trial_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000)""",
)
def restrict_to_keys(spark, sf):
    keys = px.table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_totalprice > 250000")
    return ev.restrict_to_keys(px.px_trials(spark, sf), keys.select(F.col("o_orderkey").alias("trial_id")), ["trial_id"]).select(
        "trial_id", "word_idx", "label"
    )


@query(
    "slug",
    r"""SELECT doc_id, left(CASE WHEN s = '' THEN 'unknown' ELSE s END, 48) AS slug FROM (
  SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)""",
)
def slug(spark, sf):
    return px.table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(
    "word_scalars",
    r"""SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1] AS first_word,
  replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '_', '-') AS normalized
FROM documents""",
)
def word_scalars(spark, sf):
    d = px.table(spark, sf, "documents")
    return d.select("doc_id", text.first_word(F.col("text")).alias("first_word"), text.normalize_word(F.col("text")).alias("normalized"))


@query(
    "quantize_counts",
    f"""WITH q AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice,
         CAST(greatest(least(round_even((l_extendedprice - 50000) / {K_SQL}, 0), 32767), -32768) AS BIGINT) AS counts FROM lineitem)
SELECT l_orderkey, l_linenumber, counts, round(counts * {K_SQL}, 2) AS microvolts, count(*) AS n FROM q GROUP BY ALL""",
)
def quantize_counts(spark, sf):
    li = px.table(spark, sf, "lineitem")
    q = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), arrays.quantize_value(F.col("l_extendedprice") - 50000).alias("counts"))
    q = q.withColumn("microvolts", F.round(F.col("counts") * F.lit(K), 2))
    return q.groupBy("l_orderkey", "l_linenumber", "counts", "microvolts").agg(F.count(F.lit(1)).alias("n"))


@query(
    "select_channels",
    """SELECT vec_id AS frame, round(CAST(embedding[2] AS DOUBLE), 5) AS c1, round(CAST(embedding[34] AS DOUBLE), 5) AS c33, round(CAST(embedding[64] AS DOUBLE), 5) AS c63 FROM embeddings""",
)
def select_channels(spark, sf):
    f = px.px_frames(spark, sf)
    kept = f.select("frame", arrays.select_channels(F.col("x"), F.lit(64), [1, 33, 63]).alias("y"))
    return kept.select("frame", *[F.round(F.col("y")[i].cast("double"), 5).alias(n) for i, n in enumerate(["c1", "c33", "c63"])])


@query(
    "rectify",
    """SELECT vec_id AS frame, round(list_sum(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))), 4) AS total FROM embeddings""",
)
def rectify(spark, sf):
    y = arrays.rectify(F.transform("x", lambda v: v.cast("double")))
    return px.px_frames(spark, sf).select("frame", F.round(F.aggregate(y, F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


MODES_CTE = f"""{px.PX_SESSIONS_SQL},
asked AS (
  SELECT p.session_id, p.fs_hz,
         CASE WHEN p.channels = 31 THEN NULL WHEN p.channels = 7 THEN 'wide' ELSE 'bogus' END AS model_mode, p.mode AS profile_mode
  FROM px_sessions p),
resolved AS (
  SELECT *, CASE WHEN model_mode IN ('standard','clinical','wide','gowda') THEN model_mode
              WHEN profile_mode IN ('standard','clinical','wide','gowda') THEN profile_mode ELSE 'standard' END AS mode,
         coalesce(model_mode IN ('standard','clinical','wide','gowda') AND profile_mode <> model_mode, false) AS mode_conflict
  FROM asked)"""


def _asked(spark, sf):
    s = px.px_sessions(spark, sf)
    model = F.when(F.col("channels") == 7, "wide").when(F.col("channels") == 8, "bogus")
    return s.select("session_id", "fs_hz", model.alias("model_mode"), F.col("mode").alias("profile_mode"))


@query("resolve_mode", f"WITH {MODES_CTE} SELECT session_id, mode, mode_conflict FROM resolved")
def resolve_mode(spark, sf):
    return ss.resolve_mode(_asked(spark, sf)).select("session_id", "mode", "mode_conflict")


@query(
    "mode_bands",
    f"""WITH {MODES_CTE}, spec(mode, lo, hi, ord, floor_hz) AS (
  VALUES ('standard', 1.0, 50.0, 4, 0.0), ('clinical', 0.5, 8.0, 4, 0.0), ('wide', 20.0, 450.0, 4, 920.0), ('gowda', 80.0, 1000.0, 3, 2020.0))
SELECT session_id, r.mode, CAST(lo AS DOUBLE) AS low_hz, CAST(hi AS DOUBLE) AS high_hz, CAST(ord AS BIGINT) AS filter_order,
       fs_hz > floor_hz AS usable, CAST(lo AS DOUBLE) AS quality_low_hz,
       CAST(least(hi, greatest(10.0, fs_hz / 2.0 - 5.0)) AS DOUBLE) AS quality_high_hz
FROM resolved r JOIN spec s ON s.mode = r.mode""",
)
def mode_bands(spark, sf):
    banded = ss.mode_bands(ss.resolve_mode(_asked(spark, sf)))
    return banded.select("session_id", "mode", "low_hz", "high_hz", "filter_order", "usable", "quality_low_hz", "quality_high_hz")


@query(
    "validate_sessions",
    f"""WITH {px.PX_SESSIONS_SQL}, s AS (SELECT *, CASE WHEN channels = 7 THEN NULL ELSE 8 END AS montage FROM px_sessions)
SELECT session_id, 'error' AS severity, 'mode.rate_too_low' AS code FROM s
  WHERE (mode = 'wide' AND fs_hz <= 920) OR (mode = 'gowda' AND fs_hz <= 2020)
UNION ALL SELECT session_id, 'warning', 'mode.unknown' FROM s WHERE mode = 'offline'
UNION ALL SELECT session_id, 'error', 'montage.unknown' FROM s WHERE montage IS NULL
UNION ALL SELECT session_id, 'warning', 'channels.montage_mismatch' FROM s WHERE channels <> montage
UNION ALL SELECT session_id, 'error', 'signal.short' FROM s WHERE n_samples < 100
UNION ALL SELECT session_id, 'error', 'span.outside' FROM s WHERE 300000 > n_samples
UNION ALL SELECT session_id, 'warning', 'link.loss_high' FROM s WHERE snr_db / 500 > 0.05""",
)
def validate_sessions(spark, sf):
    s = px.px_sessions(spark, sf)
    s = s.withColumn("montage_channels", F.when(F.col("channels") != 7, 8).cast("long"))
    s = s.withColumn("last_end_sample", F.lit(300_000)).withColumn("loss_fraction", F.col("snr_db") / 500)
    return ss.validate_sessions(s).select("session_id", "severity", "code")


@query(
    "split_mode_of",
    """SELECT event_id, coalesce(json_extract_string(CASE WHEN event_id % 3 = 0 THEN '{"split_mode": "' || event_type || '"}'
  WHEN event_id % 3 = 1 THEN props END, '$.split_mode'), '') AS split_mode FROM events""",
)
def split_mode_of(spark, sf):
    e = px.table(spark, sf, "events")
    third = F.col("event_id") % 3
    made = F.concat(F.lit('{"split_mode": "'), "event_type", F.lit('"}'))
    meta = F.when(third == 0, made).when(third == 1, F.col("props")).otherwise(F.lit("{not json"))
    return e.select("event_id", ev.split_mode_of(meta).alias("split_mode"))


@query(
    "label_counts",
    f"""WITH {px.PX_SPANS_SQL}, c AS (SELECT session_id, label, count(*) AS n FROM px_spans GROUP BY ALL)
SELECT session_id, label, n, CASE WHEN n < 50 THEN 'label ' || label || ': ' || n || ' samples, fewer than 50' END AS warning FROM c""",
)
def label_counts(spark, sf):
    return ev.label_counts(px.px_spans(spark, sf), 50, ["session_id"])


@query(
    "top_labels",
    f"""WITH {px.PX_TRIALS_SQL}, top AS (
  SELECT label FROM px_trials GROUP BY label HAVING count(*) >= 10 ORDER BY count(*) DESC, label LIMIT 8)
SELECT trial_id, word_idx, label FROM px_trials WHERE label IN (SELECT label FROM top)""",
)
def top_labels(spark, sf):
    return ev.keep_top_labels(px.px_trials(spark, sf), 8, 10).select("trial_id", "word_idx", "label")


@query(
    "merge_sessions",
    f"""WITH {px.PX_SPANS_SQL},
a AS (SELECT event_id AS trial_id, session_id, start_sample, end_sample, label FROM px_spans WHERE label IN ('click', 'view')),
b AS (SELECT event_id AS trial_id, session_id, start_sample, end_sample, label FROM px_spans WHERE label NOT IN ('click', 'view'))
SELECT 'first' AS part, session_id, trial_id, start_sample, end_sample, label, 'sim_transfer_merged' AS split_mode FROM a
UNION ALL
SELECT 'second', session_id, trial_id + (SELECT max(trial_id) + 1 FROM a), start_sample + 4000, end_sample + 4000, label,
       'sim_transfer_merged' FROM b""",
)
def merge_sessions(spark, sf):
    spans = px.px_spans(spark, sf).withColumnRenamed("event_id", "trial_id")
    first = spans.where(F.col("label").isin("click", "view"))
    return ev.merge_sessions(first, spans.where(~F.col("label").isin("click", "view")), 4000)
