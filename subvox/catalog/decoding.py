"""Queries over classification, gates, utterances and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from subvox.catalog.registry import query
from subvox.catalog.speech import LETTERS_SQL, letters
from subvox.functions.fixed import LM_WEIGHTS, PHONES
from subvox.operators import classify as cl
from subvox.operators import decode as dc
from subvox.operators import lm as lmod
from subvox.operators import monitor as mon
from subvox.plans import proxies as px
from subvox.plans.ordered import running_sum
from subvox.session import cut_lineage

LABELS = [f"w{i}" for i in range(64)]


@query(
    "score_probabilities",
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: exp(4 * v::DOUBLE)) AS e FROM embeddings),
q AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM p),
s AS (SELECT vec_id, p, list_max(p) AS conf, list_position(p, list_max(p)) AS place, list_reverse_sort(p) AS r,
             list_sum(list_transform(p, lambda v: (0 - greatest(v, 1e-12::DOUBLE)) * ln(greatest(v, 1e-12::DOUBLE)))) / ln(64) AS h FROM q)
SELECT vec_id AS frame, 'w' || (place - 1) AS token, round(conf, 6) AS confidence, round(h, 6) AS entropy, round(r[1] - r[2], 6) AS margin,
       (h > 0.97::DOUBLE OR r[1] - r[2] < 0.002::DOUBLE) AS abstain FROM s""",
)
def score_probabilities(spark, sf):
    from subvox.functions.arrays import once

    f = px.px_frames(spark, sf)
    f = once(f, e=F.transform("x", lambda v: F.exp(4 * v.cast("double"))))
    f = once(f, total=F.aggregate("e", F.lit(0.0), lambda s, v: s + v))
    f = once(f, probs=F.transform("e", lambda v: v / F.col("total")))
    s = cl.score_probabilities(f, LABELS, entropy_max=0.97, margin_min=0.002)
    return s.select("frame", "token", *[F.round(c, 6).alias(c) for c in ("confidence", "entropy", "margin")], "abstain")


@query(
    "confidence_threshold",
    f"""WITH {px.PX_PRED_SQL}, t AS (SELECT trial_id % 50 AS user_id, avg(conf) FILTER (ref = hyp) AS m, stddev_pop(conf) FILTER (ref = hyp) AS s,
  count(*) FILTER (ref = hyp) AS n FROM px_pred GROUP BY ALL)
SELECT user_id, round(coalesce(greatest(0.5::DOUBLE, least(0.95::DOUBLE, m - 2 * s)), 0.7::DOUBLE), 6) AS threshold, n AS n_correct FROM t""",
)
def confidence_threshold(spark, sf):
    p = px.px_pred(spark, sf).withColumn("user_id", F.col("trial_id") % 50)
    return cl.confidence_threshold(p, ["user_id"]).withColumn("threshold", F.round("threshold", 6))


@query(
    "nearest_centroid",
    """WITH v AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, k, avg(x) AS m FROM v GROUP BY ALL),
d AS (SELECT vec_id, v.label, c.label AS guess, sqrt(sum((x - m) * (x - m))) AS d FROM v JOIN c USING (k) GROUP BY ALL)
SELECT vec_id AS frame, arg_min(guess, d) AS hyp, round(1 / sum(exp(lo - d)), 6) AS conf FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS lo FROM d) GROUP BY vec_id""",
)
def nearest_centroid(spark, sf):
    rows = px.px_frames(spark, sf).withColumnRenamed("phone", "label")
    out = cl.nearest_centroid(rows, cl.fit_centroids(rows))
    return out.select("frame", "hyp", F.round("conf", 6).alias("conf"))


@query("train_and_score")
def train_and_score(spark, sf):
    rows = px.px_frames(spark, sf).select("frame", F.concat(F.lit("p"), F.col("phone").cast("string")).alias("label"), F.col("x").alias("features"))
    from subvox.operators.splits import split_stratified

    split = cut_lineage(split_stratified(rows, ["frame"], 0.2, 1337))
    model = cl.train_word_classifier(split.where("split = 'train'"))
    scored = cl.score_windows(model, split, margin_min=0.05)
    hit = (F.col("token") == F.col("label")).cast("double")
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 2).alias("accuracy"))


@query(
    "channel_importance",
    f"""WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: x::DOUBLE) AS x, md5('0:' || vec_id) AS draw FROM embeddings),
b AS (SELECT *, ('0x' || substr(draw, 1, 12))::BIGINT % greatest(1, (SELECT count(*) FROM embeddings) // {cl.BUCKET_ROWS}) AS bucket FROM e),
p AS (SELECT *, coalesce(lead(x) OVER line, first_value(x) OVER line) AS y FROM b WINDOW line AS (PARTITION BY bucket ORDER BY draw)),
v AS (SELECT vec_id, label, unnest(range(0, 64)) AS k, unnest(x) AS x, unnest(y) AS y FROM p),
c AS (SELECT label AS guess, k, avg(x) AS m FROM v GROUP BY ALL),
d AS (SELECT vec_id, guess, sum((x - m) * (x - m)) AS d FROM v JOIN c USING (k) GROUP BY ALL),
n AS (SELECT vec_id, label, k, guess, d - (x - m) * (x - m) + (y - m) * (y - m) AS d FROM v JOIN c USING (k) JOIN d USING (vec_id, guess)),
a AS (SELECT k, avg((hyp = label)::INT) AS acc FROM (SELECT vec_id, label, k, arg_min(guess, d) AS hyp FROM n GROUP BY ALL) GROUP BY k),
w AS (SELECT avg((hyp = label)::INT) AS whole FROM (SELECT vec_id, arg_min(guess, d) AS hyp FROM d GROUP BY ALL) JOIN e USING (vec_id)),
l AS (SELECT k, greatest(whole - acc, 0) AS loss, max(greatest(whole - acc, 0)) OVER () AS top FROM a, w)
SELECT CAST(k AS INTEGER) AS channel, round(loss, 6) AS drop, round(CASE WHEN top > 1e-12 THEN loss / top ELSE 0 END, 6) AS importance
FROM l ORDER BY loss DESC, k LIMIT 16""",
)
def channel_importance(spark, sf):
    rows = px.px_frames(spark, sf).withColumnRenamed("phone", "label")
    top = cl.channel_importance(rows, cl.fit_centroids(rows), 64, k=16)
    return top.select("channel", F.round("drop", 6).alias("drop"), F.round("importance", 6).alias("importance"))


SWEEP_SQL = f"""{px.PX_SPANS_SQL}, e AS (SELECT session_id, event_id, label, start_sample * 20 AS a, end_sample * 20 AS b, n * 20 AS n
  FROM px_spans JOIN (SELECT session_id, count(*) AS n FROM px_signal GROUP BY session_id) USING (session_id)),
w AS (SELECT e.*, window_ms, greatest(1, CAST(trunc(250 * window_ms / 1000.0) AS BIGINT)) AS win FROM e, (VALUES (400), (600), (900), (1200), (1500)) t(window_ms)),
c AS (SELECT *, CASE WHEN b - a < 12 THEN least(n, greatest(0, (a + b) // 2 - win // 2) + win) ELSE least(n, b) END AS cut_end FROM w),
s AS (SELECT *, greatest(0, cut_end - win) AS cut_start FROM c)"""


def _sweep(spark, sf):
    signal = px.table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg((F.count(F.lit(1)) * 20).alias("n_samples"))
    spans = px.px_spans(spark, sf).join(signal, "session_id")
    spans = spans.withColumn("start_sample", F.col("start_sample") * 20).withColumn("end_sample", F.col("end_sample") * 20)
    return cl.sweep_bounds(spans, [400, 600, 900, 1200, 1500], 250)


@query(
    "sweep_bounds",
    f"""WITH {SWEEP_SQL} SELECT session_id, event_id, CAST(window_ms AS BIGINT) AS window_ms, CAST(cut_start AS BIGINT) AS cut_start,
  CAST(cut_end AS BIGINT) AS cut_end, CAST(win - (cut_end - cut_start) AS BIGINT) AS pad FROM s WHERE cut_end - cut_start >= greatest(4, win // 4)""",
)
def sweep_bounds(spark, sf):
    return _sweep(spark, sf).select("session_id", "event_id", F.col("window_ms").cast("long").alias("window_ms"), "cut_start", "cut_end", "pad")


@query(
    "sweep_choice",
    f"""WITH {SWEEP_SQL}, k AS (SELECT window_ms, avg(CASE WHEN label IN ('click', 'view') AND pad = 0 THEN 1.0::DOUBLE WHEN pad > 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END) AS accuracy,
  window_ms * 0.3::DOUBLE AS latency_p95_ms FROM (SELECT *, win - (cut_end - cut_start) AS pad FROM s WHERE cut_end - cut_start >= greatest(4, win // 4)) GROUP BY window_ms)
SELECT CAST(window_ms AS BIGINT) AS window_ms, round(accuracy, 6) AS accuracy, round(accuracy - latency_p95_ms / 2000, 6) AS score,
       latency_p95_ms <= 400 AS allowed,
       row_number() OVER (ORDER BY CASE WHEN latency_p95_ms <= 400 THEN 0 ELSE 1 END, accuracy - latency_p95_ms / 2000 DESC, window_ms) = 1 AS recommended FROM k""",
)
def sweep_choice(spark, sf):
    hit = F.when(F.col("label").isin("click", "view") & (F.col("pad") == 0), 1.0).when(F.col("pad") > 0, 0.25).otherwise(0.5)
    rows = _sweep(spark, sf).groupBy(F.col("window_ms").cast("long").alias("window_ms")).agg(F.avg(hit).alias("accuracy"))
    rows = rows.withColumn("latency_p95_ms", F.col("window_ms") * F.lit(0.3))
    out = cl.sweep_choice(rows, target_p95_ms=400)
    return out.select("window_ms", F.round("accuracy", 6).alias("accuracy"), F.round("score", 6).alias("score"), "allowed", "recommended")


@query(
    "calibrate",
    f"""WITH {px.PX_PRED_SQL}, p AS (SELECT *, trial_id % 50 AS user_id FROM px_pred),
c AS (SELECT user_id, ref, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS calibration_samples, count(*) AS n_tokens, count(*) FILTER (n < 50) AS low FROM c GROUP BY user_id),
s AS (SELECT user_id, avg(conf) FILTER (ref = hyp) AS m, stddev_pop(conf) FILTER (ref = hyp) AS d, avg(CASE WHEN ref = hyp THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM p GROUP BY user_id),
q AS (SELECT c_custkey AS user_id, c_acctbal / 500 AS snr, abs(c_acctbal) / 20000 AS motion FROM customer)
SELECT t.user_id, round(greatest(0.5::DOUBLE, least(0.95::DOUBLE, m - 2 * d)), 6) AS confidence_threshold, round(snr, 5) AS baseline_snr, round(acc, 6) AS val_accuracy,
       calibration_samples, n_tokens, CAST((low > 0)::INT + (motion > 0.3)::INT AS BIGINT) AS n_warnings, motion > 0.35 AS rejected
FROM t JOIN s USING (user_id) JOIN q USING (user_id)""",
)
def calibrate(spark, sf):
    p = px.px_pred(spark, sf).withColumn("user_id", F.col("trial_id") % 50)
    counts = p.groupBy("user_id", F.col("ref").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    quality = px.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 500).alias("snr_db"), (F.abs("c_acctbal") / 20000).alias("motion_index")
    )
    out = cl.calibrate(quality, counts, p, strict=True)
    return out.select(
        "user_id", F.round("confidence_threshold", 6).alias("confidence_threshold"), F.round("baseline_snr", 5).alias("baseline_snr"),
        F.round("val_accuracy", 6).alias("val_accuracy"), "calibration_samples", "n_tokens", F.size("warnings").cast("long").alias("n_warnings"), "rejected",
    )


@query(
    "compare_configs",
    f"""WITH {px.PX_PRED_SQL}, r AS (SELECT 'slot' || least(word_idx, 5) AS config, avg(CASE WHEN ref = hyp THEN 1.0::DOUBLE ELSE 0 END) AS a, count(*) AS n FROM px_pred GROUP BY ALL)
SELECT config, round(a, 6) AS val_accuracy, n, row_number() OVER (ORDER BY a DESC, config) = 1 AS best FROM r""",
)
def compare_configs(spark, sf):
    hit = (F.col("ref") == F.col("hyp")).cast("double")
    name = F.concat(F.lit("slot"), F.least(F.col("word_idx"), F.lit(5)).cast("string"))
    r = px.px_pred(spark, sf).groupBy(name.alias("config")).agg(F.avg(hit).alias("val_accuracy"), F.count(F.lit(1)).alias("n"))
    return cl.compare_configs(r).withColumn("val_accuracy", F.round("val_accuracy", 6))


PREDS_SQL = f"{px.PX_SIGNAL_SQL}, p AS (SELECT session_id, sample AS step, label AS token, least(1.0::DOUBLE, 0.6::DOUBLE + x / 100) AS confidence, x < 1.0 AS abstain FROM px_signal)"


def predictions(spark, sf):
    s = px.px_signal(spark, sf)
    return s.select(
        "session_id", F.col("sample").alias("step"), (px.micros("ts") / 1e6).alias("t"), F.col("label").alias("token"),
        F.least(F.lit(1.0), F.lit(0.6) + F.col("x") / 100).alias("confidence"), F.lit(None).cast("double").alias("snr_db"), (F.col("x") < 1.0).alias("abstain"),
    )


@query(
    "stable_runs",
    f"""WITH {PREDS_SQL}, i AS (SELECT *, sum(abstain::INT) OVER (PARTITION BY session_id ORDER BY step) AS isle FROM p),
w AS (SELECT *, lag(token) OVER x AS t1, row_number() OVER x AS r, avg(confidence) OVER (PARTITION BY session_id, isle ORDER BY step ROWS 1 PRECEDING) AS m
      FROM i WHERE NOT abstain WINDOW x AS (PARTITION BY session_id, isle ORDER BY step))
SELECT session_id, step, token, round(m, 6) AS mean_confidence FROM w WHERE r >= 2 AND t1 = token AND m >= 0.8::DOUBLE""",
)
def stable_runs(spark, sf):
    out = mon.stable_runs(predictions(spark, sf), 2, 0.8)
    return out.select("session_id", "step", "token", F.round("mean_confidence", 6).alias("mean_confidence"))


@query("stabilize_tokens")
def stabilize_tokens(spark, sf):
    cfg = mon.GateConfig(stable_n=2, min_confidence=0.8, cooldown_ms=36e5, adaptive=True)
    out = mon.stabilize_tokens(predictions(spark, sf), cfg)
    return out.select("session_id", "step", "token", F.round("confidence", 6).alias("confidence"), F.round("gate", 6).alias("gate"))


@query(
    "low_streaks",
    f"""WITH {px.PX_QUALITY_SQL}, r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq, snr_db FROM px_quality WHERE snr_db IS NOT NULL),
f AS (SELECT *, 20.0 - snr_db >= 3 AS low FROM r), g AS (SELECT *, sum((NOT low)::INT) OVER (PARTITION BY session_id ORDER BY seq) AS grp FROM f),
s AS (SELECT session_id, seq, CASE WHEN low THEN count(*) FILTER (low) OVER (PARTITION BY session_id, grp ORDER BY seq) ELSE 0 END AS low_streak FROM g)
SELECT session_id, seq, low_streak, low_streak >= 3 AS suggested FROM s""",
)
def low_streaks(spark, sf):
    q = px.px_quality(spark, sf)
    nth = running_sum(q, ["session_id"], "seq", {"nth": F.col("snr_db").isNotNull().cast("long")}, chunk=65_536)
    readings = nth.where("snr_db IS NOT NULL").select("session_id", (F.col("nth") - 1).alias("seq"), "snr_db")
    return mon.low_streaks(readings, F.lit(20.0) - F.col("snr_db")).select("session_id", "seq", "low_streak", "suggested")


@query(
    "recalibration_monitor",
    f"""WITH RECURSIVE {px.PX_QUALITY_SQL}, r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq, snr_db FROM px_quality WHERE snr_db IS NOT NULL),
e AS (SELECT session_id, seq, snr_db AS ema, CASE WHEN 20.0::DOUBLE - snr_db >= 3 THEN 1 ELSE 0 END AS streak FROM r WHERE seq = 0
      UNION ALL SELECT session_id, seq, ema, CASE WHEN 20.0::DOUBLE - ema >= 3 THEN streak + 1 ELSE 0 END FROM (
        SELECT r.session_id, r.seq, 0.85::DOUBLE * e.ema + 0.15::DOUBLE * r.snr_db AS ema, e.streak FROM e JOIN r ON r.session_id = e.session_id AND r.seq = e.seq + 1))
SELECT session_id, seq, ema AS snr_ema, greatest(0.0::DOUBLE, 20.0::DOUBLE - ema) AS snr_deficit_db, CAST(streak AS BIGINT) AS low_streak, streak >= 3 AS suggested FROM e""",
)
def recalibration_monitor(spark, sf):
    q = px.px_quality(spark, sf)
    nth = running_sum(q, ["session_id"], "seq", {"nth": F.col("snr_db").isNotNull().cast("long")}, chunk=65_536)
    readings = nth.where("snr_db IS NOT NULL").select(
        "session_id", (F.col("nth") - 1).alias("seq"), F.col("nth").cast("double").alias("t"), "snr_db", F.lit(0.0).alias("motion_index"), F.lit(20.0).alias("baseline")
    )
    out = mon.recalibration_monitor(readings)
    return out.select("session_id", "seq", "snr_ema", "snr_deficit_db", "low_streak", "suggested")


@query(
    "session_recal_check",
    f"""WITH {px.PX_SESSIONS_SQL} SELECT session_id, round(greatest(baseline - snr_db, 0.0), 7) AS snr_deficit_db, snr_db < baseline - 3 AS suggested,
  CAST((greatest(baseline - snr_db, 0.0) >= 3)::INT + (snr_db / 50 >= 0.4)::INT AS BIGINT) AS n_reasons FROM px_sessions""",
)
def session_recal_check(spark, sf):
    s = px.px_sessions(spark, sf).withColumn("motion_index", F.col("snr_db") / 50)
    out = mon.session_recal_check(s)
    return out.select("session_id", F.round("snr_deficit_db", 7).alias("snr_deficit_db"), "suggested", F.size("reasons").cast("long").alias("n_reasons"))


@query(
    "throttle",
    f"""WITH RECURSIVE {px.PX_SIGNAL_SQL}, e AS (SELECT session_id, sample, epoch_us(ts) AS t FROM px_signal),
p AS (SELECT session_id, min(t) AS t FROM e GROUP BY session_id
      UNION ALL SELECT session_id, nxt FROM (SELECT p.session_id, (SELECT min(e.t) FROM e WHERE e.session_id = p.session_id AND e.t >= p.t + 86400000000) AS nxt FROM p) WHERE nxt IS NOT NULL)
SELECT session_id, t / 1000000.0::DOUBLE AS t FROM p""",
)
def throttle(spark, sf):
    e = px.px_signal(spark, sf).select("session_id", (px.micros("ts") / 1e6).alias("t"))
    return mon.throttle(e, ["session_id"], 86_400.0)


@query(
    "ptt_utterances",
    f"""WITH {px.PX_SIGNAL_SQL}, c AS (SELECT session_id, sample AS seq, CASE WHEN label = 'signup' THEN 'start' WHEN label = 'error' THEN 'end' END AS cmd FROM px_signal),
s AS (SELECT *, last_value(cmd IGNORE NULLS) OVER w AS st, sum(CASE WHEN cmd = 'start' THEN 1 ELSE 0 END) OVER w AS u FROM c WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
d AS (SELECT DISTINCT session_id, u FROM s WHERE cmd = 'end'),
k AS (SELECT session_id, u, seq FROM s WHERE st = 'start' UNION ALL
      SELECT h.session_id, h.u, c.seq FROM s h JOIN c ON c.session_id = h.session_id AND c.seq < h.seq AND c.seq >= h.seq - 8 WHERE h.cmd = 'start'),
m AS (SELECT k.*, row_number() OVER (PARTITION BY k.session_id, k.u ORDER BY seq) * 10 AS upto, count(*) OVER (PARTITION BY k.session_id, k.u) * 10 AS total FROM k JOIN d USING (session_id, u))
SELECT session_id, CAST(u AS BIGINT) AS utterance, seq, CAST(least(10, 125 - (upto - 10)) AS BIGINT) AS keep_frames FROM m WHERE total >= 50 AND upto - 10 < 125""",
)
def ptt_utterances(spark, sf):
    s = px.px_signal(spark, sf).select("session_id", F.col("sample").alias("seq"), "label")
    chunks = s.select("session_id", "seq", F.lit(10).cast("long").alias("n_frames"))
    cmd = F.when(F.col("label") == "signup", "start").when(F.col("label") == "error", "end")
    controls = s.select("session_id", "seq", cmd.alias("cmd"), F.col("seq").alias("at")).where("cmd IS NOT NULL")
    return mon.ptt_utterances(chunks, controls, 250.0, max_ms=500.0)


FRAMES_SQL = """z AS (SELECT vec_id, list_transform(range(1, 41), lambda i: greatest(embedding[i], embedding[i + 40])) AS z FROM embeddings),
f AS (SELECT vec_id // 10 AS utt_id, vec_id % 10 AS frame, list_position(z, list_max(z)) - 1 AS cls FROM z)"""


def posteriors(spark, sf):
    """Frames of ten-frame utterances, four utterances to a trial; the numbers are class scores, where those past the last class are more of the first."""
    from subvox.functions.arrays import once

    n = len(PHONES)
    f = px.px_frames(spark, sf)
    f = once(f, z=F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.greatest(F.get("x", i), F.get("x", i + n)).cast("double") * 8))
    f = once(f, total=F.log(F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v))))
    utt = F.floor(F.col("frame") / 10)
    return f.select(
        utt.alias("utt_id"), F.floor(utt / 4).alias("trial_id"), (utt % 4).alias("slot"), (F.col("frame") % 10).alias("frame"),
        F.transform("z", lambda v: v - F.col("total")).alias("logp"),
    )


@query(
    "greedy_collapse",
    f"""WITH {FRAMES_SQL}, g AS (SELECT *, lag(cls) OVER (PARTITION BY utt_id ORDER BY frame) AS prev FROM f),
names AS (SELECT unnest(range(0, 40)) AS cls, unnest([{", ".join(f"'{p}'" for p in PHONES)}]) AS phone)
SELECT u.utt_id, coalesce(string_agg(phone, ' ' ORDER BY frame), '') AS phones FROM (SELECT DISTINCT utt_id FROM f) u
LEFT JOIN (SELECT g.utt_id, g.frame, n.phone FROM g JOIN names n USING (cls) WHERE g.cls > 0 AND (g.prev IS NULL OR g.prev <> g.cls)) k ON k.utt_id = u.utt_id GROUP BY u.utt_id""",
)
def greedy_collapse(spark, sf):
    out = dc.greedy_collapse(posteriors(spark, sf).select("utt_id", "frame", "logp"))
    return out.select("utt_id", F.array_join("phones", " ").alias("phones"))


def decoding(spark, sf):
    """Utterance rows, the words said in them, the lexicon and a model of the trials."""
    utts = dc.utterance_rows(posteriors(spark, sf), carry=["trial_id", "slot"])
    lexicon = letters(spark, sf).where(F.size("phones") > 0)
    parts = px.table(spark, sf, "part")
    # Part keys run from 1 on; utterances past the last one begin anew.
    said = (F.col("utt_id") % parts.agg(F.count(F.lit(1))).scalar() + 1).alias("_said")
    words = parts.select(F.col("p_partkey").alias("_said"), F.lower("p_type").alias("ref"))
    refs = utts.select("utt_id", "trial_id", "slot", said).join(words, "_said").drop("_said")
    trials = refs.select("trial_id", F.col("slot").alias("word_idx"), F.col("ref").alias("label"))
    return utts, refs, lexicon, lmod.fit_trial_lm(trials, max_trial=1 << 40, date_slots=False).saved()


def _scores(spark, sf):
    utts, refs, lexicon, model = decoding(spark, sf)
    scores = dc.lexicon_scores(utts, model, lexicon)
    return cut_lineage(scores.join(utts.select("utt_id", "trial_id"), "utt_id")), refs, model


def _smooth_sql(counts: str, context: str) -> str:
    over = f"OVER (PARTITION BY {context})"
    return f"SELECT *, ln((n + 0.1::DOUBLE) / (sum(n) {over} + 0.1::DOUBLE * count(*) {over})) AS logp, count(*) {over} AS v FROM {counts}"


#: Best paths frame by frame: ``a[i]`` is the best score that ends in state ``i`` of blank, phone, blank, phone, ..., blank.
SCORES_SQL = f"""{LETTERS_SQL}, lex AS (SELECT word, phones FROM letters WHERE len(phones) > 0), {FRAMES_SQL},
lp AS (SELECT vec_id // 10 AS utt_id, vec_id % 10 AS frame,
              list_transform(z, lambda v: 8 * v::DOUBLE - ln(list_sum(list_transform(z, lambda u: exp(8 * u::DOUBLE))))) AS lp FROM z),
utts AS (SELECT utt_id, utt_id // 4 AS trial_id, utt_id % 4 AS slot, list(lp ORDER BY frame) AS lps, count(*) AS frames FROM lp GROUP BY utt_id),
refs AS (SELECT utt_id, trial_id, slot, lower(p_type) AS ref FROM utts JOIN part ON p_partkey = utt_id % (SELECT count(*) FROM part) + 1),
said AS (SELECT slot, ref AS word, lag(ref, 1) OVER w AS prev, lag(ref, 2) OVER w AS prev2 FROM refs WINDOW w AS (PARTITION BY trial_id ORDER BY slot)),
lm_slot AS ({_smooth_sql("(SELECT slot, word, count(*) AS n FROM said GROUP BY ALL)", "slot")}),
lm_bigram AS ({_smooth_sql("(SELECT prev, word, count(*) AS n FROM said WHERE prev IS NOT NULL GROUP BY ALL)", "prev")}),
lm_trigram AS ({_smooth_sql("(SELECT prev2, prev, word, count(*) AS n FROM said WHERE prev2 IS NOT NULL GROUP BY ALL)", "prev2, prev")}),
known AS (SELECT slot, word, phones FROM lm_slot JOIN lex USING (word)),
cands AS (SELECT * FROM known UNION ALL SELECT slot, word, phones FROM (SELECT DISTINCT slot FROM utts WHERE slot NOT IN (SELECT slot FROM known)), lex),
coded AS (SELECT slot, word, list_transform(phones, lambda p: list_position([{", ".join(f"'{p}'" for p in PHONES)}], p) - 1) AS ids FROM cands),
states AS (SELECT slot, word, list_transform(range(0, 2 * len(ids) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ids[(i + 1) // 2] ELSE 0 END) AS tab FROM coded),
paths AS (
  SELECT utt_id, trial_id, slot, word, tab, lps, frames, 1 AS seen,
         list_transform(range(1, len(tab) + 1), lambda i: CASE WHEN i <= 2 THEN lps[1][tab[i] + 1] ELSE -1e30::DOUBLE END) AS a
  FROM utts JOIN states USING (slot)
  UNION ALL
  SELECT utt_id, trial_id, slot, word, tab, lps, frames, seen + 1,
         list_transform(range(1, len(tab) + 1), lambda i: greatest(a[i], CASE WHEN i > 1 THEN a[i - 1] END,
           CASE WHEN i > 2 AND tab[i] <> 0 AND tab[i] <> tab[i - 2] THEN a[i - 2] END) + lps[seen + 1][tab[i] + 1])
  FROM paths WHERE seen < frames),
scores AS (SELECT utt_id, trial_id, slot, word, greatest(a[len(a)], a[len(a) - 1]) AS score FROM paths WHERE seen = frames)"""


def _chosen_sql(weights) -> str:
    """CTE ``chosen``: the word of every slot given the words before it, for each weight of the model."""
    return f"""bases AS (SELECT s.*, coalesce(l.logp, ln(0.1::DOUBLE / coalesce((SELECT max(v) FROM lm_slot x WHERE x.slot = s.slot), 1))) AS base
  FROM scores s LEFT JOIN lm_slot l ON l.slot = s.slot AND l.word = s.word),
chosen AS (
  SELECT DISTINCT trial_id, w::DOUBLE AS weight, CAST(-1 AS BIGINT) AS slot, CAST(NULL AS VARCHAR) AS prev, CAST(NULL AS VARCHAR) AS hyp
  FROM scores, (SELECT unnest({list(weights)}) AS w)
  UNION ALL
  SELECT trial_id, weight, slot, before, best.w FROM (
    SELECT b.trial_id, c.weight, b.slot, c.hyp AS before, min({{
      't': 0 - (b.score + greatest(c.weight, 0) * (b.base + CASE WHEN c.hyp IS NULL THEN 0 ELSE coalesce(bi.logp, ln(0.1::DOUBLE)) END
                                                   + CASE WHEN c.prev IS NULL THEN 0 ELSE coalesce(tri.logp, ln(0.1::DOUBLE)) END)),
      's': 0 - b.score, 'w': b.word}}) AS best
    FROM chosen c JOIN bases b ON b.trial_id = c.trial_id AND b.slot = c.slot + 1
    LEFT JOIN lm_bigram bi ON bi.prev = c.hyp AND bi.word = b.word
    LEFT JOIN lm_trigram tri ON tri.prev2 = c.prev AND tri.prev = c.hyp AND tri.word = b.word
    GROUP BY b.trial_id, c.weight, b.slot, c.hyp))"""


@query(
    "lexicon_scores",
    f"""WITH RECURSIVE {SCORES_SQL} SELECT utt_id, slot, word, round(score, 4) AS score,
  CAST(row_number() OVER (PARTITION BY utt_id ORDER BY score DESC, word) AS INTEGER) AS rank FROM scores""",
)
def lexicon_scores(spark, sf):
    scores, _, _ = _scores(spark, sf)
    return scores.select("utt_id", "slot", "word", F.round("score", 4).alias("score"), "rank")


@query("decode_trials", f"WITH RECURSIVE {SCORES_SQL}, {_chosen_sql([1.0])} SELECT trial_id, slot, hyp FROM chosen WHERE slot >= 0")
def decode_trials(spark, sf):
    scores, _, model = _scores(spark, sf)
    return dc.decode_trials(scores.withColumn("weight", F.lit(1.0)), model, 4)


@query(
    "tune_lm_weight",
    f"""WITH RECURSIVE {SCORES_SQL}, {_chosen_sql(LM_WEIGHTS)},
acc AS (SELECT weight, avg((hyp = ref)::BIGINT) AS accuracy, count(*) AS n FROM chosen JOIN refs USING (trial_id, slot) GROUP BY weight)
SELECT weight, round(accuracy, 6) AS accuracy, n, row_number() OVER (ORDER BY accuracy DESC, weight) = 1 AS best FROM acc""",
)
def tune_lm_weight(spark, sf):
    scores, refs, model = _scores(spark, sf)
    return dc.tune_lm_weight(scores, refs, model, 4).select("weight", F.round("accuracy", 6).alias("accuracy"), "n", "best")
