"""Decoder gates, debouncing, recalibration and utterances: the batch twins of the live operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subvox.functions.fixed import REASON_DEFICIT, REASON_MOTION, REASON_UNKNOWN
from subvox.functions.recurrence import STATUS_FIELDS, TOKEN_FIELDS, GateConfig, Jumps, RecalConfig, Recalibration, TokenGate, spaced
from subvox.plans.joins import spread_join
from subvox.plans.machines import Stage, chunked
from subvox.plans.ordered import drop_halo, halo_window, last_known, running_sum, with_halo


#: Rows of a session that are worked on at once; longer sessions are summarised chunk by chunk (``plans/machines.py``).
CHUNK_ROWS = 65_536
#: Intervals of a throttle in one chunk.
CHUNK_INTERVALS = 1024


def stabilize_tokens(predictions: DataFrame, cfg: GateConfig = GateConfig(), chunk: int = CHUNK_ROWS) -> DataFrame:
    """Token events of each session from ``session_id, step, t, token, confidence, snr_db, abstain``.

    Chunks of a session run at the same time: mean confidence, threshold and last token before each are composed from summaries.
    """
    sid = predictions.schema["session_id"].dataType.simpleString()
    cols = predictions.select("session_id", "step", "t", "token", "confidence", "snr_db", "abstain")

    def gate(states: list) -> TokenGate:
        out = TokenGate(cfg)
        (out.mean, words, confs, _), *more = states
        out.tail = (words, confs)
        for name, state in zip(("threshold", "sent"), more):
            setattr(out, name, state)
        return out

    fresh = TokenGate(cfg)
    stages = [
        Stage((np.nan, *fresh.tail, fresh.sent[1]), lambda states, pdf: fresh.recent(pdf), fresh.after_recent),
        Stage(fresh.threshold, lambda states, pdf: gate(states).moved(pdf), lambda x, moved: moved(x)),
        Stage(fresh.sent, lambda states, pdf: gate(states).sends(pdf, states[0][3]), lambda last, jumps: jumps(last)),
    ]
    return chunked(cols, ["session_id"], "step", F.floor(F.col("step") / chunk), stages, lambda states: gate(states).events, f"session_id {sid}, {TOKEN_FIELDS}")


def stable_runs(predictions: DataFrame, n: int = 3, min_confidence: float = 0.70, chunk: int = 65_536) -> DataFrame:
    """Steps at which the last ``n`` tokens since an abstention agree with enough mean confidence.

    The gate without cooldown and adaption, all in built-in windows over bounded chunks.
    """
    keys = ["session_id"]
    isles = running_sum(predictions, keys, "step", {"isle": F.col("abstain").cast("long")}, chunk=chunk)
    near = with_halo(isles, keys, "step", chunk=chunk, before=n - 1)
    last = halo_window(keys, "step").rowsBetween(-(n - 1), 0)
    near = (
        near.withColumn("_same", (F.min("token").over(last) == F.max("token").over(last)) & (F.count("token").over(last) == n))
        .withColumn("_isle", (F.min("isle").over(last) == F.col("isle")) & (F.max(F.col("abstain").cast("int")).over(last) == 0))
        .withColumn("mean_confidence", F.avg("confidence").over(last))
    )
    return drop_halo(near).where(F.col("_same") & F.col("_isle") & (F.col("mean_confidence") >= min_confidence)).drop("_same", "_isle", "isle")


def low_streaks(quality: DataFrame, deficit: Column, warn_db: float = 3.0, streak: int = 3, chunk: int = 65_536) -> DataFrame:
    """Length of the running streak of readings at least ``warn_db`` below baseline, by position ``seq``."""
    flagged = quality.withColumn("low", deficit >= warn_db)
    broken = last_known(flagged, ["session_id"], "seq", {"_stop": F.when(~F.col("low"), F.col("seq"))}, chunk=chunk)
    length = F.when(F.col("low"), F.col("seq") - F.coalesce("_stop", F.lit(-1))).otherwise(0)
    return broken.withColumn("low_streak", length.cast("long")).withColumn("suggested", length >= streak).drop("_stop", "low")


def recalibration_monitor(readings: DataFrame, cfg: RecalConfig = RecalConfig(), chunk: int = CHUNK_ROWS) -> DataFrame:
    """Smoothed SNR, deficit, streak and broadcasts from ``session_id, seq, t, snr_db, motion_index, baseline``.

    Chunks of a session run at the same time: mean, streak and last broadcast before each are composed from summaries.
    """
    sid = readings.schema["session_id"].dataType.simpleString()
    cols = readings.select("session_id", "seq", "t", "snr_db", "motion_index", "baseline")

    def monitor(states: list) -> Recalibration:
        out = Recalibration(cfg)
        (out.mean, _), *more = states
        for name, state in zip(("streak", "sent"), more):
            setattr(out, name, state if name == "streak" else state[1])
        return out

    fresh = Recalibration(cfg)
    stages = [
        Stage((np.nan, fresh.sent), lambda states, pdf: fresh.recent(pdf), lambda state, made: (made[0](state[0]), max(state[1], made[1]))),
        Stage(0, lambda states, pdf: monitor(states).streaks(pdf), lambda streak, made: made[1] + (0 if made[0] else streak)),
        Stage((0, fresh.sent), lambda states, pdf: monitor(states).sends(pdf, states[0][1]), lambda last, jumps: jumps(last)),
    ]
    return chunked(cols, ["session_id"], "seq", F.floor(F.col("seq") / chunk), stages, lambda states: monitor(states).status, f"session_id {sid}, {STATUS_FIELDS}")


def session_recal_check(sessions: DataFrame, warn_db: float = 3.0, motion_warn: float = 0.40) -> DataFrame:
    """One-shot check of recorded sessions against the baseline of their user."""
    snr, base, motion = F.col("snr_db"), F.col("baseline"), F.col("motion_index")
    known = snr.isNotNull() & base.isNotNull()
    deficit = F.greatest(base - snr, F.lit(0.0))
    suggested = known & (snr < base - warn_db)
    notes = F.array_compact(
        F.array(
            F.when(deficit >= warn_db, F.format_string(REASON_DEFICIT, deficit)),
            F.when(motion >= motion_warn, F.format_string(REASON_MOTION, motion)),
        )
    )
    return sessions.select(
        "*",
        F.when(known, deficit).otherwise(0.0).alias("snr_deficit_db"),
        suggested.alias("suggested"),
        suggested.cast("long").alias("low_streak"),
        F.when(known, notes).otherwise(F.array(F.lit(REASON_UNKNOWN))).alias("reasons"),
    )


def throttle(events: DataFrame, keys: Sequence[str], interval_s: float, intervals: int = CHUNK_INTERVALS) -> DataFrame:
    """At most one row per key and interval: in order of ``t``, a row passes when it is ``interval_s`` past the last passed one.

    Rows without a time never pass. A key is cut into chunks of ``intervals`` intervals that run at the same time; what a chunk does is a table of its first interval's rows.
    """
    fields = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    cols = events.select(*keys, F.col("t").cast("double").alias("t")).where("t IS NOT NULL AND NOT isnan(t)")
    if interval_s <= 0:
        return cols

    def replay(states: list):
        passed = [states[0][1]]

        def step(pdf):
            at, passed[0] = spaced(pdf["t"].to_numpy(), interval_s, passed[0])
            return pdf.iloc[at]

        return step

    stage = Stage((0, -np.inf), lambda states, pdf: Jumps(pdf["t"].to_numpy(float), interval_s, float(pdf["t"].iloc[0])), lambda last, jumps: jumps(last))
    return chunked(cols, keys, "t", F.floor(F.col("t") / (interval_s * intervals)), [stage], replay, f"{fields}, t double")


def ptt_utterances(
    chunks: DataFrame, controls: DataFrame, fs_hz: float, *, pre_roll: int = 8, min_ms: float = 200, max_ms: float = 15_000, chunk: int = 65_536
) -> DataFrame:
    """Which chunks belong to which push-to-talk utterance.

    ``chunks(session_id, seq, n_frames)`` and ``controls(session_id, seq, cmd)`` with
    ``cmd`` ``start`` or ``end`` taking effect before chunk ``seq``. An utterance that was
    ended has up to chunks from before its start; under ``min_ms`` it is dropped, frames past
    ``max_ms`` are cut. Result: ``session_id, utterance, seq, keep_frames``.
    """
    keys = ["session_id"]
    marks = controls.groupBy("session_id", "seq").agg(F.max(F.struct("at", "cmd"))["cmd"].alias("cmd"))
    marked = chunks.join(marks, ["session_id", "seq"], "left")
    state = last_known(marked, keys, "seq", {"_cmd": F.col("cmd")}, chunk=chunk)
    state = running_sum(state, keys, "seq", {"utterance": (F.col("cmd") == "start").cast("long")}, chunk=chunk)
    on = state.withColumn("_on", F.coalesce(F.col("_cmd") == "start", F.lit(False)))
    talk = on.where("_on").select("session_id", "utterance", "seq", "n_frames")
    heads = on.where((F.col("cmd") == "start")).select("session_id", "utterance", F.col("seq").alias("_at"))
    before = heads.withColumn("seq", F.explode(F.sequence(F.col("_at") - pre_roll, F.col("_at") - 1)))
    early = before.join(chunks.select("session_id", "seq", "n_frames"), ["session_id", "seq"]).select("session_id", "utterance", "seq", "n_frames")
    ended = on.where("cmd = 'end'").select("session_id", "utterance").distinct()
    parts = talk.unionByName(early).join(ended, ["session_id", "utterance"], "left_semi")
    first = parts.groupBy("session_id", "utterance").agg(F.min("seq").alias("_first"), F.sum("n_frames").alias("_total"))
    parts = parts.join(first, ["session_id", "utterance"]).where(F.col("_total") >= int(min_ms * fs_hz / 1000))
    placed = parts.withColumn("_pos", F.col("seq") - F.col("_first"))
    summed = running_sum(placed, ["session_id", "utterance"], "_pos", {"_end": F.col("n_frames")}, chunk=chunk)
    most = int(max_ms * fs_hz / 1000)
    keep = F.greatest(F.least(F.col("n_frames"), F.lit(most) - (F.col("_end") - F.col("n_frames"))), F.lit(0))
    return summed.select("session_id", "utterance", "seq", keep.cast("long").alias("keep_frames")).where("keep_frames > 0")


def with_baseline(sessions: DataFrame, profiles: DataFrame) -> DataFrame:
    base = profiles.select("user_id", F.col("baseline_snr").alias("baseline"))
    return spread_join(sessions, base, ["user_id"], "left", salt_by=["session_id"])
