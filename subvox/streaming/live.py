"""Live operators: gaps, preprocessing, quality, windows, tokens, recalibration, utterances, decoding.

Block rows are contiguous runs of samples. Where samples are missing before a row, operators with ``on_gap`` go on with what they hold
(``carry``) or start anew (``reset``); positions are those of the recording in both cases. Samples that have already come are not used again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subvox.functions import kernels as k
from subvox.functions.design import mode_filter
from subvox.functions.recurrence import STATUS_FIELDS, TOKEN_FIELDS, GateConfig, RecalConfig, Recalibration, TokenGate, spaced
from subvox.operators.filtering import EMA_CHUNK
from subvox.streaming.keyed import keyed, keyed_frames

Scorer = Callable[[np.ndarray], tuple[str, float, bool]]


def _type(df: DataFrame, col: str = "session_id") -> str:
    return df.schema[col].dataType.simpleString()


def _number(v) -> float | None:
    return None if v is None or v != v else float(v)


def stream_gaps(packets: DataFrame) -> DataFrame:
    """Samples lost before each packet and so far, per device in arrival order."""

    def feed(state, rows):
        due, total = state
        first = rows["sample_index"].to_numpy(np.int64)
        after = first + rows["frames"].to_numpy(np.int64)
        lost = np.maximum(0, first - np.append(first[0] if due is None else due, after[:-1]))
        totals = total + np.cumsum(lost)
        out = pd.DataFrame({"device_id": rows["device_id"].to_numpy(), "arrival_no": rows["arrival_no"].to_numpy(), "lost": lost, "lost_total": totals})
        return (int(after[-1]), int(totals[-1])), out

    schema = f"device_id {_type(packets, 'device_id')}, arrival_no bigint, lost bigint, lost_total bigint"
    cols = packets.select("device_id", "arrival_no", "sample_index", "frames")
    return keyed_frames(cols, ["device_id"], ["arrival_no"], schema, lambda: (None, 0), feed)


class Arrivals:
    """Where the samples of a session continue: new ones of a row, and whether some are missing before them."""

    def __init__(self, on_gap: str):
        if on_gap not in ("carry", "reset"):
            raise ValueError(f"on_gap is carry or reset, not {on_gap!r}")
        self.reset, self.due = on_gap == "reset", None

    def take(self, row) -> tuple[int, np.ndarray, bool]:
        """First new sample, the new samples, and whether to start anew."""
        x, first = k.frames(row.samples, row.channels), int(row.start_sample)
        known = 0 if self.due is None else min(len(x), max(0, self.due - first))
        fresh = self.due is None or (self.reset and first > self.due and len(x) > 0)
        self.due = max(first + len(x), self.due or 0)
        return first + known, x[known:], fresh


class Preprocessor:
    """Filter and normalisation state of one session, advanced block by block."""

    def __init__(self, alpha: float, gated: bool):
        self.alpha, self.gated, self.filter_state = alpha, gated, None
        self.mu = self.var = None
        self.rest = None

    def push(self, mode: str, fs: float, x: np.ndarray, last: bool = False) -> np.ndarray:
        """Output for whole 128-frame chunks; a shorter rest waits unless ``last``."""
        if self.filter_state is None:
            self.filter_state = mode_filter(mode, fs).begin(x.shape[1])
            self.mu, self.var, self.rest = np.zeros(x.shape[1]), np.ones(x.shape[1]), x[:0]
        data = np.vstack([self.rest, x])
        whole = len(data) if last else len(data) // EMA_CHUNK * EMA_CHUNK
        out = []
        for i in range(0, whole, EMA_CHUNK):
            raw = data[i : min(i + EMA_CHUNK, whole)]
            y, self.filter_state = mode_filter(mode, fs).run(raw, self.filter_state)
            self.mu = (1 - self.alpha) * self.mu + self.alpha * y.mean(axis=0)
            self.var = (1 - self.alpha) * self.var + self.alpha * ((y - self.mu) ** 2).mean(axis=0)
            y = (y - self.mu) / (np.sqrt(self.var) + 1e-6)
            if self.gated and k.chunk_motion(raw, fs) >= 0.35:
                y = y * 0.15
            out.append(y)
        self.rest = data[whole:]
        return np.vstack(out) if out else data[:0]


#: Block rows in the order of their samples.
IN_ORDER = ["block", "start_sample"]


def stream_preprocess(blocks: DataFrame, *, alpha: float = 0.01, gated: bool = False, on_gap: str = "carry") -> DataFrame:
    """The causal chain on live block rows (``mode``, ``fs_hz`` attached); equals the batch operator."""

    def step(state, row):
        seen, chain = state or (Arrivals(on_gap), None)
        first, x, fresh = seen.take(row)
        chain = Preprocessor(alpha, gated) if fresh else chain
        if not len(x):
            return (seen, chain), []
        y = chain.push(row.mode, float(row.fs_hz), x, last=len(x) % EMA_CHUNK != 0)
        return (seen, chain), [(row.session_id, row.block, first, len(y), int(row.channels), row.mode, float(row.fs_hz), y.ravel())]

    schema = (
        f"session_id {_type(blocks)}, block bigint, start_sample bigint, n_frames int, channels int, mode string, fs_hz double, samples array<double>"
    )
    cols = blocks.select("session_id", "block", "start_sample", "channels", "mode", "fs_hz", "samples")
    return keyed(cols, ["session_id"], IN_ORDER, schema, lambda: None, step)


def quality_window(fs: float) -> int:
    return int(min(max(2 * fs, 256), 2048))


def _assess(x: np.ndarray, fs: float, band, noise) -> tuple:
    ratio = k.welch_ratio(x, fs, band, noise)
    index, wander = k.motion(x, fs)
    known = ratio is not None and np.isfinite(ratio).all() and ratio.mean() > 0
    snr = float(10 * np.log10(ratio.mean())) if known else None
    per = list(10 * np.log10(np.maximum(ratio, 1e-12))) if known else None
    return snr, float(index.mean()), float(wander.mean()), per


def stream_quality(blocks: DataFrame, band: tuple[float, float], noise: tuple[float, float] = (0.5, 5.0), *, on_gap: str = "carry") -> DataFrame:
    """Quality of the true trailing window (two seconds, 256 to 2048 frames) after every block."""

    def step(state, row):
        seen, held = state or (Arrivals(on_gap), None)
        fs = float(row.fs_hz)
        first, x, fresh = seen.take(row)
        if not len(x):
            return (seen, held), []
        held = (x if fresh else np.vstack([held, x]))[-quality_window(fs) :]
        snr, motion, wander, per = _assess(held, fs, band, noise)
        return (seen, held), [(row.session_id, row.block, first + len(x), len(held), snr, motion, wander, per)]

    schema = (
        f"session_id {_type(blocks)}, block bigint, win_end bigint, n_frames int, snr_db double, motion_index double, baseline_wander double, "
        "snr_db_per_channel array<double>"
    )
    cols = blocks.select("session_id", "block", "start_sample", "channels", "fs_hz", "samples")
    return keyed(cols, ["session_id"], IN_ORDER, schema, lambda: None, step)


class Windows:
    """Windows of ``win`` samples that end at ``win + i * stride`` samples after the (re)start, with their true last positions."""

    def __init__(self, win: int, stride: int):
        self.win, self.stride, self.held, self.at, self.number = win, stride, None, None, 0
        self.skip = 0

    def push(self, first: int, x: np.ndarray, fresh: bool) -> list[tuple[int, int, np.ndarray]]:
        """``(number, end, samples)`` of the windows that the new samples complete."""
        place = np.arange(first, first + len(x))
        if fresh or self.held is None:
            self.held, self.at, self.skip = x, place, 0
        else:
            self.held, self.at = np.vstack([self.held, x]), np.concatenate([self.at, place])
        out, begin = [], self.skip
        while begin + self.win <= len(self.held):
            stop = begin + self.win
            out.append((self.number, int(self.at[stop - 1]) + 1, self.held[begin:stop]))
            self.number, begin = self.number + 1, begin + self.stride
        drop = min(begin, len(self.held))
        self.held, self.at, self.skip = self.held[drop:], self.at[drop:], begin - drop
        return out


def stream_windows(blocks: DataFrame, *, window_ms: float = 600, stride_ms: float = 120, on_gap: str = "carry") -> DataFrame:
    """A decode window every stride, aligned to ``window + i * stride`` whatever the block size.

    After lost samples, ``carry`` has windows over the samples on both sides, and ``reset`` begins a new window behind the gap. ``win_end`` is
    one past the window's last sample in the recording; ``step`` counts a session's windows.
    """

    def step(state, row):
        fs = float(row.fs_hz)
        seen, windows = state or (Arrivals(on_gap), Windows(max(1, int(fs * window_ms / 1000)), max(1, int(fs * stride_ms / 1000))))
        done = windows.push(*seen.take(row))
        return (seen, windows), [(row.session_id, i, end, int(row.channels), w.ravel()) for i, end, w in done]

    schema = f"session_id {_type(blocks)}, step bigint, win_end bigint, channels int, samples array<double>"
    cols = blocks.select("session_id", "block", "start_sample", "channels", "fs_hz", "samples")
    return keyed(cols, ["session_id"], IN_ORDER, schema, lambda: None, step)


def stream_tokens(predictions: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Debounced tokens from live predictions, with the adaptive gate if configured."""
    cols = predictions.select("session_id", "step", "t", "token", "confidence", "snr_db", "abstain")
    feed = lambda gate, pdf: (gate, gate.events(pdf))
    return keyed_frames(cols, ["session_id"], ["step"], f"session_id {_type(predictions)}, {TOKEN_FIELDS}", lambda: TokenGate(cfg), feed)


def stream_recalibration(readings: DataFrame, cfg: RecalConfig = RecalConfig()) -> DataFrame:
    """Recalibration status after every quality reading."""
    cols = readings.select("session_id", "seq", "t", "snr_db", "motion_index", "baseline")
    feed = lambda monitor, pdf: (monitor, monitor.status(pdf))
    return keyed_frames(cols, ["session_id"], ["seq"], f"session_id {_type(readings)}, {STATUS_FIELDS}", lambda: Recalibration(cfg), feed)


def stream_throttle(events: DataFrame, key: str, interval_s: float) -> DataFrame:
    """At most one event per key and interval."""

    def feed(last, pdf):
        at, last = spaced(pdf["t"].to_numpy(), interval_s, last)
        return last, pdf.iloc[at]

    return keyed_frames(events.select(key, "t"), [key], ["t"], f"{key} {_type(events, key)}, t double", lambda: -np.inf, feed)


def stream_utterances(rows: DataFrame, fs_hz: float, *, pre_roll: int = 8, min_ms: float = 200, max_ms: float = 15_000) -> DataFrame:
    """Push-to-talk utterances from one stream of chunk and control rows.

    ``session_id, seq, kind, channels, samples`` with ``kind`` ``chunk``, ``start`` or ``end``;
    a control takes effect before the chunk of the same ``seq``.
    """
    least, most = int(min_ms * fs_hz / 1000), int(max_ms * fs_hz / 1000)

    def step(state, row):
        on, early, held, number = state
        if row.kind == "start":
            return (True, early, list(early), number + 1), []
        if row.kind == "end":
            data = np.vstack(held)[:most] if on and held else None
            out = []
            if data is not None and sum(len(h) for h in held) >= least:
                out = [(row.session_id, number, len(data), data.shape[1], data.ravel())]
            return (False, early, [], number), out
        x = k.frames(row.samples, row.channels)
        return (on, [*early, x][-pre_roll:], [*held, x] if on else held, number), []

    schema = f"session_id {_type(rows)}, utterance bigint, n_frames int, channels int, samples array<double>"
    first = F.when(F.col("kind") == "chunk", 1).otherwise(0)
    cols = rows.withColumn("_turn", first).select("session_id", "seq", "_turn", "kind", "channels", "samples").withColumnRenamed("_turn", "turn")
    return keyed(cols, ["session_id"], ["seq", "turn"], schema, lambda: (False, [], [], 0), step)


def stream_decode(
    blocks: DataFrame, scorer: Scorer, *, cfg: GateConfig = GateConfig(), window_ms: float = 600, stride_ms: float = 120, alpha: float = 0.01, on_gap: str = "carry"
) -> DataFrame:
    """Raw live blocks to tokens: causal chain, windows, scoring and gate in one keyed state.

    ``scorer`` maps one preprocessed window to ``(token, confidence, abstain)``; it is a small
    function over fixed weights that travels with the query.
    """

    def step(state, row):
        fs = float(row.fs_hz)
        fresh_windows = Windows(max(1, int(fs * window_ms / 1000)), max(1, int(fs * stride_ms / 1000)))
        seen, chain, windows, gate = state or (Arrivals(on_gap), None, fresh_windows, TokenGate(cfg))
        first, x, fresh = seen.take(row)
        chain = Preprocessor(alpha, False) if fresh else chain
        y = chain.push(row.mode, fs, x, last=len(x) % EMA_CHUNK != 0) if len(x) else x
        done = windows.push(first, y, fresh)
        scored = [(end / fs, *scorer(window)) for _, end, window in done]
        t, token, conf, abstain = (np.array(v, kind) for v, kind in zip(zip(*scored) if scored else [()] * 4, (float, object, float, bool)))
        at, mean, level = gate.feed(t, token, conf, np.full(len(t), np.nan), abstain)
        out = [(row.session_id, done[i][0], t[i], token[i], m, g) for i, m, g in zip(at, mean, level)]
        return (seen, chain, windows, gate), out

    schema = f"session_id {_type(blocks)}, step bigint, t double, token string, confidence double, gate double"
    cols = blocks.select("session_id", "block", "start_sample", "channels", "mode", "fs_hz", "samples")
    return keyed(cols, ["session_id"], IN_ORDER, schema, lambda: None, step)


def split_late(blocks: DataFrame, delay: str = "10 seconds", time: str = "event_time") -> DataFrame:
    """Drops repeated blocks inside the watermark; later ones are left to the batch reconcile."""
    return blocks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["session_id", "block"])
