"""Token gate and recalibration status as recurrences over arrays of one key's rows.

A key's rows come in order, in chunks of any size; what one chunk leaves to the next is a few numbers, so batch and stream
share the code. What a chunk does to these numbers can be summed up without knowing them (``Smoothing``, ``Clamped``, ``Jumps``), so that
chunks of one key can be worked on at the same time. Runs and streaks are islands found with running maxima; only the exponential means, and the rows
that are about to be sent, are walked one by one.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd

from subvox.functions.fixed import GATE_EASY, GATE_HARD, GATE_PULL, GATE_STEP, REASON_DEFICIT, REASON_MOTION, REASON_STREAK

TOKEN_FIELDS = "step bigint, t double, token string, confidence double, gate double"
STATUS_FIELDS = "seq bigint, snr_ema double, snr_deficit_db double, low_streak bigint, suggested boolean, broadcast boolean, reasons string"


@dataclass(frozen=True)
class GateConfig:
    """Settings of the token gate."""

    stable_n: int = 3
    cooldown_ms: float = 250.0
    min_confidence: float = 0.70
    blank: str | None = None
    adaptive: bool = False
    alpha: float = 0.1
    low: float = 0.5
    high: float = 0.95
    baseline_snr_db: float | None = None
    deficit_scale: float = 0.015
    deficit_cap: float = 0.22


@dataclass(frozen=True)
class RecalConfig:
    """Settings of the recalibration monitor."""

    warn_db: float = 3.0
    motion_warn: float = 0.40
    streak: int = 3
    cooldown_s: float = 30.0
    alpha: float = 0.15


def smoothed(values: Iterable[float], alpha: float, before: float) -> np.ndarray:
    """``before`` and the exponential mean after each value; a NaN before is replaced by the first value."""
    return np.fromiter(accumulate(values, lambda e, v: v if e != e else (1 - alpha) * e + alpha * v, initial=before), float)


def spaced(t: np.ndarray, gap: float, last: float) -> tuple[list[int], float]:
    """Positions whose time is ``gap`` or more past the last one taken, and the time of the last one."""
    taken = []
    for i, now in enumerate(t.tolist()):
        if now - last >= gap:
            taken.append(i)
            last = now
    return taken, last


@dataclass(frozen=True)
class Smoothing:
    """What values do to an exponential mean: ``keep * mean + own``, or ``first`` if there was no mean or it does not matter."""

    keep: float
    own: float
    first: float
    fixed: bool

    @staticmethod
    def of(values: np.ndarray, alpha: float) -> Smoothing:
        first = smoothed(values, alpha, np.nan)[-1]
        return Smoothing((1 - alpha) ** len(values), smoothed(values, alpha, 0.0)[-1], first, bool(np.isnan(values).any()))

    def __call__(self, mean: float) -> float:
        return self.first if self.fixed or mean != mean else self.keep * mean + self.own


@dataclass(frozen=True)
class Clamped:
    """``x -> min(high, max(low, scale * x + shift))`` with ``scale >= 0``; the steps of a chunk compose to one of these."""

    scale: float = 1.0
    shift: float = 0.0
    low: float = -np.inf
    high: float = np.inf

    def __call__(self, x: float) -> float:
        return min(self.high, max(self.low, self.scale * x + self.shift))

    def then(self, scale: float, shift: float, low: float, high: float) -> Clamped:
        bound = lambda x: min(high, max(low, (scale * x if scale else 0.0) + shift))  # noqa: E731  0 times an open bound is 0
        return Clamped(scale * self.scale, scale * self.shift + shift, bound(self.low), bound(self.high))


class Jumps:
    """What candidates do to the last one taken, if one is taken when its time is ``gap`` past that or its name is another one.

    ``last`` is a pair of name and time. Of the candidates only those can be taken first that stand before the first one that is taken
    whatever came before: those up to a time ``gap`` past ``upto``, the latest time before the chunk, or to another name. For each of
    these the table has the last one taken on the path from it.
    """

    def __init__(self, t: np.ndarray, gap: float, upto: float, names: np.ndarray | None = None):
        self.gap = gap
        known = ~np.isnan(t)
        if names is None:
            names = np.zeros(len(t), np.int64)
            t, names = t[known], names[known]
        n = len(t)
        at = self._after(t, gap)
        change = np.full(n, n)
        for i in range(n - 2, -1, -1):
            change[i] = change[i + 1] if names[i + 1] == names[i] else i + 1
        end = np.minimum(at, change)
        end = np.where(end < n, end, np.arange(n))
        while n and (end[end] != end).any():
            end = end[end]
        sure = np.flatnonzero((names != names[0]) | (t - upto >= gap)) if n else np.array([], int)
        entries = np.arange(n if not len(sure) else sure[0] + 1)
        self.entry = list(zip(names[entries].tolist(), t[entries].tolist()))
        self.end = [(names[e], float(t[e])) for e in end[entries]]

    @staticmethod
    def _after(t: np.ndarray, gap: float) -> np.ndarray:
        """Place of the first later candidate that is ``gap`` or more past each one."""
        n = len(t)
        if n and (np.diff(t) >= 0).all():
            at = np.maximum(np.searchsorted(t, t + gap), np.arange(n) + 1)
            while True:  # the sum is rounded, the difference decides
                back = (at - 1 > np.arange(n)) & (t[np.minimum(at, n) - 1] - t >= gap)
                on = (at < n) & ~(t[np.minimum(at, n - 1)] - t >= gap)
                if not back.any() and not on.any():
                    return at
                at = at - back + (on & ~back)
        return np.array([next((j for j in range(i + 1, n) if t[j] - t[i] >= gap), n) for i in range(n)], int)

    def __call__(self, last: tuple) -> tuple:
        for (name, t), end in zip(self.entry, self.end):
            if name != last[0] or t - last[1] >= self.gap:
                return end
        return last


def latest(t: np.ndarray, before: float = -np.inf) -> float:
    return float(np.fmax.reduce(t, initial=before))


def since_last(stop: np.ndarray, carry: int) -> np.ndarray:
    """Rows since the last true one of ``stop``; ``carry`` rows went before the first."""
    place = np.arange(1, len(stop) + 1)
    at = np.maximum.accumulate(np.where(stop, place, 0))
    return place - at + np.where(at == 0, carry, 0)


class TokenGate:
    """Lets a token through when the last ``stable_n`` rows since an abstention agree on it with enough mean confidence.

    ``events`` takes a frame ``step, t, token, confidence, snr_db, abstain`` (other columns stay in front).
    """

    def __init__(self, cfg: GateConfig):
        self.cfg = cfg
        self.tail = (np.array([], object), np.array([], float))
        self.mean, self.threshold = np.nan, cfg.min_confidence
        self.sent: tuple[str | None, float] = (None, 0.0)

    def _levels(self, conf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean confidence before and after each row, and the scale and shift by which each row moves the threshold."""
        cfg, a = self.cfg, self.alpha
        mean = smoothed(conf, a, self.mean)
        now, step = mean[1:], GATE_STEP * max(a, GATE_PULL)
        outside = [now > GATE_EASY, now < GATE_HARD]
        return mean, np.select(outside, [1.0, 1.0], 1 - GATE_PULL * a), np.select(outside, [-step, step], GATE_PULL * a * cfg.min_confidence)

    @property
    def alpha(self) -> float:
        return min(1.0, max(1e-6, self.cfg.alpha))

    def _thresholds(self, conf: np.ndarray) -> np.ndarray:
        cfg = self.cfg
        if not cfg.adaptive:
            return np.full(len(conf), cfg.min_confidence)
        # Each row maps the threshold x to scale * x + shift, inside the allowed range.
        mean, scale, shift = self._levels(conf)
        steps = accumulate(zip(scale, shift), lambda x, m: min(cfg.high, max(cfg.low, m[0] * x + m[1])), initial=self.threshold)
        levels = np.fromiter(steps, float)
        self.mean, self.threshold = mean[-1], levels[-1]
        return levels[1:]

    def candidates(self, token: np.ndarray, conf: np.ndarray, snr: np.ndarray, abstain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose last ``stable_n`` rows agree, with their mean confidence and the level that it reaches."""
        cfg, n = self.cfg, self.cfg.stable_n
        rows, isle = np.flatnonzero(~abstain), np.cumsum(abstain)
        level = self._thresholds(conf[rows])
        if cfg.baseline_snr_db is not None:
            lack = np.maximum(cfg.baseline_snr_db - snr[rows], 0.0) * cfg.deficit_scale
            level = level + np.nan_to_num(np.minimum(lack, cfg.deficit_cap))
        level = np.clip(level, cfg.low, cfg.high + cfg.deficit_cap)
        old = len(self.tail[0])
        words, confs = np.concatenate([self.tail[0], token[rows]]), np.concatenate([self.tail[1], conf[rows]])
        isles = np.concatenate([np.zeros(old, int), isle[rows]])
        if len(isle):
            mine = np.flatnonzero(isles == isle[-1])[-(n - 1) :] if n > 1 else np.array([], int)
            self.tail = (words[mine], confs[mine])
        if len(words) < n:
            return np.array([], int), np.array([]), np.array([])
        fresh = np.concatenate([[True], (words[1:] != words[:-1]) | (isles[1:] != isles[:-1])])
        mean = np.full(len(words), np.nan)
        mean[n - 1 :] = np.lib.stride_tricks.sliding_window_view(confs, n).mean(axis=1)
        mean = mean[old:]
        able = np.flatnonzero(((since_last(fresh, 0) + 1 >= n) & (words != cfg.blank))[old:] & (mean >= level))
        return rows[able], mean[able], level[able]

    def feed(self, t: np.ndarray, token: np.ndarray, conf: np.ndarray, snr: np.ndarray, abstain: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Positions of the tokens let through, with their mean confidence and the level they had to reach."""
        at, mean, level = self.candidates(token, conf, snr, abstain)
        out = []
        for i, place in enumerate(at):
            if token[place] != self.sent[0] or t[place] - self.sent[1] >= self.cfg.cooldown_ms / 1000:
                out.append(i)
                self.sent = (token[place], t[place])
        return [int(at[i]) for i in out], mean[out], level[out]

    @staticmethod
    def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        number = lambda c: pdf[c].to_numpy(float, na_value=np.nan)
        return number("t"), pdf["token"].to_numpy(object), number("confidence"), number("snr_db"), pdf["abstain"].eq(True).to_numpy(bool)

    def events(self, pdf: pd.DataFrame) -> pd.DataFrame:
        at, mean, level = self.feed(*self.arrays(pdf))
        kept = pdf.iloc[at].drop(columns=["confidence", "snr_db", "abstain"])
        return kept.assign(confidence=mean, gate=level)

    # What a chunk does to the mean, the last rows and the latest time; then to the threshold; then to the last token sent.

    def recent(self, pdf: pd.DataFrame) -> tuple[Smoothing, bool, np.ndarray, np.ndarray, float]:
        t, token, conf, _, abstain = self.arrays(pdf)
        stops = np.flatnonzero(abstain)
        last = np.arange(stops[-1] + 1 if len(stops) else 0, len(t))[-(self.cfg.stable_n - 1) :] if self.cfg.stable_n > 1 else np.array([], int)
        return Smoothing.of(conf[~abstain], self.alpha), bool(len(stops)), token[last], conf[last], latest(t)

    def after_recent(self, state: tuple, made: tuple) -> tuple:
        (mean, words, confs, upto), (smoothing, cut, own_words, own_confs, t) = state, made
        keep = self.cfg.stable_n - 1
        if not cut and keep:
            own_words, own_confs = np.concatenate([words, own_words])[-keep:], np.concatenate([confs, own_confs])[-keep:]
        return smoothing(mean), own_words, own_confs, max(upto, t)

    def moved(self, pdf: pd.DataFrame) -> Clamped:
        _, _, conf, _, abstain = self.arrays(pdf)
        out = Clamped()
        if self.cfg.adaptive:
            for scale, shift in zip(*self._levels(conf[~abstain])[1:]):
                out = out.then(scale, shift, self.cfg.low, self.cfg.high)
        return out

    def sends(self, pdf: pd.DataFrame, upto: float) -> Jumps:
        t, token, conf, snr, abstain = self.arrays(pdf)
        at = self.candidates(token, conf, snr, abstain)[0]
        return Jumps(t[at], self.cfg.cooldown_ms / 1000, upto, token[at])


class Recalibration:
    """Smoothed SNR against the baseline, streak of low readings and spaced broadcasts.

    ``status`` takes a frame ``seq, t, snr_db, motion_index, baseline`` (other columns stay in front). Rows without an
    SNR leave mean and streak as they are.
    """

    def __init__(self, cfg: RecalConfig):
        self.cfg, self.mean, self.streak, self.sent = cfg, np.nan, 0, 0.0

    def status(self, pdf: pd.DataFrame) -> pd.DataFrame:
        cfg = self.cfg
        t, snr, motion, baseline = (pdf[c].to_numpy(float, na_value=np.nan) for c in ("t", "snr_db", "motion_index", "baseline"))
        read = ~np.isnan(snr)
        place = np.cumsum(read)  # readings so far; 0 points at what was carried in
        mean = smoothed(snr[read], cfg.alpha, self.mean)[place]
        deficit = np.where(read, np.fmax(baseline - mean, 0.0), 0.0)
        low = read & (deficit >= cfg.warn_db)
        streak = np.concatenate([[self.streak], since_last(~low[read], self.streak)])[place].astype(int)
        suggested = streak >= cfg.streak
        asks = np.flatnonzero(suggested)
        taken, self.sent = spaced(t[asks], cfg.cooldown_s, self.sent)
        broadcast = np.isin(np.arange(len(t)), asks[taken])
        if len(t):
            self.mean, self.streak = mean[-1], int(streak[-1])
        moved = motion >= cfg.motion_warn
        texts = {
            REASON_DEFICIT: (low, deficit),
            REASON_MOTION: (moved, motion),
            REASON_STREAK: (suggested & ~low & ~moved, None),
        }
        reasons = ["; ".join(text if of is None else text % of[i] for text, (on, of) in texts.items() if on[i]) for i in range(len(t))]
        kept = pdf.drop(columns=["t", "snr_db", "motion_index", "baseline"])
        return kept.assign(snr_ema=mean, snr_deficit_db=deficit, low_streak=streak, suggested=suggested, broadcast=broadcast, reasons=reasons)

    # What a chunk does to the mean and the latest time; then to the streak; then to the last broadcast.

    def recent(self, pdf: pd.DataFrame) -> tuple[Smoothing, float]:
        t, snr = (pdf[c].to_numpy(float, na_value=np.nan) for c in ("t", "snr_db"))
        return Smoothing.of(snr[~np.isnan(snr)], self.cfg.alpha), latest(t)

    def streaks(self, pdf: pd.DataFrame) -> tuple[bool, int]:
        """Whether a reading was not low, and the low ones since the last such one."""
        snr, baseline = (pdf[c].to_numpy(float, na_value=np.nan) for c in ("snr_db", "baseline"))
        read = ~np.isnan(snr)
        mean = smoothed(snr[read], self.cfg.alpha, self.mean)[1:]
        low = np.fmax(baseline[read] - mean, 0.0) >= self.cfg.warn_db
        return bool((~low).any()), int(since_last(~low, 0)[-1]) if len(low) else 0

    def sends(self, pdf: pd.DataFrame, upto: float) -> Jumps:
        t = pdf["t"].to_numpy(float, na_value=np.nan)
        return Jumps(t[self.status(pdf)["suggested"].to_numpy(bool)], self.cfg.cooldown_s, upto)
