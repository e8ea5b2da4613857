"""Small numpy helpers applied to one block or one utterance inside a task."""

from __future__ import annotations

import math

import numpy as np

from subvox.functions.design import LinearFilter, band_filter, low_filter


def frames(samples, channels: int) -> np.ndarray:
    """Row-major sample list to ``(frames, channels)`` in double precision."""
    return np.asarray(samples, dtype=np.float64).reshape(-1, int(channels))


# --- power spectra -------------------------------------------------------------------


def segment_power(segments: np.ndarray, fs: float) -> np.ndarray:
    """One-sided density of ``(segment, frame, channel)`` data with a periodic Hann window."""
    n = segments.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    level = segments - segments.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(level * window[None, :, None], axis=1)) ** 2 / (fs * (window**2).sum())
    last = power.shape[1] if n % 2 else power.shape[1] - 1
    power[:, 1:last] *= 2
    return power


def half_overlapping(x: np.ndarray, n: int) -> np.ndarray:
    """Views of length ``n`` every ``n - n // 2`` frames: ``(segment, frame, channel)``."""
    views = np.lib.stride_tricks.sliding_window_view(x, n, axis=0)[:: n - n // 2]
    return np.swapaxes(views, 1, 2)


def segment_length(n_frames: int) -> int:
    return min(256, n_frames // 4)


def band_ratio(psd: np.ndarray, fs: float, n: int, band: tuple[float, float], noise: tuple[float, float]) -> np.ndarray:
    """Mean density in the band over mean density in the noise band, per channel; NaN
    when the noise band holds no frequency bin."""
    f = np.fft.rfftfreq(n, 1 / fs)
    inside, outside = (f >= band[0]) & (f <= band[1]), (f >= noise[0]) & (f <= noise[1])
    if not inside.any() or not outside.any():
        return np.full(psd.shape[1], np.nan)
    return psd[inside].mean(axis=0) / np.maximum(psd[outside].mean(axis=0), 1e-12)


def welch_ratio(x: np.ndarray, fs: float, band: tuple[float, float], noise: tuple[float, float]) -> np.ndarray | None:
    n = segment_length(len(x))
    if n < 4:
        return None
    return band_ratio(segment_power(half_overlapping(x, n), fs).mean(axis=0), fs, n, band, noise)


# --- power behind a filter --------------------------------------------------------------


def mean_square(x: np.ndarray, flt: LinearFilter | None = None) -> np.ndarray:
    """Mean square per channel, of the data as they are or behind a causal filter that starts from zero."""
    y = x if flt is None else flt.run(x, np.zeros((flt.size, x.shape[1])))[0]
    return np.square(y).mean(axis=0)


def motion(x: np.ndarray, fs: float, cut: float = 5.0, order: int = 4, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Share of slow movement (0 to 1) and its RMS, per channel. No frames, or a cut that the rate can't hold: zeros."""
    none = np.zeros(x.shape[1])
    if not len(x) or 2 * cut >= fs:
        return none, none
    slow, whole = np.sqrt([mean_square(x, low_filter(order, cut, fs)), mean_square(x)])
    return np.clip(slow / (whole + floor), 0.0, 1.0), slow


def chunk_motion(x: np.ndarray, fs: float) -> float:
    """The same of the channel mean of one short chunk, by a gentler filter; under four frames nothing is said."""
    return float(motion(x.mean(axis=1, keepdims=True), fs, order=2, floor=1e-9)[0][0]) if len(x) >= 4 else 0.0


def band_snr_time(x: np.ndarray, fs: float, band: tuple[float, float]) -> float | None:
    """Median over channels of the band's power over that of 0.5 to 5 Hz, in dB; None if a band is empty or data are short."""
    half = fs / 2
    edges = np.array([(band[0], min(band[1], half * 0.99)), (0.5, min(5.0, half * 0.95))])
    if len(x) < 32 or (edges[:, 1] <= edges[:, 0]).any():
        return None
    signal, noise = (mean_square(x, band_filter(4, *map(float, e), fs)) for e in edges)
    ratio = signal / np.maximum(noise, 1e-12)
    ratio = ratio[np.isfinite(ratio) & (ratio > 0)]
    return float(np.median(10 * np.log10(ratio))) if ratio.size else None


# --- covariance features ----------------------------------------------------------------


def window_frames(fs: float, window_ms: float, step_ms: float) -> tuple[int, int]:
    return max(2, int(round(fs * window_ms / 1000))), max(1, int(round(fs * step_ms / 1000)))


#: Frames from which a pane is worth its own moments.
PANE = 32


def pane_moments(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter (sum of outer products of what differs from the mean) of each full pane of ``size`` frames."""
    panes = x[: len(x) // size * size].reshape(-1, size, x.shape[1])
    means = panes.mean(axis=1)
    level = panes - means[:, None]
    return means, np.swapaxes(level, 1, 2) @ level


def merged_scatter(means: np.ndarray, scatter: np.ndarray | None, size: int, count: int, step: int) -> np.ndarray:
    """Scatter of ``count`` panes in a row, every ``step`` panes: their scatters (none for panes of one frame) and that of their means."""
    runs = np.lib.stride_tricks.sliding_window_view(means, count, axis=0)[::step]
    level = runs - runs.mean(axis=2, keepdims=True)
    out = level @ np.swapaxes(level, 1, 2)
    if scatter is not None:
        out *= size
        for i in range(count):
            out += scatter[i : i + (len(out) - 1) * step + 1 : step]
    return out


def covariances(x: np.ndarray, win: int, step: int) -> np.ndarray:
    """Sample covariance of every full window: ``(window, channel, channel)``.

    Windows are merges of panes, whose size divides window and step, so frames that windows share are multiplied once.
    Panes of less than ``PANE`` frames cost more to merge than to multiply again: then each frame is a pane.
    """
    if len(x) < win:
        return np.zeros((0, x.shape[1], x.shape[1]))
    size = math.gcd(win, step)
    if size < PANE or win == size:
        size = 1
    means, scatter = pane_moments(x, size) if size > 1 else (x, None)
    return merged_scatter(means, scatter, size, win // size, step // size) / max(win - 1, 1)


def shrink(cov: np.ndarray, eta: float) -> np.ndarray:
    c = cov.shape[-1]
    trace = np.trace(cov, axis1=-2, axis2=-1)[..., None, None]
    return (1 - eta) * cov + eta * trace / c * np.eye(c)


def log_spd(cov: np.ndarray, eta: float) -> np.ndarray:
    """Matrix logarithm of shrunk, slightly lifted covariances (batched)."""
    sym = shrink((cov + np.swapaxes(cov, -1, -2)) / 2, eta)
    c = sym.shape[-1]
    lift = 1e-9 * np.trace(sym, axis1=-2, axis2=-1)[..., None, None] / c
    values, vectors = np.linalg.eigh(sym + lift * np.eye(c))
    return (vectors * np.log(values)[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def eigen_basis(mean_log: np.ndarray) -> np.ndarray:
    """Eigenvectors of ``exp(mean_log)``, largest first, first row made non-negative.
    The exponential keeps the eigenvectors and their order."""
    values, vectors = np.linalg.eigh((mean_log + mean_log.T) / 2)
    q = vectors[:, np.argsort(values)[::-1]]
    return q * np.where(q[0] < 0, -1.0, 1.0)


def project(cov: np.ndarray, q: np.ndarray, mode: str) -> np.ndarray:
    """Features of ``(n, C, C)`` covariances in the basis ``q``: ``(n, D)``."""
    if mode in ("diag", "diag_delta"):
        return np.log(np.maximum(np.einsum("ji,njk,ki->ni", q, cov, q, optimize=True), 1e-8))
    sigma = q.T @ cov @ q
    if mode == "upper_tri":
        return sigma[:, *np.triu_indices(q.shape[0])]
    if mode == "full":
        return np.log(np.maximum(sigma.reshape(len(cov), -1), 1e-8))
    raise ValueError(f"unknown feature mode {mode}")


def with_deltas(seq: np.ndarray) -> np.ndarray:
    return np.hstack([seq, np.vstack([np.zeros((1, seq.shape[1])), np.diff(seq, axis=0)])])


def upper(cov: np.ndarray) -> np.ndarray:
    return cov[..., *np.triu_indices(cov.shape[-1])]


def from_upper(rows: np.ndarray) -> np.ndarray:
    c = int((np.sqrt(8 * rows.shape[-1] + 1) - 1) / 2)
    i, j = np.triu_indices(c)
    out = np.zeros((*rows.shape[:-1], c, c))
    out[..., i, j] = rows
    out[..., j, i] = rows
    return out


def zscore(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)
