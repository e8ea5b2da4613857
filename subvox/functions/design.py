"""Filter design in numpy and the block form in which tasks apply a filter.

A filter is a linear system ``s' = A s + B x``, ``y = C s + D x`` built as a chain of
second-order sections. ``LinearFilter.run`` applies it to many channels at once with
matrix products over pieces of ``SPAN`` frames instead of a loop over samples.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from subvox.functions.fixed import MODES, NOTCH_HZ, NOTCH_Q

SPAN = 256


def _digital(poles: np.ndarray, zeros: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Bilinear transform at a unit-free rate of 2."""
    missing = len(poles) - len(zeros)
    scaled = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    return (4 + poles) / (4 - poles), np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(missing)]), scaled


def _prototype(order: int) -> np.ndarray:
    return -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))


def _denominators(poles: np.ndarray) -> list[tuple[float, float]]:
    """``(a1, a2)`` of every section: complex poles with their mates, real poles two by two."""
    complex_ = poles[np.imag(poles) > 1e-12 * np.abs(poles)]
    real = np.sort(np.real(poles[np.abs(np.imag(poles)) <= 1e-12 * np.abs(poles)]))
    pairs = [(-2 * p.real, abs(p) ** 2) for p in complex_]
    pairs += [(-(real[i] + real[i + 1]), real[i] * real[i + 1]) for i in range(0, len(real) - 1, 2)]
    if len(real) % 2:
        pairs.append((-real[-1], 0.0))
    return sorted(pairs, key=lambda d: d[1])


def bandpass_sections(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Butterworth band-pass as rows ``b0 b1 b2 a1 a2``."""
    if not 0 < low < high < fs / 2:
        raise ValueError(f"band {low}-{high} Hz does not fit the rate {fs} Hz")
    w1, w2 = 4 * np.tan(np.pi * low / fs), 4 * np.tan(np.pi * high / fs)
    half = _prototype(order) * (w2 - w1) / 2
    root = np.sqrt(half**2 - w1 * w2 + 0j)
    poles, _, gain = _digital(np.concatenate([half + root, half - root]), np.zeros(order), (w2 - w1) ** order)
    dens = _denominators(poles)
    rows = [[1.0, 0.0, -1.0, a1, a2] for a1, a2 in dens]
    rows[0][:3] = [gain, 0.0, -gain]
    return np.array(rows)


def lowpass_sections(order: int, cut: float, fs: float) -> np.ndarray:
    """Butterworth low-pass of even order."""
    if order % 2 or not 0 < cut < fs / 2:
        raise ValueError("need an even order and a cut below half the rate")
    w = 4 * np.tan(np.pi * cut / fs)
    poles, _, gain = _digital(_prototype(order) * w, np.zeros(0), w**order)
    rows = [[1.0, 2.0, 1.0, a1, a2] for a1, a2 in _denominators(poles)]
    rows[0][:3] = [gain, 2 * gain, gain]
    return np.array(rows)


def notch_sections(freq: float, fs: float, q: float = NOTCH_Q) -> np.ndarray:
    w = 2 * np.pi * freq / fs
    gain = 1 / (1 + np.tan(w / q / 2))
    return np.array([[gain, -2 * gain * np.cos(w), gain, -2 * gain * np.cos(w), 2 * gain - 1]])


def _rest_state(sections: np.ndarray) -> np.ndarray:
    """State of a chain after an endless input of ones."""
    state, level = [], 1.0
    for b0, b1, b2, a1, a2 in sections:
        out = level * (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = b2 * level - a2 * out
        state += [b1 * level - a1 * out + s2, s2]
        level = out
    return np.array(state)


class LinearFilter:
    """Chains of sections in series; each chain starts from its own rest state."""

    def __init__(self, chains: list[np.ndarray]):
        self.chains = chains
        self.start = np.concatenate([_rest_state(c) for c in chains])
        sections = np.vstack(chains)
        self.sections = sections
        d = 2 * len(sections)
        a, b, c, feed = np.zeros((d, d)), np.zeros(d), np.zeros(d), 1.0
        for i, (b0, b1, b2, a1, a2) in enumerate(sections):
            k = 2 * i
            own_a, own_b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
            a[k : k + 2, k : k + 2] = own_a
            a[k : k + 2, :k] = np.outer(own_b, c[:k])
            b[k : k + 2] = own_b * feed
            c[:k] *= b0
            c[k] = 1.0
            feed *= b0
        self.a, self.b, self.c, self.d = a, b, c, feed
        observe, reach, row, col = np.zeros((SPAN, d)), np.zeros((d, SPAN)), c.copy(), b.copy()
        for i in range(SPAN):
            observe[i], reach[:, SPAN - 1 - i] = row, col
            row, col = row @ a, a @ col
        taps = np.concatenate([[feed], observe[:-1] @ b])
        lag = np.subtract.outer(np.arange(SPAN), np.arange(SPAN))
        self._response = np.where(lag >= 0, taps[np.abs(lag)], 0.0)
        self._observe, self._reach = observe, reach
        self._powers: dict[int, np.ndarray] = {}

    @property
    def size(self) -> int:
        return len(self.b)

    def power(self, n: int) -> np.ndarray:
        if n not in self._powers:
            self._powers[n] = np.linalg.matrix_power(self.a, int(n))
        return self._powers[n]

    def begin(self, channels: int, scale: np.ndarray | float = 1.0) -> np.ndarray:
        return np.outer(self.start, np.broadcast_to(scale, channels))

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filters ``(frames, channels)`` from ``state`` and returns output and end state."""
        y = np.empty_like(x, dtype=np.float64)
        for i in range(0, len(x), SPAN):
            piece = x[i : i + SPAN]
            m = len(piece)
            y[i : i + m] = self._response[:m, :m] @ piece + self._observe[:m] @ state
            state = self.power(m) @ state + self._reach[:, SPAN - m :] @ piece
        return y, state

    def end_state(self, x: np.ndarray) -> np.ndarray:
        """End state from a zero start, without computing the output."""
        state = np.zeros((self.size, x.shape[1]))
        for i in range(0, len(x), SPAN):
            piece = x[i : i + SPAN]
            state = self.power(len(piece)) @ state + self._reach[:, SPAN - len(piece) :] @ piece
        return state

    def both_ways(self, x: np.ndarray) -> np.ndarray:
        """Zero-phase: each chain forward and backward with odd padding at the ends."""
        for chain in self.chains:
            x = _chain(chain.tobytes(), chain.shape[0])._forward_backward(x)
        return x

    @property
    def pad(self) -> int:
        return 3 * (2 * len(self.sections) + 1)

    def _forward_backward(self, x: np.ndarray) -> np.ndarray:
        n = self.pad
        if len(x) <= n:
            raise ValueError(f"{len(x)} frames are too few for a padding of {n}")
        ends = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
        y, _ = self.run(ends, self.begin(x.shape[1], ends[0]))
        y, _ = self.run(y[::-1], self.begin(x.shape[1], y[-1]))
        return y[::-1][n:-n]


@lru_cache(maxsize=64)
def _chain(data: bytes, rows: int) -> LinearFilter:
    return LinearFilter([np.frombuffer(data).reshape(rows, 5).copy()])


@lru_cache(maxsize=64)
def mode_filter(mode: str, fs: float, notch: float | None = NOTCH_HZ, harmonics: bool = False) -> LinearFilter:
    """Band-pass of a mode and its notches; a mode the rate cannot carry becomes ``standard``."""
    low, high, order, floor = MODES.get(mode, MODES["standard"])
    if fs <= floor:
        low, high, order, _ = MODES["standard"]
    return band_filter(order, low, high, fs, notch, harmonics)


@lru_cache(maxsize=64)
def band_filter(
    order: int, low: float, high: float, fs: float, notch: float | None = None, harmonics: bool = False
) -> LinearFilter:
    chains = [bandpass_sections(order, low, high, fs)]
    if notch is not None and notch < fs / 2:
        chains += [notch_sections(notch * k, fs) for k in ((1, 2, 3) if harmonics else (1,)) if notch * k < fs / 2]
    return LinearFilter(chains)


@lru_cache(maxsize=64)
def low_filter(order: int, cut: float, fs: float) -> LinearFilter:
    return LinearFilter([lowpass_sections(order, cut, fs)])
