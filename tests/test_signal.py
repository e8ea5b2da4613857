"""Filters, quality and covariance features against plain numpy on small arrays."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from subvox.functions import kernels as k
from subvox.functions.design import band_filter, bandpass_sections, low_filter, lowpass_sections, mode_filter, notch_sections
from subvox.operators import blocks as bl
from subvox.operators import filtering as fl
from subvox.operators import quality as ql
from subvox.operators import signal as sg
from subvox.operators import spd
from subvox.plans import scan

FS = 1000.0


def response(sections, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections]))


def by_sample(flt, x, state):
    """The same chain one sample at a time, one section after the other."""
    s, out = state.copy(), np.zeros_like(x)
    for t in range(len(x)):
        v = x[t].copy()
        for i, (b0, b1, b2, a1, a2) in enumerate(flt.sections):
            o = b0 * v + s[2 * i]
            s[2 * i], s[2 * i + 1] = b1 * v - a1 * o + s[2 * i + 1], b2 * v - a2 * o
            v = o
        out[t] = v
    return out


@pytest.mark.parametrize("order,low,high,fs", [(4, 1, 50, 250), (4, 0.5, 8, 250), (4, 20, 450, 1000), (3, 80, 1000, 5000)])
def test_band_edges(order, low, high, fs):
    s = bandpass_sections(order, low, high, fs)
    assert len(s) == order
    for f in (low, high):
        assert 20 * np.log10(response(s, f, fs)) == pytest.approx(-3.0103, abs=1e-3)
    assert response(s, np.sqrt(low * high), fs) == pytest.approx(1, abs=1e-3)
    assert response(s, fs / 2 - 1e-9, fs) < 1e-6


def test_low_pass_and_notch():
    s = lowpass_sections(4, 5, 250)
    assert response(s, 0, 250) == pytest.approx(1) and 20 * np.log10(response(s, 5, 250)) == pytest.approx(-3.0103, abs=1e-3)
    n = notch_sections(60, 1000)
    assert response(n, 60, 1000) < 1e-9 and response(n, 50, 1000) > 0.98


def test_band_must_fit():
    with pytest.raises(ValueError):
        band_filter(4, 20, 450, 800.0)
    assert mode_filter("wide", 800.0).sections.shape == mode_filter("standard", 800.0).sections.shape


@given(n=some.integers(1, 900), cut=some.integers(1, 900), mode=some.sampled_from(["standard", "wide", "clinical"]))
@settings(max_examples=25, deadline=None)
def test_pieces_equal_the_whole(n, cut, mode):
    flt = mode_filter(mode, FS)
    x = np.random.default_rng(n).normal(size=(n, 2)) * 100
    whole, end = flt.run(x, flt.begin(2))
    cut = min(cut, n)
    a, mid = flt.run(x[:cut], flt.begin(2))
    b, last = flt.run(x[cut:], mid)
    np.testing.assert_allclose(np.vstack([a, b]), whole, atol=1e-6)
    np.testing.assert_allclose(last, end, rtol=1e-6, atol=1e-6)


def test_block_kernel_equals_sample_loop():
    flt = mode_filter("gowda", 5000.0, harmonics=True)
    x = np.random.default_rng(0).normal(size=(700, 3)) * 50 + 20
    np.testing.assert_allclose(flt.run(x, flt.begin(3))[0], by_sample(flt, x, flt.begin(3)), atol=1e-9)
    zero = np.zeros((flt.size, 3))
    np.testing.assert_allclose(flt.end_state(x), flt.run(x, zero)[1], atol=1e-12)


def test_zero_phase_keeps_peaks_in_place():
    t = np.arange(2000) / FS
    x = np.exp(-((t - 1) ** 2) / 0.0005)[:, None] * np.cos(2 * np.pi * 100 * (t - 1))[:, None]
    y = band_filter(4, 20, 450, FS).both_ways(x)
    assert abs(int(np.argmax(np.abs(y))) - 1000) <= 1
    np.testing.assert_allclose(y[::-1], band_filter(4, 20, 450, FS).both_ways(x[::-1]), atol=1e-3)


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(1)
    return {s: (rng.normal(size=(n, 3)) * 50 + [10, 0, -5]).astype(np.float32) for s, n in (("a", 3001), ("b", 700), ("c", 5120), ("d", 1100))}


@pytest.fixture(scope="module")
def samples(spark, signals):
    rows = [(s, i, [float(v) for v in r]) for s, x in signals.items() for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "session_id string, sample bigint, x array<double>").cache()


@pytest.fixture(scope="module")
def blocks(samples):
    facts = {"mode": F.lit("wide"), "fs_hz": F.lit(FS), "low_hz": F.lit(20.0), "high_hz": F.lit(450.0)}
    return bl.to_blocks(samples, 256).withColumns(facts).cache()


def arrays(df, width=3):
    out = {}
    for r in df.orderBy("session_id", "block").collect():
        out.setdefault(r.session_id, []).append(np.reshape(r.samples, (-1, width)))
    return {s: np.vstack(v) for s, v in out.items()}


def test_blocks_round_trip(blocks, samples, signals):
    for s, x in arrays(blocks).items():
        np.testing.assert_array_equal(x, signals[s])
    assert bl.samples_long(blocks).count() == samples.count()


@pytest.mark.parametrize("frames,run", [(256, 1024), (512, 2), (128, 3)])
def test_block_scan_equals_one_pass(samples, signals, frames, run, monkeypatch):
    monkeypatch.setattr(scan.carry_states, "__defaults__", (run,))
    b = bl.to_blocks(samples, frames).withColumn("mode", F.lit("wide")).withColumn("fs_hz", F.lit(FS))
    flt = mode_filter("wide", FS)
    for s, y in arrays(fl.bandpass_causal(b)).items():
        np.testing.assert_allclose(y, flt.run(signals[s].astype(float), flt.begin(3))[0], atol=1e-8)


def live_chain(x, gated):
    flt = mode_filter("wide", FS)
    state, mu, var, out = flt.begin(3), np.zeros(3), np.ones(3), []
    for i in range(0, len(x), 128):
        raw = x[i : i + 128].astype(float)
        y, state = flt.run(raw, state)
        mu = 0.99 * mu + 0.01 * y.mean(axis=0)
        var = 0.99 * var + 0.01 * ((y - mu) ** 2).mean(axis=0)
        y = (y - mu) / (np.sqrt(var) + 1e-6)
        out.append(y * 0.15 if gated and k.chunk_motion(raw, FS) >= 0.35 else y)
    return np.vstack(out)


@pytest.mark.parametrize("gated", [False, True])
def test_streaming_chain(blocks, signals, gated):
    for s, y in arrays(fl.preprocess_streaming(blocks, gated=gated)).items():
        np.testing.assert_allclose(y, live_chain(signals[s], gated), atol=1e-9)


def test_welch_over_blocks(blocks, samples, signals):
    lengths = samples.groupBy("session_id").agg(F.count("*").alias("n_samples"))
    got = {(r.session_id, r.channel): r.ratio for r in ql.welch_snr(blocks, lengths, (0.5, 20.0)).collect()}
    for s, x in signals.items():
        want = k.welch_ratio(x.astype(float), FS, (20.0, 450.0), (0.5, 20.0))
        np.testing.assert_allclose([got[s, c] for c in range(3)], want, rtol=1e-9)


def test_undefined_noise_band_is_null(blocks, samples):
    lengths = samples.groupBy("session_id").agg(F.count("*").alias("n_samples"))
    high = blocks.withColumn("fs_hz", F.lit(5000.0))
    assert all(r.snr_db is None for r in ql.welch_snr(high, lengths, (0.5, 5.0)).collect())


def test_motion(blocks, signals):
    got = {r.session_id: r for r in fl.motion_sessions(blocks).collect()}
    for s, x in signals.items():
        index, wander = k.motion(x.astype(float), FS)
        assert got[s].motion_index == pytest.approx(index.mean()) and got[s].baseline_wander == pytest.approx(wander.mean())


def test_snr_of_a_tone():
    t = np.arange(1000) / FS
    x = np.sin(2 * np.pi * 100 * t) + 0.1 * np.sin(2 * np.pi * 2 * t)
    assert 10 * np.log10(k.welch_ratio(x[:, None], FS, (20, 450), (0.5, 5)))[0] > 0
    assert k.welch_ratio(x[:0, None], FS, (20, 450), (0.5, 5)) is None
    drift = np.sin(2 * np.pi * 0.5 * np.arange(2000) / FS)[:, None]
    assert k.motion(drift, FS)[0][0] > 0.5


def test_cut_events(spark, blocks, signals):
    spans = spark.createDataFrame([("a", 1, 100, 2900), ("b", 2, 0, 700), ("c", 3, 5000, 5120), ("c", 4, 5100, 5105), ("a", 5, 7, 7)], "session_id string, event_id bigint, start_sample bigint, end_sample bigint")
    got = {r.event_id: r for r in bl.cut_events(blocks, spans, 256).collect()}
    assert set(got) == {1, 2, 3, 4}
    for r in got.values():
        np.testing.assert_array_equal(np.reshape(r.samples, (-1, 3)), signals[r.session_id][r.start_sample : r.end_sample])
    fixed = {r.event_id: r for r in bl.fixed_segments(bl.cut_events(blocks, spans, 256), FS, 500, 1).collect()}
    assert set(fixed) == {1, 2, 3} and all(len(r.samples) == 1500 for r in fixed.values())
    assert fixed[3].samples[-1] == 0.0


@pytest.fixture(scope="module")
def events(spark, blocks):
    spans = spark.createDataFrame([("a", 1, 100, 2900), ("b", 2, 0, 700), ("c", 3, 5000, 5120), ("c", 4, 5100, 5120)], "session_id string, event_id bigint, start_sample bigint, end_sample bigint")
    facts = {"mode": F.lit("wide"), "fs_hz": F.lit(FS), "low_hz": F.lit(20.0), "high_hz": F.lit(450.0)}
    return bl.cut_events(blocks, spans, 256).withColumns(facts).cache()


def test_short_events_are_reported_not_fatal(events):
    notes = {r.event_id: r.reject for r in fl.bandpass_zero_phase(events).collect()}
    assert notes[4] and not any(notes[i] for i in (1, 2, 3))


def test_quality_events(events, signals):
    for r in ql.quality_events(events, (0.5, 20.0)).collect():
        x = signals[r.session_id][r.start_sample : r.end_sample].astype(float)
        assert r.motion_index == pytest.approx(k.motion(x, FS)[0].mean())
        ratio = k.welch_ratio(x, FS, (20.0, 450.0), (0.5, 20.0))
        if ratio is not None and np.isfinite(ratio).all():
            assert r.snr_db == pytest.approx(10 * np.log10(ratio.mean()))


def test_features_agree_with_numpy(events, signals):
    cov = spd.spd_regularize(spd.window_cov(events, 100, 50))
    for r in cov.collect():
        x = signals[r.session_id][next(e.start_sample for e in events.collect() if e.event_id == r.event_id) :][r.frame * 50 : r.frame * 50 + 100].astype(float)
        want = k.upper(k.shrink(np.cov(x.T), 0.1))
        np.testing.assert_allclose(r.cov, want, rtol=1e-9)
    basis = spd.fit_basis(cov, ["session_id"], ["session_id", "event_id", "frame"])
    for r in basis.collect():
        q = np.reshape(r.q, (3, 3))
        np.testing.assert_allclose(q.T @ q, np.eye(3), atol=1e-9)
        assert (q[0] >= 0).all()
    steps = spd.append_deltas(spd.project_sigma(cov, basis, ["session_id"]), ["session_id", "event_id"], chunk=4)
    once = spd.sigma_sequences(events, basis, ["session_id"])
    a = {(r.event_id, r.frame): r.sigma for r in steps.collect()}
    b = {(r.event_id, r.frame): r.sigma for r in once.collect()}
    assert a and all(np.allclose(a[key], b[key], atol=1e-5) for key in a)
    assert b[4, 0] == [0.0] * 6  # an event without a full window


def test_basis_cap(events):
    cov = spd.window_cov(events, 100, 50)
    got = {r.session_id: r.n_matrices for r in spd.fit_basis(cov, ["session_id"], ["event_id", "frame"], cap=7).collect()}
    assert got == {"a": 7, "b": 7, "c": 1}


def test_augmented_copies(events):
    basis = spd.fit_basis(spd.window_cov(events, 100, 50), ["session_id"], ["event_id", "frame"])
    seq = spd.sigma_sequences(events, basis, ["session_id"])
    counted = seq.withColumn("n_rows", F.lit(55))
    one, two = (sorted(spd.augment_sigma(df, copies=2, seed=9).collect()) for df in (counted, counted.repartition(3)))
    assert one == two and len(one) == 2 * seq.count()


def test_moments(samples, signals):
    rows = sg.moments(samples.select("session_id", "x"), ["session_id"], 3, "x")
    corr = {r.session_id: r for r in sg.mean_abs_offdiag_corr(rows, ["session_id"]).collect()}
    for s, x in signals.items():
        want = np.abs(np.corrcoef(x.astype(float).T)[np.triu_indices(3, 1)]).mean()
        assert corr[s].corr_offdiag_mean == pytest.approx(want, rel=1e-6)


def test_low_filter_from_zero():
    flt = low_filter(2, 5.0, FS)
    x = np.ones((4000, 1))
    assert flt.run(x, np.zeros((flt.size, 1)))[0][-1, 0] == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize(("n", "win", "step"), [(1000, 100, 50), (999, 100, 30), (64, 8, 4), (50, 7, 3), (40, 40, 10), (30, 5, 9), (20, 6, 12), (9, 10, 5), (10, 1, 1), (0, 4, 2)])
@pytest.mark.parametrize("pane", [1, 32])
def test_windows_from_panes(monkeypatch, n, win, step, pane):
    """Covariances merged from panes, also far from zero, equal those of each window."""
    monkeypatch.setattr(k, "PANE", pane)
    x = np.random.default_rng(n).normal(size=(n, 3)).cumsum(0) + 1e6
    got = k.covariances(x, win, step)
    want = [np.cov(x[a : a + win].T) if win > 1 else np.zeros((3, 3)) for a in range(0, n - win + 1, step)]
    assert got.shape == (len(want), 3, 3)
    assert not want or np.allclose(got, want, rtol=1e-7, atol=1e-7)
