"""Recordings with lost, repeated and overlapping samples: blocks, filters, windows and live twins."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from subvox.catalog.intake import live_run
from subvox.functions.design import mode_filter
from subvox.functions import kernels as k
from subvox.operators import blocks as bl
from subvox.operators import filtering as fl
from subvox.operators import quality as ql
from subvox.plans import scan
from subvox.streaming import live

FS = 250.0


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(8)
    return {s: (rng.normal(size=(n, 2)) * 20 + 5).astype(np.float32) for s, n in (("hot", 4000), ("b", 900), ("c", 70))}


def held(s, n):
    """Samples that were not lost: a hole inside a block, holes over whole blocks, a lost beginning."""
    gone = {"hot": [(100, 110), (256, 512), (700, 1300), (3000, 3001)], "b": [(0, 5), (250, 262)], "c": []}[s]
    return np.array([i for i in range(n) if not any(a <= i < b for a, b in gone)])


@pytest.fixture(scope="module")
def blocks(spark, signals):
    rows = [(s, int(i), [float(v) for v in x[i]]) for s, x in signals.items() for i in held(s, len(x))]
    rows += rows[50:60]  # samples that came twice
    df = spark.createDataFrame(rows, "session_id string, sample bigint, x array<double>").repartition(5)
    return bl.to_blocks(df, 256).withColumn("mode", F.lit("standard")).withColumn("fs_hz", F.lit(FS)).cache()


def runs_of(places):
    return np.split(places, np.flatnonzero(np.diff(places) != 1) + 1)


def by_sample(df):
    """``{(session, sample): values}`` of block rows; each sample must be there once."""
    out = {}
    for r in df.collect():
        for i, v in enumerate(np.reshape(r.samples, (r.n_frames, -1))):
            key = (r.session_id, r.start_sample + i)
            assert key not in out
            out[key] = v
    return out


def test_a_row_per_contiguous_run(blocks, signals):
    got = by_sample(blocks)
    want = {(s, int(i)): x[i] for s, x in signals.items() for i in held(s, len(x))}
    assert got.keys() == want.keys() and all((got[key] == want[key]).all() for key in want)
    for r in blocks.collect():
        assert r.start_sample // 256 == r.block == (r.start_sample + r.n_frames - 1) // 256
    rows = blocks.where("session_id = 'hot'").orderBy("start_sample").collect()
    assert [(r.block, r.start_sample, r.n_frames) for r in rows[:4]] == [(0, 0, 100), (0, 110, 146), (2, 512, 188), (5, 1300, 236)]


def test_conflicting_chunks(spark):
    """Any mixture of cut, repeated and overlapping chunks: the earlier start wins, then the longer chunk, then the smaller samples."""
    rng = random.Random(4)
    chunks = [("s", a := rng.randint(0, 400), n := rng.randint(0, 40), 1, [float(rng.randint(0, 9)) for _ in range(n)]) for _ in range(40)]
    chunks += chunks[:5] + [("t", 3, 2, 1, [1.0, 2.0]), ("t", 3, 2, 1, [1.0, 1.0]), ("t", 3, 3, 1, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(chunks, "session_id string, sample_index bigint, n_frames int, channels int, samples array<float>").repartition(4)
    want = {}
    for s, a, n, _, x in sorted(chunks, key=lambda c: (c[0], c[1], -c[2], c[4])):
        for i, v in enumerate(x):
            want.setdefault((s, a + i), v)
    for parts in (1, 4):
        got = {key: float(v[0]) for key, v in by_sample(bl.assemble_recordings(df.repartition(parts), 64)).items()}
        assert got == want


@pytest.mark.parametrize("run", [1, 2, 1024])
@pytest.mark.parametrize("on_gap", ["reset", "carry"])
def test_filter(blocks, signals, on_gap, run, monkeypatch):
    monkeypatch.setattr(scan.carry_states, "__defaults__", (run,))
    got, flt = by_sample(fl.bandpass_causal(blocks, on_gap=on_gap)), mode_filter("standard", FS)
    for s, x in signals.items():
        places = held(s, len(x))
        for part in runs_of(places) if on_gap == "reset" else [places]:
            want = flt.run(x[part].astype(float), flt.begin(2))[0]
            np.testing.assert_allclose([got[s, int(i)] for i in part], want, atol=1e-8)


def test_unknown_choice(blocks):
    with pytest.raises(ValueError, match="on_gap"):
        fl.bandpass_causal(blocks, on_gap="skip")
    with pytest.raises(ValueError, match="on_gap"):
        bl.cut_events(blocks, blocks.select("session_id"), 256, on_gap="skip")


@pytest.mark.parametrize("on_gap", ["reset", "carry"])
def test_live_chain_equals_batch(spark, blocks, on_gap):
    out = live_run(spark, blocks, "session_id", "block", lambda b: live.stream_preprocess(b, gated=True, on_gap=on_gap), slices=4)
    got, want = by_sample(out), by_sample(fl.preprocess_streaming(blocks, gated=True, on_gap=on_gap))
    assert got.keys() == want.keys()
    for key in want:
        np.testing.assert_allclose(got[key], want[key], atol=1e-9)


def test_reset_and_carry_differ_only_behind_gaps(blocks):
    a, b = (by_sample(fl.preprocess_streaming(blocks, on_gap=g)) for g in ("reset", "carry"))
    same = {key for key in a if np.allclose(a[key], b[key], atol=1e-12)}
    assert {i for s, i in same if s == "hot"} >= set(range(100)) and {i for s, i in same if s == "c"} == set(range(70))
    assert sum(s == "hot" for s, _ in same) < 200


def test_repeated_and_late_blocks_are_not_used_twice(spark, blocks):
    twice = blocks.unionByName(blocks.where("block = 2").withColumn("block", F.lit(6).cast("long")))
    for build in (lambda b: live.stream_preprocess(b), lambda b: live.stream_windows(b)):
        once, again = (live_run(spark, b, "session_id", "block", build, slices=3).drop("block") for b in (blocks, twice))
        assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


@pytest.mark.parametrize("on_gap", ["reset", "carry"])
def test_live_windows(spark, blocks, signals, on_gap):
    out = live_run(spark, blocks, "session_id", "block", lambda b: live.stream_windows(b, window_ms=200, stride_ms=80, on_gap=on_gap), slices=3)
    got = {(r.session_id, r.win_end): np.reshape(r.samples, (-1, 2)) for r in out.collect()}
    want = {}
    for s, x in signals.items():
        places = held(s, len(x))
        for part in runs_of(places) if on_gap == "reset" else [places]:
            for end in range(50, len(part) + 1, 20):
                want[s, int(part[end - 1]) + 1] = x[part[end - 50 : end]]
    assert got.keys() == want.keys() and out.count() == len(want)
    for key in want:
        np.testing.assert_array_equal(got[key], want[key])
    for s in signals:
        assert sorted(r.step for r in out.where(F.col("session_id") == s).collect()) == list(range(sum(key[0] == s for key in want)))


def test_live_quality(spark, blocks):
    out = live_run(spark, blocks, "session_id", "block", lambda b: live.stream_quality(b, (20, 100), (0.5, 20), on_gap="reset"), slices=3)
    rows = out.where("session_id = 'hot'").orderBy("win_end").collect()
    assert [(r.win_end, r.n_frames) for r in rows[:4]] == [(100, 100), (256, 146), (700, 188), (1536, 236)] and rows[4].n_frames == 492


def test_live_decode_is_told_of_gaps(spark, blocks):
    def level(window):
        return ("up" if window.mean() >= 0 else "down"), 1.0, False

    out = live_run(spark, blocks, "session_id", "block", lambda b: live.stream_decode(b, level, window_ms=200, stride_ms=80, on_gap="reset"), slices=3)
    ends = {int(part[e - 1]) + 1 for part in runs_of(held("hot", 4000)) for e in range(50, len(part) + 1, 20)}
    got = [round(r.t * FS) for r in out.where("session_id = 'hot'").collect()]
    assert got and set(got) <= ends


def test_events(spark, blocks, signals):
    spans = [("hot", 1, 50, 90, "w"), ("hot", 2, 90, 120, "w"), ("hot", 3, 250, 600, "v"), ("hot", 4, 800, 900, "v"), ("hot", 5, 3990, 4010, "v"), ("b", 1, 0, 20, "w")]
    df = spark.createDataFrame(spans, "session_id string, event_id bigint, start_sample bigint, end_sample bigint, label string")
    cut = {g: {(r.session_id, r.event_id, r.run if g == "split" else 1): r for r in bl.cut_events(blocks, df, 256, on_gap=g).collect()} for g in ("join", "fill", "drop", "split")}
    for s, e, a, b, label in spans:
        x, places = signals[s], [i for i in held(s, len(signals[s])) if a <= i < b]
        if not places:
            assert all((s, e, 1) not in c for c in cut.values())
            continue
        np.testing.assert_array_equal(np.reshape(cut["join"][s, e, 1].samples, (-1, 2)), x[places])
        full = np.zeros((b - a, 2), np.float32)
        full[np.array(places) - a] = x[places]
        row = cut["fill"][s, e, 1]
        np.testing.assert_array_equal(np.reshape(row.samples, (-1, 2)), full)
        assert (row.n_frames, row.lost, row.label) == (b - a, b - a - len(places), label)
        assert ((s, e, 1) in cut["drop"]) == (len(places) == b - a)
        for i, part in enumerate(runs_of(np.array(places)), 1):
            row = cut["split"][s, e, i]
            assert (row.start_sample, row.end_sample, row.n_frames, row.lost) == (part[0], part[-1] + 1, len(part), b - a - len(places))
            np.testing.assert_array_equal(np.reshape(row.samples, (-1, 2)), x[part])
    assert len(cut["split"]) == 7


def test_welch_does_not_cross_gaps(blocks, signals):
    """Segments lie inside runs: the mean over those of the rows and of borders at which two rows meet."""
    b = blocks.where("session_id = 'hot'").withColumn("low_hz", F.lit(20.0)).withColumn("high_hz", F.lit(100.0))
    lengths = b.groupBy("session_id").agg(F.sum("n_frames").alias("n_samples"))
    got = ql.welch_snr(b, lengths, (0.5, 20.0)).orderBy("channel").collect()
    x, segments = signals["hot"].astype(float), []
    for r in b.collect():
        if r.n_frames == 256:
            segments.append(x[r.start_sample : r.start_sample + 256])
    ends = {r.start_sample + r.n_frames for r in b.collect() if r.n_frames % 128 == 0}
    heads = {r.start_sample for r in b.collect() if r.n_frames >= 128}
    segments += [x[p - 128 : p + 128] for p in ends & heads]
    psd = k.segment_power(np.stack(segments), FS).mean(axis=0)
    f = np.fft.rfftfreq(256, 1 / FS)
    want = psd[(f >= 20) & (f <= 100)].mean(axis=0) / psd[(f >= 0.5) & (f <= 20)].mean(axis=0)
    np.testing.assert_allclose([r.ratio for r in got], want, rtol=1e-9)


def test_summary_counts_blocks_not_runs(blocks):
    r = bl.recording_summary(blocks, FS).where("session_id = 'hot'").first()
    assert (r.n_samples, r.end_sample, r.n_blocks) == (len(held("hot", 4000)), 4000, blocks.where("session_id = 'hot'").select("block").distinct().count())
