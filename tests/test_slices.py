"""Work in slices: memory of a task follows the slice, and the number of partitions the rows."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pytest

from subvox.catalog.intake import live_run
from subvox.functions import kernels as k
from subvox.operators import spd
from subvox.operators import splits as sp
from subvox.plans import ordered
from subvox.sources import packets
from subvox.streaming import live


def matrices(n, c, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, c, 3 * c))
    return x @ np.swapaxes(x, 1, 2) / (3 * c)


def test_logarithms_unfold_few_matrices_at_once():
    """The arrays of a slice stay small, however many matrices an Arrow batch has."""
    assert spd.SLICE * 64 * 64 * 8 <= 4 << 20


def test_logarithms_over_slices(spark):
    covs = [m for ms in zip(matrices(150, 4), matrices(150, 3)) for m in ms]
    rows = [(i % 2, i, k.upper(m).tolist()) for i, m in enumerate(covs)]
    one = spark.createDataFrame(rows, "s long, frame long, cov array<double>").coalesce(1)
    got = {r.s: (r.mean_log, r.n_matrices) for r in spd.log_euclidean_mean(one, ["s"]).collect()}
    for s in (0, 1):
        mine = np.array([k.log_spd(covs[i], spd.SPD_ETA) for i in range(s, 300, 2)])
        assert got[s][1] == len(mine)
        np.testing.assert_allclose(got[s][0], k.upper(mine.mean(axis=0)), atol=1e-10)


@pytest.mark.parametrize("mode", ["diag", "upper_tri", "full"])
def test_projection_of_mixed_bases(spark, mode):
    covs = {s: matrices(70, c, c) for s, c in (("a", 3), ("b", 4), ("c", 4))}
    rows = [(s, i, k.upper(m).tolist()) for s, ms in covs.items() for i, m in enumerate(ms)]
    basis = {s: np.linalg.qr(ms[0])[0] for s, ms in covs.items()}
    df = spark.createDataFrame(rows, "s string, frame long, cov array<double>").orderBy("frame").coalesce(1)
    q = spark.createDataFrame([(s, b.ravel().tolist()) for s, b in basis.items()], "s string, q array<double>")
    got = spd.project_sigma(df, q, ["s"], mode).collect()
    assert len(got) == 210
    for r in got:
        np.testing.assert_allclose(r.sigma, k.project(covs[r.s][r.frame][None], basis[r.s], mode)[0], rtol=1e-5, atol=1e-6)


def test_packets_of_any_kind_in_one_batch(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data, want = [], {}
    for i in range(300):
        frames, channels = int(rng.integers(0, 6)), int(rng.integers(1, 5))
        counts = rng.integers(-32768, 32768, (frames, channels))
        magic, version = b"OA" if i % 5 else b"ZZ", 1 if i % 7 else 3
        p = struct.pack("<2sBBHHIQ", magic, version, channels, frames, i % 3, i, 2**40 + i) + counts.astype("<i2").tobytes()
        p = p[: len(p) - i % 4] if i % 11 else p[:19]
        due = 20 + frames * channels * 2
        reason = (
            "payload too short" if len(p) < 20 else "bad magic" if magic != b"OA" else f"unsupported version {version}" if version != 1
            else "no frames" if not frames else f"length mismatch: {len(p)} bytes, expected {due}" if len(p) != due else None
        )
        data.append(("d", i, p))
        want[i] = (None,) * 6 + (reason,) if reason else (channels, frames, i % 3, i, 2**40 + i, counts.ravel(), None)
    monkeypatch.setattr(packets, "BYTES_AT_ONCE", 1500)
    df = spark.createDataFrame(data, "device_id string, arrival_no long, payload binary").coalesce(1)
    got = packets.decode_packets(df).collect()
    assert len(got) == 300
    scale = packets.microvolts_per_count(16, 2.4, 24.0)
    for r in got:
        w = want[r.arrival_no]
        assert (r.channels, r.n_frames, r.flags, r.seq, r.sample_index, r.reject) == (*w[:5], w[6])
        assert (r.samples is None) == (w[5] is None)
        if w[5] is not None:
            np.testing.assert_array_equal(np.array(r.samples, np.float32), w[5].astype(np.float32) * np.float32(scale))


def test_raw_packets(spark):
    rows = [("d", 0, b""), ("d", 1, b"abc"), ("d", 2, np.array([1, -2, 3, -4], "<i2").tobytes())]
    got = packets.decode_packets(spark.createDataFrame(rows, "device_id string, arrival_no int, payload binary"), raw_channels=2).orderBy("arrival_no").collect()
    assert [(r.n_frames, r.channels, r.seq) for r in got] == [(0, 2, None), (None, None, None), (2, 2, None)]
    assert got[0].samples == [] and got[1].reject == "3 bytes do not hold whole frames" and np.sign(got[2].samples).tolist() == [1, -1, 1, -1]


def test_live_table_is_worked_out_once_and_gaps_hold(spark):
    worked = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(5)
    rows = [(d, n, int(rng.integers(0, 10_000)), int(rng.integers(1, 50))) for d in range(7) for n in range(40)]

    def count(batches):
        for pdf in batches:
            worked.add(len(pdf))
            yield pdf

    schema = "device_id long, arrival_no long, sample_index long, frames long"
    df = spark.createDataFrame(rows, schema).mapInPandas(count, schema)
    got = {(r.device_id, r.arrival_no): (r.lost, r.lost_total) for r in live_run(spark, df, "device_id", "arrival_no", live.stream_gaps).collect()}
    assert worked.value == len(rows)
    for d in range(7):
        due, total = None, 0
        for _, n, index, frames in (r for r in rows if r[0] == d):
            lost = 0 if due is None else max(0, index - due)
            due, total = index + frames, total + lost
            assert got[d, n] == (lost, total)


def test_partitions_grow_with_rows(spark, monkeypatch):
    """Twice the rows are dealt to twice the tasks."""
    df = spark.range(4000).selectExpr("id % 500 as trial_id", "id as word_idx", "cast(id % 3 as string) as label")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ordered.dealt(df, ["trial_id"], few * ordered.ROWS_PER_TASK).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    assert ordered.dealt(df, ["trial_id"], 4000, 100).rdd.getNumPartitions() == 40
    plain = {(r.trial_id, r.word_idx): r.split for r in sp.split_grouped(df, ["trial_id"], 0.2, 7).collect()}
    monkeypatch.setattr(sp, "dealt", lambda df, keys, rows: ordered.dealt(df, keys, rows, 100))
    out = sp.split_grouped(df, ["trial_id"], 0.2, 7)
    assert {(r.trial_id, r.word_idx): r.split for r in out.collect()} == plain and len(plain) == 4000


def test_positions_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 100)
    rows = pd.DataFrame({"g": np.arange(3000) % 7, "x": np.random.default_rng(1).permutation(3000)})
    df = spark.createDataFrame(rows)
    out = ordered.add_position(df, ["g"], ["x"], on=df["x"], rows_per_bucket=500).toPandas().sort_values(["g", "x"])
    assert (out["pos"].to_numpy() == out.groupby("g").cumcount().to_numpy()).all()
