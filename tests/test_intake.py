"""Reading and writing recordings, packets, profiles and finished work; live operators."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subvox.catalog.intake import live_run, loudness_scorer
from subvox.functions.design import mode_filter
from subvox.operators import blocks as bl
from subvox.operators import filtering as fl
from subvox.operators import monitor as mon
from subvox.sources import files, packets, state
from subvox.streaming import live


def session_folder(root, name, x, events, fs=250):
    folder = root / name
    folder.mkdir()
    np.save(folder / "signals.npy", x)
    pd.DataFrame(events).to_csv(folder / "events.csv", index=False)
    (folder / "meta.json").write_text(json.dumps({"fs_hz": fs, "channels": x.shape[1], "split_mode": "m" if name == "a" else ""}))


def test_session_folders(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = {n: rng.normal(size=(s, 4)).astype(np.float32) for n, s in (("a", 1000), ("b", 4000))}
    session_folder(tmp_path, "a", data["a"], {"start_sample": [100, 1200], "end_sample": [900, 2200], "label": ["a", "b"]})
    session_folder(tmp_path, "b", data["b"], {"start_sample": [5], "end_sample": [9], "label": ["c"], "trial_id": [3], "word_idx": [1]})
    sessions, blocks, events = files.read_sessions(spark, str(tmp_path))
    assert {(r.session_id, r.fs_hz, r.split_mode) for r in sessions.collect()} == {("a", 250.0, "m"), ("b", 250.0, "")}
    for name, x in data.items():
        got = np.vstack([np.reshape(r.samples, (-1, 4)) for r in blocks.where(F.col("session_id") == name).orderBy("block").collect()])
        np.testing.assert_array_equal(got, x)
    assert {(r.session_id, r.event_id, r.trial_id) for r in events.collect()} == {("a", 0, None), ("a", 1, None), ("b", 0, 3)}
    pd.DataFrame({"start_sample": [100, 150], "end_sample": [150, 300], "phone": ["N", "OW"], "word": ["null", "null"]}).to_csv(tmp_path / "a" / "phonemes.csv", index=False)
    pd.DataFrame({"start_sample": [5], "end_sample": [9], "phone": ["AH"]}).to_csv(tmp_path / "b" / "phonemes.csv", index=False)
    phones = {tuple(r) for r in files.read_phones(spark, str(tmp_path)).collect()}
    assert phones == {("a", 0, 100, 150, "N", "null"), ("a", 1, 150, 300, "OW", "null"), ("b", 0, 5, 9, "AH", None)}
    files.write_tables(blocks, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == blocks.count()


@pytest.mark.parametrize("n,bounds", [(45_000, [10_000, 10_000, 10_000, 15_000]), (400, [100] * 4)])
def test_trial_cube(spark, tmp_path, n, bounds):
    x = np.random.default_rng(1).normal(size=(2, 8, n))
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", np.array([["Mon day", "b", "c", "d"]] * 2))
    blocks, events = files.read_trial_cube(spark, str(tmp_path / "x.npy"), str(tmp_path / "y.npy"), fs_hz=1000.0)
    got = sorted((r.session_id, r.word_idx, r.end_sample - r.start_sample, r.label) for r in events.collect())
    assert [g[2] for g in got[:4]] == bounds and got[0][3] == "mon_day"
    first = np.vstack([np.reshape(r.samples, (-1, 8)) for r in blocks.where("session_id = '0'").orderBy("block").collect()])
    want = (x[0].T - x[0].mean(axis=1)) / (x[0].std(axis=1) + 1e-8)
    np.testing.assert_allclose(first, want, atol=1e-4)


def test_paired_recordings(spark, tmp_path):
    for i, (index, shape) in enumerate([(0, (800, 8)), (-1, (800, 8)), (3, (20, 8)), (4, (800, 4))]):
        np.save(tmp_path / f"{i}_emg.npy", np.ones(shape))
        (tmp_path / f"{i}_info.json").write_text(json.dumps({"text": "Hello there", "sentence_index": index, "silent": True}))
    blocks, events = files.read_paired_recordings(spark, str(tmp_path))
    assert [(r.session_id, r.label, r.end_sample) for r in events.collect()] == [("0", "hello", 800)]
    assert blocks.agg(F.sum("n_frames")).first()[0] == 800


def test_segment_set(spark, tmp_path):
    np.save(tmp_path / "Good Morning.npy", np.ones((100, 3)))
    np.save(tmp_path / "short.npy", np.ones((5, 3)))
    _, events = files.read_segment_set(spark, str(tmp_path))
    assert [(r.label, r.end_sample) for r in events.collect()] == [("good_morning", 100)]


def pack(frames, seq=123, index=1000, magic=b"OA", version=1):
    return struct.pack("<2sBBHHIQ", magic, version, frames.shape[1], len(frames), 0, seq, index) + frames.astype("<i2").tobytes()


def test_packets(spark):
    counts = np.arange(96).reshape(12, 8) - 40
    bad = [b"OA", pack(counts, magic=b"ZZ"), pack(counts, version=9), pack(counts)[:-1], pack(counts[:0])]
    data = [("d", i, p) for i, p in enumerate([pack(counts), *bad])]
    got = packets.decode_packets(spark.createDataFrame(data, "device_id string, arrival_no long, payload binary")).orderBy("arrival_no").collect()
    assert got[0].reject is None and (got[0].seq, got[0].sample_index, got[0].n_frames, got[0].channels) == (123, 1000, 12, 8)
    np.testing.assert_allclose(np.array(got[0].samples) / (2.4 / 24 / 32767 * 1e6), counts.ravel(), atol=1e-3)
    assert all(r.reject and r.samples is None for r in got[1:])
    raw = packets.decode_packets(spark.createDataFrame([("d", 0, counts.astype("<i2").tobytes())], "device_id string, arrival_no long, payload binary"), raw_channels=8)
    assert raw.first().n_frames == 12


def test_messages(spark):
    df = spark.createDataFrame([("yes", 0.9, 1), ("no", 1.5, 2)], "token string, confidence double, seq int")
    got = [json.loads(r.value) for r in packets.token_messages(df, source="sim").collect()]
    assert got == [{"type": "token", "token": "yes", "confidence": 0.9, "seq": 1, "source": "sim"}]


def test_profiles(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [("u", 1, 0.7), ("u", 2, 0.8), ("v", 1, 0.6)]
    df = spark.createDataFrame(rows, "user_id string, n int, confidence_threshold double").select(
        "user_id", F.timestamp_seconds("n").alias("updated"), "confidence_threshold", F.lit(False).alias("deleted")
    )
    state.save_profiles(df, path)
    assert {(r.user_id, r.confidence_threshold) for r in state.load_profiles(spark, path).collect()} == {("u", 0.8), ("v", 0.6)}
    state.delete_profiles(spark, ["v"], path)
    assert [r.user_id for r in state.load_profiles(spark, path).collect()] == ["u"]


def test_only_changed_sources_run(spark, tmp_path):
    path, seen = str(tmp_path / "m"), []

    def stage(df):
        seen.append(sorted(r.session_id for r in df.collect()))
        return df.withColumn("y", F.lit(len(seen)))

    src = lambda *f: spark.createDataFrame([(s, p) for s, p in zip("ab", f)], "session_id string, fingerprint string")
    assert state.materialize(spark, src("1", "1"), stage, path, "c") == 2
    assert state.materialize(spark, src("1", "1"), stage, path, "c") == 0
    assert state.materialize(spark, src("1", "2"), stage, path, "c") == 1
    assert state.materialize(spark, src("1", "2"), stage, path, "other") == 2
    assert seen == [["a", "b"], ["b"], ["a", "b"]]
    assert spark.read.parquet(f"{path}/data").count() == 2


# --- live operators equal their batch twins ------------------------------------------------------


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, [float(v) for v in rng.normal(size=2) * 20 + 5]) for s, n in (("a", 1500), ("b", 700)) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id string, sample bigint, x array<double>")
    return bl.to_blocks(df, 256).withColumn("mode", F.lit("standard")).withColumn("fs_hz", F.lit(250.0)).cache()


def test_live_preprocess(spark, blocks):
    out = live_run(spark, blocks, "session_id", "block", live.stream_preprocess, slices=4)
    got = {(r.session_id, r.block): r.samples for r in out.collect()}
    want = {(r.session_id, r.block): r.samples for r in fl.preprocess_streaming(blocks).collect()}
    assert got.keys() == want.keys()
    for key in want:
        np.testing.assert_allclose(got[key], want[key], atol=1e-9)


def test_live_windows_are_aligned(spark, blocks):
    out = live_run(spark, blocks, "session_id", "block", lambda s: live.stream_windows(s, window_ms=600, stride_ms=120), slices=3)
    x = np.vstack([np.reshape(r.samples, (-1, 2)) for r in blocks.where("session_id = 'a'").orderBy("block").collect()])
    got = out.where("session_id = 'a'").orderBy("step").collect()
    assert [r.win_end for r in got] == list(range(150, 1501, 30))
    for r in got:
        np.testing.assert_array_equal(np.reshape(r.samples, (-1, 2)), x[r.win_end - 150 : r.win_end])


def test_live_quality_uses_the_trailing_window(spark, blocks):
    out = live_run(spark, blocks, "session_id", "block", lambda s: live.stream_quality(s, (20, 100), (0.5, 20)), slices=2).where("session_id = 'a'").orderBy("block").collect()
    assert [r.n_frames for r in out] == [256, 500, 500, 500, 500, 500] and all(r.snr_db is not None for r in out)


def test_live_tokens(spark):
    rng = np.random.default_rng(5)
    data = [(f"s{i % 3}", i // 3, i / 30, "ab"[int(rng.random() > 0.7)], float(rng.uniform(0.5, 1)), float(rng.uniform(5, 25)), bool(rng.random() < 0.05)) for i in range(600)]
    df = spark.createDataFrame(data, "session_id string, step long, t double, token string, confidence double, snr_db double, abstain boolean")
    cfg = mon.GateConfig(stable_n=2, adaptive=True, baseline_snr_db=20.0)
    got = live_run(spark, df, "session_id", "step", lambda s: live.stream_tokens(s, cfg), slices=5)
    assert sorted(got.collect()) == sorted(mon.stabilize_tokens(df, cfg).collect()) and got.count() > 5


def test_live_utterances(spark):
    chunk = [("s", i, "chunk", 1, [float(i)] * 50) for i in range(30)]
    control = [("s", 10, "start", 1, []), ("s", 12, "end", 1, []), ("s", 20, "start", 1, []), ("s", 21, "end", 1, [])]
    df = spark.createDataFrame(chunk + control, "session_id string, seq long, kind string, channels int, samples array<double>")
    got = live_run(spark, df, "session_id", "seq", lambda s: live.stream_utterances(s, 1000.0), slices=3).orderBy("utterance").collect()
    assert [(r.utterance, r.n_frames, r.samples[0]) for r in got] == [(1, 500, 2.0), (2, 450, 12.0)]


def test_live_decode(spark, blocks):
    cfg = mon.GateConfig(stable_n=2)
    got = live_run(spark, blocks, "session_id", "block", lambda s: live.stream_decode(s, loudness_scorer, cfg=cfg), slices=3)
    chain = fl.preprocess_streaming(blocks)
    want = []
    for sid in ("a", "b"):
        y = np.vstack([np.reshape(r.samples, (-1, 2)) for r in chain.where(F.col("session_id") == sid).orderBy("block").collect()])
        run = []
        for i, end in enumerate(range(150, len(y) + 1, 30)):
            token, conf, abstain = loudness_scorer(y[end - 150 : end])
            run = [] if abstain else [*run, (token, conf)][-2:]
            calm = not want or want[-1][0] != sid or want[-1][2] != token or (i - want[-1][1]) * 30 / 250.0 >= 0.25
            if len(run) == 2 and run[0][0] == token and np.mean([c for _, c in run]) >= 0.7 and calm:
                want.append((sid, i, token))
    assert sorted((r.session_id, r.step, r.token) for r in got.collect()) == want


def test_filter_is_shared():
    assert mode_filter("standard", 250.0) is mode_filter("standard", 250.0)


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    for i, folder in enumerate("ab"):
        (tmp_path / folder).mkdir()
        np.save(tmp_path / folder / "0_emg.npy", np.full((40, 8), i, np.float32))
        (tmp_path / folder / "0_info.json").write_text('{"text": "hi", "sentence_index": 0}')
    blocks, events = files.read_paired_recordings(spark, str(tmp_path))
    assert sorted(r.session_id for r in events.collect()) == ["a/0", "b/0"]
    assert blocks.groupBy("session_id", "block").count().where("count > 1").count() == 0
    _, events = files.read_segment_set(spark, str(tmp_path))
    assert sorted((r.session_id, r.label) for r in events.collect()) == [("a/0_emg", "0_emg"), ("b/0_emg", "0_emg")]


def test_going_back_to_an_earlier_fingerprint_runs_again(spark, tmp_path):
    def run(mark):
        source = spark.createDataFrame([("a", mark)], "session_id string, fingerprint string")
        return state.materialize(spark, source, lambda s: s.withColumn("made", F.lit(mark)), str(tmp_path / "out"), "c")

    assert [run("1"), run("2"), run("2"), run("1")] == [1, 1, 0, 1]
    assert [str(r.made) for r in spark.read.parquet(str(tmp_path / "out/data")).collect()] == ["1"]
