"""Machines over sessions cut into chunks: same answers as one pass, and a hot session on many tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from subvox.functions.recurrence import Clamped, Jumps, Smoothing, TokenGate, Recalibration, smoothed, spaced
from subvox.operators import monitor as mon
from subvox.plans.machines import Stage, chunked

values = st.floats(-5, 5, allow_nan=False, width=16)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(values, st.just(float("nan"))), max_size=12), st.one_of(values, st.just(float("nan"))))
def test_smoothing(xs, before):
    got, want = Smoothing.of(np.array(xs, float), 0.3)(before), smoothed(xs, 0.3, before)[-1]
    assert (got != got) == (want != want) and (got != got or abs(got - want) < 1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 2, width=16), values, values, values), max_size=10), values)
def test_clamped_steps_compose(steps, x):
    made, want = Clamped(), x
    for scale, shift, a, b in steps:
        low, high = sorted((a, b))
        made, want = made.then(scale, shift, low, high), min(high, max(low, scale * want + shift))
    assert abs(made(x) - want) < 1e-6


def test_clamped_step_without_scale():
    assert Clamped().then(0.0, 1.0, 0.0, 1.0)(5.0) == 1.0
    assert Clamped().then(2.0, 1.0, 0.0, 4.0).then(0.0, 3.0, 0.0, 5.0)(7.0) == 3.0


def walked(t, names, gap, last):
    for name, now in zip(names, t):
        if name != last[0] or now - last[1] >= gap:
            last = (name, now)
    return last


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), max_size=25), st.booleans(), st.sampled_from([0.1, 3, 7]), st.sampled_from([None, "a", "b"]), st.integers(-9, 30))
def test_jumps(rows, in_order, gap, name, before):
    """The table gives what a walk over all rows gives, for any last one up to the latest time before; also if times go back."""
    t = np.array([x for _, x in rows], float) * 0.1 + (before if in_order else 0)
    t = np.sort(t) if in_order else t
    names = np.array([n for n, _ in rows], object)
    for last in ((name, float(before)), (name, before - 2.5), (None, -np.inf)):
        assert Jumps(t, gap, float(before), names)(last) == walked(t, names, gap, last)
    one = Jumps(t, gap, float(before))((0, float(before)))
    assert one[1] == spaced(t, gap, float(before))[1]


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(11)
    sizes = {"hot": 1200, None: 300, **{f"s{i}": 50 for i in range(6)}}
    rows = []
    for s, n in sizes.items():
        t = np.cumsum(rng.choice([0.0, 0.02, 0.05, 0.4], n))
        snr = rng.uniform(5, 25, n)
        rows += [
            (s, i, float(t[i]), ["a", "b", "_"][int(rng.random() * 2.3)], float(rng.uniform(0.4, 1)), None if rng.random() < 0.2 else float(snr[i]), bool(rng.random() < 0.04), float(rng.uniform(0, 0.5)), 20.0)
            for i in range(n)
        ]
    schema = "session_id string, step long, t double, token string, confidence double, snr_db double, abstain boolean, motion_index double, baseline double"
    return spark.createDataFrame(rows, schema).repartition(6).cache()


def tables(frame, order):
    pdf = frame.toPandas()
    pdf["session_id"] = pdf["session_id"].fillna("null")
    return pdf.sort_values(["session_id", order], kind="stable").reset_index(drop=True)


def in_one_pass(predictions, order, make):
    parts = []
    for s, pdf in tables(predictions, order).groupby("session_id", sort=True):
        parts.append(make()(pdf))
    return pd.concat(parts).reset_index(drop=True)


def equal(got, want, columns):
    assert len(got) == len(want) > 0
    for c in columns:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9)
        else:
            assert got[c].tolist() == want[c].tolist()


@pytest.mark.parametrize("chunk", [1, 40])
@pytest.mark.parametrize("cfg", [mon.GateConfig(stable_n=2), mon.GateConfig(stable_n=3, adaptive=True, cooldown_ms=900, baseline_snr_db=20.0), mon.GateConfig(stable_n=1, blank="_", cooldown_ms=60_000)], ids=["plain", "adaptive", "slow"])
def test_tokens(predictions, cfg, chunk):
    if chunk == 1 and not cfg.adaptive:
        pytest.skip("one row per chunk is covered by the other one")
    cols = ["session_id", "step", "t", "token", "confidence", "snr_db", "abstain"]
    got = tables(mon.stabilize_tokens(predictions, cfg, chunk=chunk), "step")
    want = in_one_pass(predictions.select(*cols), "step", lambda: TokenGate(cfg).events)
    equal(got, want, ["session_id", "step", "t", "token", "confidence", "gate"])


@pytest.mark.parametrize("chunk", [40, 65_536])
@pytest.mark.parametrize("cfg", [mon.RecalConfig(), mon.RecalConfig(cooldown_s=1.5, warn_db=5.0, streak=2)], ids=["usual", "quick"])
def test_recalibration(predictions, cfg, chunk):
    readings = predictions.select("session_id", F.col("step").alias("seq"), "t", "snr_db", "motion_index", "baseline")
    got = tables(mon.recalibration_monitor(readings, cfg, chunk=chunk), "seq")
    want = in_one_pass(readings, "seq", lambda: Recalibration(cfg).status)
    assert want["broadcast"].sum() > 2
    equal(got, want, ["session_id", "seq", "snr_ema", "snr_deficit_db", "low_streak", "suggested", "broadcast", "reasons"])


@pytest.mark.parametrize("gap,intervals", [(0.06, 100), (1.0, 3), (30.0, 1), (0.0, 1)])
def test_throttle(predictions, gap, intervals):
    events = predictions.select("session_id", F.when(F.col("step") % 97 != 0, F.col("t")).alias("t"))
    got = tables(mon.throttle(events, ["session_id"], gap, intervals=intervals), "t")
    want = in_one_pass(events.where("t IS NOT NULL"), "t", lambda: lambda pdf: pdf.iloc[spaced(pdf["t"].to_numpy(), gap, -np.inf)[0]])
    equal(got, want, ["session_id", "t"])


def test_a_hot_session_runs_on_many_tasks(spark, predictions):
    """A running count per session: each task adds its number to the rows it replays."""
    from pyspark import TaskContext

    def replay(states):
        count = [states[0]]

        def step(pdf):
            n = count[0] + np.arange(1, len(pdf) + 1)
            count[0] = int(n[-1])
            return pdf[["session_id", "step"]].assign(n=n, task=TaskContext.get().partitionId())

        return step

    stage = Stage(0, lambda states, pdf: len(pdf), lambda a, b: a + b)
    out = chunked(predictions.select("session_id", "step"), ["session_id"], "step", F.floor(F.col("step") / 60), [stage], replay, "session_id string, step long, n long, task int").toPandas()
    assert (out["n"] == out["step"] + 1).all() and len(out) == predictions.count()
    hot = out[out["session_id"] == "hot"]
    assert hot["task"].nunique() == 4 and hot.groupby("task").size().max() <= 600


def test_no_rows(spark, predictions):
    assert mon.stabilize_tokens(predictions.limit(0)).count() == 0
    assert mon.throttle(predictions.limit(0), ["session_id"], 1.0).count() == 0
