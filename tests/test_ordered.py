"""Ordered computations with one key holding most rows, cut into many chunks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from subvox.plans.draws import draw, quota_cut
from subvox.plans.joins import spread_join
from subvox.plans.ordered import add_position, drop_halo, exact_percentiles, halo_window, last_known, running_sum, with_halo


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    keys = ["hot"] * 900 + [f"k{i % 9}" for i in range(300)]
    return [(k, int(t), float(v)) for k, t, v in zip(keys, rng.permutation(10_000)[: len(keys)], rng.integers(0, 40, len(keys)))]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t bigint, v double").repartition(5)


def by_key(rows):
    out = {}
    for k, t, v in sorted(rows):
        out.setdefault(k, []).append((t, v))
    return out


@pytest.mark.parametrize("size", [50, 10_000])
def test_positions(df, rows, size):
    got = {(r.k, r.t): r.pos for r in add_position(df, ["k"], ["t"], on=F.col("t"), rows_per_bucket=size).collect()}
    want = {(k, t): i for k, part in by_key(rows).items() for i, (t, _) in enumerate(part)}
    assert got == want


@pytest.fixture(scope="module")
def placed(df):
    return add_position(df, ["k"], ["t"], on=F.col("t"), rows_per_bucket=50).cache()


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_running_sum_and_lag(placed, rows, chunk):
    out = running_sum(placed, ["k"], "pos", {"upto": F.col("v")}, chunk=chunk)
    near = with_halo(out, ["k"], "pos", chunk=chunk, before=3, after=1)
    w = halo_window(["k"], "pos")
    near = near.withColumn("back", F.lag("v", 3).over(w)).withColumn("ahead", F.lead("v").over(w)).withColumn("avg4", F.avg("v").over(w.rowsBetween(-3, 0)))
    got = {(r.k, r.t): (r.upto, r.back, r.ahead, round(r.avg4, 9)) for r in drop_halo(near).collect()}
    assert len(got) == len(rows)
    for k, part in by_key(rows).items():
        values = [v for _, v in part]
        for i, (t, _) in enumerate(part):
            assert got[k, t] == (
                sum(values[: i + 1]), values[i - 3] if i >= 3 else None, values[i + 1] if i + 1 < len(values) else None,
                round(float(np.mean(values[max(0, i - 3) : i + 1])), 9),
            )


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_last_known(placed, rows, chunk):
    out = last_known(placed, ["k"], "pos", {"seen": F.when(F.col("v") > 30, F.col("v"))}, chunk=chunk)
    got = {(r.k, r.t): r.seen for r in out.collect()}
    for k, part in by_key(rows).items():
        seen = None
        for t, v in part:
            seen = v if v > 30 else seen
            assert got[k, t] == seen


@pytest.mark.parametrize("size", [5, 10_000])
def test_percentiles(df, rows, size):
    out = exact_percentiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.95}, rows_per_bucket=size)
    got = {r.k: (r.a, r.m, r.z) for r in out.collect()}
    for k, part in by_key(rows).items():
        np.testing.assert_allclose(got[k], np.percentile([v for _, v in part], [10, 50, 95]))


def test_quota(df, spark):
    drawn = df.withColumn("d", draw(1, "k", "t"))
    quotas = spark.createDataFrame([("hot", 123), ("k1", 5), ("k2", 0), ("k3", 10_000)], "k string, q bigint")
    cuts = quota_cut(drawn, ["k"], "d", quotas, "q", digits=1)
    got = {r.k: r.n for r in drawn.join(cuts, "k").where("d <= _cut").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {"hot": 123, "k1": 5, "k3": df.where("k = 'k3'").count()}


def test_spread_join(df, spark):
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, w int")
    for how, n in (("inner", df.where("k IN ('hot', 'k1')").count()), ("left", df.count()), ("left_anti", df.where("k NOT IN ('hot', 'k1')").count())):
        assert spread_join(df, small, ["k"], how).count() == n


def test_no_window_over_a_hot_key(df):
    """With many rows per key the plan ranks inside (key, bucket), never inside the key alone."""
    plan = add_position(df, ["k"], ["t"], on=F.col("t"), rows_per_bucket=50)._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert ranks and all("_bucket" in line for line in ranks)
