"""Setting up many users at once: an eigenbasis and a profile row for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subvox.operators import spd


def onboard(events: DataFrame, profiles: DataFrame, win: int, step: int, *, user: str = "user_id", cap: int | None = None, seed: int = 1337) -> tuple[DataFrame, DataFrame]:
    """``(bases, profile rows)`` from the filtered training events of all users.

    A user without a profile gets the default one. ``events`` carry the user column, the
    session, the event and its samples.
    """
    keys = [user, "session_id", "event_id"]
    covs = spd.spd_regularize(spd.window_cov(events, win, step, keys))
    bases = spd.fit_basis(covs, [user], [*keys, "frame"], cap=cap, seed=seed)
    rows = bases.select(user, "n_matrices").join(profiles, user, "left")
    defaults = {"confidence_threshold": 0.70, "preprocessing_mode": "standard", "window_ms": 600, "stride_ms": 120}
    named = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in profiles.columns else F.lit(v).alias(c) for c, v in defaults.items()]
    return bases, rows.select(user, *named, F.col("n_matrices").alias("basis_matrices"))
