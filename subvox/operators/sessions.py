"""Session-level choices and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subvox.functions.fixed import MODES


def _known(mode: Column) -> Column:
    bare = F.trim(mode)
    return F.when(bare.isin(list(MODES)), bare)


def resolve_mode(df: DataFrame, model_mode: str = "model_mode", profile_mode: str = "profile_mode") -> DataFrame:
    """The model's mode wins, then the profile's, then ``standard``; tells when they disagree."""
    model, profile = _known(F.col(model_mode)), _known(F.col(profile_mode))
    clash = model.isNotNull() & F.col(profile_mode).isNotNull() & (F.trim(F.col(profile_mode)) != model)
    return df.withColumn("mode", F.coalesce(model, profile, F.lit("standard"))).withColumn(
        "mode_conflict", F.coalesce(clash, F.lit(False))
    )


def mode_bands(df: DataFrame, mode: str = "mode", fs: str = "fs_hz") -> DataFrame:
    """Band, order and quality band of each row's mode at its rate.

    ``usable`` is false where the rate is too low for the mode; unknown modes use
    the ``standard`` band.
    """

    def pick(i: int) -> Column:
        out = F.lit(MODES["standard"][i])
        for name, spec in MODES.items():
            out = F.when(F.col(mode) == name, F.lit(spec[i])).otherwise(out)
        return out

    cap = F.greatest(F.lit(10.0), F.col(fs) / 2.0 - 5.0)
    return (
        df.withColumn("low_hz", pick(0))
        .withColumn("high_hz", pick(1))
        .withColumn("filter_order", pick(2).cast("bigint"))
        .withColumn("usable", F.col(fs) > pick(3))
        .withColumn("quality_low_hz", F.col("low_hz"))
        .withColumn("quality_high_hz", F.least(F.col("high_hz"), cap))
    )


def _rules(df: DataFrame) -> list[Column]:
    has = set(df.columns)
    rules: list[Column] = []

    def rule(needs: set[str], severity: str, code: str, broken: Column, message: Column) -> None:
        if needs <= has:
            row = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))
            rules.append(F.when(broken, row))

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    c = {name: F.col(name) for name in has}
    if {"mode", "fs_hz"} <= has:
        floor = F.lit(0.0)
        for name, spec in MODES.items():
            floor = F.when(c["mode"] == name, F.lit(spec[3])).otherwise(floor)
        rule({"mode", "fs_hz"}, "error", "mode.rate_too_low", c["fs_hz"] <= floor, text(c["mode"], " needs a higher rate than ", c["fs_hz"], " Hz"))
        rule({"mode"}, "warning", "mode.unknown", ~c["mode"].isin(list(MODES)), text("unknown mode ", c["mode"]))
    if {"channels", "montage_channels"} <= has:
        rule({"channels"}, "error", "montage.unknown", c["montage_channels"].isNull(), text("no such montage"))
        rule(
            {"channels"}, "warning", "channels.montage_mismatch", c["channels"] != c["montage_channels"],
            text("channels=", c["channels"], " but the montage has ", c["montage_channels"]),
        )
    if "n_samples" in has:
        rule({"n_samples"}, "error", "signal.short", c["n_samples"] < 100, text("only ", c["n_samples"], " samples"))
    if {"n_samples", "last_end_sample"} <= has:
        rule({"n_samples"}, "error", "span.outside", c["last_end_sample"] > c["n_samples"], text("a span ends at ", c["last_end_sample"]))
    if {"stride_ms", "window_ms"} <= has:
        rule({"stride_ms"}, "error", "profile.stride", c["stride_ms"] >= c["window_ms"], text("stride must be below window"))
    if "loss_fraction" in has:
        rule({"loss_fraction"}, "warning", "link.loss_high", c["loss_fraction"] > 0.05, text("loss above 5 %"))
    return rules


def validate_sessions(df: DataFrame, key: str = "session_id") -> DataFrame:
    """All broken rules of all sessions in one scan: ``(key, severity, code, message)``."""
    rules = _rules(df)
    issues = df.select(key, F.explode(F.array_compact(F.array(*rules))).alias("issue"))
    return issues.select(key, "issue.severity", "issue.code", "issue.message")
