"""Recordings as block rows: cutting them up, joining spans to them, reading them as rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subvox.plans.draws import draw, uniform_int


def block_frames(fs_hz: float) -> int:
    """About a second of frames, a multiple of the 128-frame chunk and the 256-frame kernel."""
    return 256 * math.ceil(fs_hz / 256)


def to_blocks(samples: DataFrame, frames: int, *, session: str = "session_id", sample: str = "sample", values: str = "x") -> DataFrame:
    """``(session, sample, values)`` rows to block rows; ``values`` is a number or an array of channels.

    A block row holds a contiguous run of samples: a block in which samples are missing has several rows, told apart by ``start_sample``.
    A sample that is given more than once counts once, with its smallest value.
    """
    wide = samples.schema[values].dataType.typeName() == "array"
    block = F.floor(F.col(sample) / frames).cast("long")
    rows = F.sort_array(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(values).alias("v"))))
    out = samples.groupBy(session, block.alias("block")).agg(rows.alias("_r"))
    r = F.col("_r")
    once = F.when(F.size(F.array_distinct(r["s"])) == F.size(r), r).otherwise(F.filter(r, lambda e, i: (i == 0) | (e["s"] != F.get(r, i - 1)["s"])))
    out = out.withColumn("_r", once)
    n = F.size(r)
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(r, i)["s"] != F.get(r, i - 1)["s"] + 1))
    cut = F.transform(F.col("_b"), lambda a, k: F.slice(r, a + 1, F.coalesce(F.get(F.col("_b"), k + 1), n) - a))
    contiguous = F.element_at(r, -1)["s"] - r[0]["s"] + 1 == n
    out = out.withColumn("_b", F.when(~contiguous, begins)).withColumn("_r", F.explode(F.when(contiguous, F.array(r)).otherwise(cut)))
    data = F.flatten(F.col("_r.v")) if wide else F.col("_r.v")
    count = F.size("_r")
    return out.select(
        session,
        "block",
        F.col("_r")[0]["s"].alias("start_sample"),
        count.alias("n_frames"),
        (F.size(data) / count).cast("int").alias("channels"),
        data.cast("array<float>").alias("samples"),
    )


def samples_long(blocks: DataFrame) -> DataFrame:
    """One row per frame: ``session_id, sample, x array<float>``."""
    frames = F.sequence(F.lit(0), F.col("n_frames") - 1)
    cut = F.transform(frames, lambda i: F.slice("samples", i * F.col("channels") + 1, F.col("channels")))
    return blocks.select("session_id", "start_sample", F.posexplode(cut).alias("i", "x")).select(
        "session_id", (F.col("start_sample") + F.col("i")).alias("sample"), "x"
    )


def assemble_recordings(chunks: DataFrame, frames: int) -> DataFrame:
    """Chunks ``(session_id, sample_index, n_frames, channels, samples)`` to block rows, one per contiguous run of a block.

    A chunk that crosses a block border is cut there. Lost samples stay lost: a block with a hole has a row before it and one after it.
    Of several chunks with one first sample the longest is used (of equally long ones the smallest by its samples). Where
    chunks overlap, a sample is taken from the one that starts first.
    """
    best = F.min(F.struct((-F.col("n_frames")).alias("_n"), "samples", "channels")).alias("_c")
    unique = chunks.groupBy("session_id", "sample_index").agg(best).select("session_id", "sample_index", (-F.col("_c._n")).alias("n_frames"), "_c.samples", "_c.channels")
    first = F.floor(F.col("sample_index") / frames)
    last = F.floor((F.col("sample_index") + F.col("n_frames") - 1) / frames)
    pieces = unique.where("n_frames > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    low = F.greatest(F.col("sample_index"), F.col("block") * frames)
    high = F.least(F.col("sample_index") + F.col("n_frames"), (F.col("block") + 1) * frames)
    # All that follows is grouped by session and block, one shuffle for the windows and the grouping.
    order = Window.partitionBy("session_id", "block").orderBy("_low", "sample_index")
    laid = pieces.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long"))
    laid = laid.withColumn("_before", F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("_before IS NULL OR _high > _before")
    start = F.greatest("_low", "_before")
    offset = ((start - F.col("sample_index")) * F.col("channels") + 1).cast("int")
    cut = F.slice("samples", offset, ((F.col("_high") - start) * F.col("channels")).cast("int"))
    parts = laid.select(
        "session_id", "block", "sample_index", "channels", "_low", start.alias("s"), (F.col("_high") - start).alias("n"), cut.alias("v"),
        F.sum(F.when(F.col("_low") <= F.col("_before"), 0).otherwise(1)).over(order).alias("_run"),
    )
    joined = parts.groupBy("session_id", "block", "_run").agg(
        F.sort_array(F.collect_list(F.struct("s", "v"))).alias("_r"), F.sum("n").cast("int").alias("n_frames"), F.max("channels").alias("channels")
    )
    return joined.select(
        "session_id", "block", F.col("_r")[0]["s"].alias("start_sample"), "n_frames", "channels", F.flatten("_r.v").alias("samples")
    )


def recording_summary(blocks: DataFrame, fs_hz: float) -> DataFrame:
    """Samples held, samples spanned and duration of each recording."""
    out = blocks.groupBy("session_id").agg(
        F.sum("n_frames").cast("long").alias("n_samples"),
        F.max(F.col("start_sample") + F.col("n_frames")).cast("long").alias("end_sample"),
        F.count_distinct("block").alias("n_blocks"),
    )
    return out.withColumn("duration_s", F.col("n_samples") / F.lit(float(fs_hz)))


def cut_pieces(blocks: DataFrame, spans: DataFrame, frames: int) -> DataFrame:
    """The part of every block that lies in a span, one row per span and block.

    The span-by-block range join is an equi join on the block number: a span names the
    few blocks it touches, so any number of spans and blocks is hash-partitioned by
    ``(session, block)`` and no single session or span becomes one task.
    """
    touched = F.sequence(
        F.floor(F.col("start_sample") / frames).cast("long"), F.floor((F.col("end_sample") - 1) / frames).cast("long")
    )
    wanted = spans.where("end_sample > start_sample").withColumn("block", F.explode(touched))
    data = blocks.withColumnRenamed("start_sample", "_b0")
    joined = wanted.join(data, ["session_id", "block"])
    low = F.greatest("start_sample", "_b0")
    high = F.least("end_sample", F.col("_b0") + F.col("n_frames"))
    offset = ((low - F.col("_b0")) * F.col("channels") + 1).cast("int")
    cut = F.slice("samples", offset, ((high - low) * F.col("channels")).cast("int"))
    return joined.where(low < high).withColumn("samples", cut).withColumn("piece_start", low).withColumn(
        "n_frames", (high - low).cast("int")
    ).drop("_b0", "block")


def cut_events(blocks: DataFrame, spans: DataFrame, frames: int, on_gap: str = "join") -> DataFrame:
    """One row per span with its samples, in order.

    ``spans`` needs ``session_id, event_id, start_sample, end_sample`` and may carry more
    columns. No span is left out; very long ones are better taken from :func:`cut_pieces`, a row per block.

    ``on_gap`` says what becomes of a span some samples of which the recording does not have: ``join`` puts the others
    side by side, ``fill`` has zeros in their place so that frame ``i`` is sample ``start_sample + i``, ``drop`` leaves the span out, and ``split``
    gives a row per contiguous ``run`` of it (``start_sample`` and ``end_sample`` are then those of the run). All but ``join`` add ``lost``, the
    frames of the span that are missing. Spans without any sample have no row.
    """
    if on_gap not in ("join", "fill", "drop", "split"):
        raise ValueError(f"on_gap is join, fill, drop or split, not {on_gap!r}")
    carried = [c for c in spans.columns if c not in ("session_id", "event_id")]
    pieces = cut_pieces(blocks, spans, frames)
    keys = ["session_id", "event_id"]
    if on_gap == "split":
        order = Window.partitionBy(*keys).orderBy("piece_start")
        before = F.lag(F.col("piece_start") + F.col("n_frames")).over(order)
        held = F.sum("n_frames").over(Window.partitionBy(*keys))
        pieces = pieces.withColumn("lost", (F.col("end_sample") - F.col("start_sample") - held).cast("long")).withColumn("_fresh", F.when(F.col("piece_start") == before, 0).otherwise(1))
        pieces = pieces.withColumn("run", F.sum("_fresh").over(order)).drop("_fresh")
        keys, carried = [*keys, "run"], [*carried, "lost"]
    rows = F.sort_array(F.collect_list(F.struct("piece_start", "samples")))
    whole = pieces.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried], F.max("channels").alias("channels"),
        F.sum("n_frames").cast("int").alias("n_frames"), rows.alias("_r"),
    )
    if on_gap == "split":
        first = F.col("_r")[0]["piece_start"]
        return whole.withColumn("start_sample", first).withColumn("end_sample", first + F.col("n_frames")).withColumn("samples", F.flatten("_r.samples")).drop("_r")
    if on_gap != "join":
        whole = whole.withColumn("lost", (F.col("end_sample") - F.col("start_sample") - F.col("n_frames")).cast("long"))
    if on_gap == "drop":
        whole = whole.where("lost = 0")
    if on_gap == "fill":
        r, ch = F.col("_r"), F.col("channels")
        zeros = lambda n: F.array_repeat(F.lit(0.0).cast(blocks.schema["samples"].dataType.elementType), (n * ch).cast("int"))
        end = lambda p: p["piece_start"] + F.size(p["samples"]) / ch
        filled = F.transform(r, lambda p, i: F.concat(zeros(p["piece_start"] - F.when(i == 0, F.col("start_sample")).otherwise(end(F.get(r, i - 1)))), p["samples"]))
        tail = zeros(F.col("end_sample") - end(F.element_at(r, -1)))
        whole = whole.withColumn("samples", F.concat(F.flatten(filled), tail)).withColumn("n_frames", (F.col("end_sample") - F.col("start_sample")).cast("int"))
        return whole.drop("_r")
    return whole.withColumn("samples", F.flatten("_r.samples")).drop("_r")


def fixed_segments(events: DataFrame, fs_hz: float, segment_ms: float, seed: int) -> DataFrame:
    """Segments of one length: longer events are cropped at a repeatable random place,
    shorter ones get zeros at the end, those under 8 frames are left out."""
    n = max(8, int(fs_hz) * int(segment_ms) // 1000)
    length, ch = F.col("n_frames"), F.col("channels")
    crop = F.pmod(uniform_int(draw(seed, "session_id", "event_id")), F.greatest(length - n + 1, F.lit(1)))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), ((F.lit(n) - length) * ch).cast("int"))
    fitted = F.when(length >= n, F.slice("samples", (crop * ch + 1).cast("int"), (ch * n).cast("int"))).otherwise(
        F.concat("samples", zeros)
    )
    start = F.when(length >= n, crop).otherwise(0)
    return events.where(length >= 8).withColumn("samples", fitted).withColumn("crop_start", start.cast("long")).withColumn(
        "n_frames", F.lit(n)
    )


def window_starts(n: Column, win: int, step: int) -> Column:
    """Starts of all full windows; an empty array when not one fits."""
    none = F.array().cast("array<bigint>")
    return F.when(n >= win, F.sequence(F.lit(0).cast("long"), (n - win).cast("long"), F.lit(step).cast("long"))).otherwise(none)


def sliding_windows(events: DataFrame, win: int, step: int) -> DataFrame:
    """Full windows inside each event row: ``window, win_start, samples``."""
    starts = F.posexplode(window_starts(F.col("n_frames"), win, step)).alias("window", "win_start")
    rows = events.select("*", starts)
    cut = F.slice("samples", (F.col("win_start") * F.col("channels") + 1).cast("int"), (F.col("channels") * win).cast("int"))
    return rows.withColumn("samples", cut).withColumn("n_frames", F.lit(win))


def window_means(samples: DataFrame, win: int, step: int, value: str = "x", session: str = "session_id", sample: str = "sample") -> DataFrame:
    """Mean and deviation of full sliding windows over whole sessions.

    Samples are summed once per ``step``-long pane, map-side; a window adds its panes, so
    an overlap costs pane rows, not sample rows, and no session is sorted in one task.
    """
    if win % step:
        raise ValueError("the window must be a whole number of steps")
    x = F.col(value).cast("double")
    panes = samples.groupBy(session, F.floor(F.col(sample) / step).cast("long").alias("pane")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")
    )
    k = win // step
    spread = panes.withColumn("window", F.explode(F.sequence(F.col("pane") - (k - 1), F.col("pane"))))
    sums = spread.groupBy(session, "window").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    full = sums.where(f"n = {win} AND window >= 0")
    mean = F.col("s") / win
    var = F.greatest(F.col("ss") / win - mean * mean, F.lit(0.0))
    return full.select(session, "window", (F.col("window") * step).alias("win_start"), mean.alias("mean"), F.sqrt(var).alias("std"))
