"""Wall time of the headline queries and throughput of the signal operators.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_RUNS (default 1)

Prints one JSON line. Each query is warmed up once on the smallest tables, then its whole
result is computed and thrown away (``noop`` sink). The corpus part makes recordings of
31 channels at 5 kHz inside Spark and reports frames per second at two sizes.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "held_out_slot_report", "lm_score", "split_stratified", "split_grouped", "sample_trials", "top_labels", "normalize_zscore", "detect_gaps",
    "assemble_recordings", "cut_events", "fixed_segments", "sliding_windows", "window_means", "asof_quality", "rolling_snr", "weak_channels",
    "bandpass_causal", "ema_normalize", "motion_index", "welch_snr", "bandpass_zero_phase", "window_cov", "spd_regularize", "sigma_sequences",
    "phone_spans", "separability", "phone_templates", "look_up_phones", "nearest_words", "classification_metrics", "phone_error_rate",
    "word_error_rate", "error_taxonomy", "bootstrap_accuracy", "latency_percentiles", "confidence_threshold", "sweep_bounds", "stable_runs",
    "recalibration_monitor", "throttle", "ptt_utterances", "greedy_collapse", "lexicon_scores", "decode_packets", "latest_profiles",
    "pending_work", "validate_sessions", "stream_gaps", "stream_preprocess",
]


def timed(df_of) -> float:
    began = time.perf_counter()
    df_of().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def corpus(spark, seconds: int, sessions: int):
    """Recordings of noise, made by the tasks that need them: one block of 5120 frames per row."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    def make(batches):
        for pdf in batches:
            rows = [np.random.default_rng(int(i)).normal(size=5120 * 31).astype(np.float32) for i in pdf["id"]]
            yield pd.DataFrame({"id": pdf["id"], "samples": rows})

    made = spark.range(0, seconds * sessions, 1, 8).mapInPandas(make, "id bigint, samples array<float>")
    return made.select(
        F.floor(F.col("id") / seconds).cast("string").alias("session_id"), (F.col("id") % seconds).alias("block"),
        ((F.col("id") % seconds) * 5120).alias("start_sample"), F.lit(5120).alias("n_frames"), F.lit(31).alias("channels"), "samples",
        F.lit("gowda").alias("mode"), F.lit(5000.0).alias("fs_hz"), F.lit(80.0).alias("low_hz"), F.lit(1000.0).alias("high_hz"),
    )


def throughput(spark, seconds: int, sessions: int) -> dict[str, float]:
    """Frames per second of the causal filter, Welch SNR, span cut and covariance windows."""
    from pyspark.sql import functions as F

    from subvox.operators import blocks as bl
    from subvox.operators import filtering as fl
    from subvox.operators import quality as ql
    from subvox.operators import spd

    data = corpus(spark, seconds, sessions).persist()
    frames = data.count() * 5120
    lengths = data.groupBy("session_id").agg(F.sum("n_frames").alias("n_samples"))
    second = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(seconds - 1).cast("bigint")))
    spans = data.select("session_id").distinct().select("session_id", second.alias("event_id"))
    spans = spans.withColumn("start_sample", F.col("event_id") * 5120).withColumn("end_sample", F.col("start_sample") + 4000)
    work = {
        "causal_filter": lambda: fl.bandpass_causal(data),
        "welch_snr": lambda: ql.welch_snr(data, lengths),
        "span_cut": lambda: bl.cut_events(data, spans, 5120),
        "covariance": lambda: spd.window_cov(bl.cut_events(data, spans, 5120), 500, 250),
    }
    out = {name: round(frames / timed(run)) for name, run in work.items()}
    data.unpersist()
    return out


def main() -> None:
    from subvox import catalog
    from subvox.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        f"local[{cpus}]", "subvox-bench",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    small = str(Path(folder).parent / "sf0.001")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        if Path(small).exists():
            timed(lambda: queries[name](spark, small))
        times[name] = round(statistics.median(timed(lambda: queries[name](spark, folder)) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    if not sys.argv[1:]:
        result["frames_per_second"] = {"40x4s": throughput(spark, 4, 40), "160x4s": throughput(spark, 4, 160)}
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
