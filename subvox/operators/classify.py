"""Word classification: scoring rules, thresholds, training with Spark ML, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subvox.functions.arrays import once
from subvox.operators.phones import centroids
from subvox.plans.draws import draw


def score_probabilities(
    df: DataFrame, labels: Sequence[str], probs: str = "probs", *, entropy_max: float | None = None, margin_min: float | None = None
) -> DataFrame:
    """Adds ``token, confidence, entropy, margin, abstain`` from a probability array.

    The first of equal maxima wins. Entropy is divided by ``ln K``; abstain when it is over
    ``entropy_max`` or the two best are closer than ``margin_min``.
    """
    k = len(labels)
    df = once(df, _best=F.array_max(probs))
    at = F.array_position(probs, F.col("_best")).cast("int")
    clipped = F.transform(probs, lambda p: F.least(F.greatest(p.cast("double"), F.lit(1e-12)), F.lit(1.0)))
    h = F.aggregate(clipped, F.lit(0.0), lambda s, p: s - p * F.log(p))
    entropy = h / F.log(F.lit(float(k))) if k > 1 else F.lit(0.0)
    ranked = F.sort_array(probs, asc=False)
    margin = F.when(F.size(probs) < 2, 1.0).otherwise((ranked[0] - ranked[1]).cast("double"))
    out = df.select(
        "*", F.element_at(F.array(*map(F.lit, labels)), at).alias("token"), F.col("_best").cast("double").alias("confidence"),
        entropy.alias("entropy"), margin.alias("margin"),
    ).drop("_best")
    abstain = F.lit(False)
    if entropy_max is not None:
        abstain = abstain | (F.col("entropy") > entropy_max)
    if margin_min is not None:
        abstain = abstain | (F.col("margin") < margin_min)
    return out.withColumn("abstain", abstain)


def confidence_threshold(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean minus two deviations of the confidence of right answers, kept in [.5, .95]; .70 without any."""
    right = F.when(F.col("ref") == F.col("hyp"), F.col("conf"))
    out = pred.groupBy(*keys).agg(F.avg(right).alias("_m"), F.stddev_pop(right).alias("_s"), F.count(right).alias("n_correct"))
    level = F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.col("_m") - 2 * F.col("_s")))
    return out.select(*keys, F.when(F.col("n_correct") > 0, level).otherwise(0.70).alias("threshold"), "n_correct")


def pooled_features(sequences: DataFrame, keys: Sequence[str] = ("session_id", "event_id")) -> DataFrame:
    """Mean and deviation over frames of each event's feature rows as one vector."""
    from pyspark.ml.stat import Summarizer

    rows = sequences.select(*keys, array_to_vector(F.col("sigma").cast("array<double>")).alias("_v"))
    out = rows.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"), Summarizer.std(F.col("_v")).alias("_s"))
    joined = F.concat(vector_to_array("_m"), F.transform(vector_to_array("_s"), lambda v: F.nanvl(v, F.lit(0.0))))
    return out.select(*keys, joined.alias("features"))


def train_word_classifier(train: DataFrame, *, label: str = "label", features: str = "features", kind: str = "logistic", seed: int = 1337) -> PipelineModel:
    """Closed-vocabulary classifier over feature arrays (logistic regression or random forest)."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep")
    scale = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True)
    if kind == "forest":
        model = RandomForestClassifier(labelCol="_y", featuresCol="_z", seed=seed, numTrees=50, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r")
    else:
        model = LogisticRegression(
            labelCol="_y", featuresCol="_z", maxIter=50, regParam=0.01, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r"
        )
    data = train.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    return Pipeline(stages=[index, scale, model]).fit(data)


def score_windows(model: PipelineModel, rows: DataFrame, *, features: str = "features", **abstain) -> DataFrame:
    """Token, confidence and abstain flag of every row."""
    labels = list(model.stages[0].labels)
    data = rows.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    for stage in model.stages[1:]:
        data = stage.transform(data)
    probs = F.slice(vector_to_array("_p"), 1, len(labels))
    return score_probabilities(data.withColumn("probs", probs).drop("_x", "_z", "_p", "_c", "_r"), labels, **abstain)


#: Rows among which a channel's values change places.
BUCKET_ROWS = 4096


def channel_importance(
    rows: DataFrame, reference: DataFrame, channels: int, *, row: str = "frame", label: str = "label", value: str = "x", k: int = 16, seed: int = 0,
    bucket: int = BUCKET_ROWS,
) -> DataFrame:
    """Accuracy lost when one channel is shuffled, scaled to the largest loss; top ``k``.

    ``reference(label, centroid)`` is the nearest-centroid model (one row per label). A row
    is scored once per channel from its squared gaps. Rows fall into buckets of about ``bucket`` by md5 of ``row``; the shuffled value of a
    row is that of the next one of its bucket in md5 order, the last one takes the first one's. A row alone in its bucket keeps its own.
    """
    number = F.conv(F.substring("_draw", 1, 12), 16, 10).cast("long")
    buckets = F.greatest(F.lit(1).cast("long"), F.floor(rows.agg(F.count(F.lit(1))).scalar() / bucket))
    keyed = rows.withColumn("_draw", draw(seed, row)).withColumn("_bucket", number % buckets)
    line = Window.partitionBy("_bucket").orderBy("_draw", F.xxhash64(label, value))
    held = F.struct(value)
    paired = keyed.withColumn("_other", F.coalesce(F.lead(held).over(line), F.first(held).over(line))[value])
    # One array of all class centroids (labels are a closed set) meets every row.
    table = reference.groupBy().agg(F.sort_array(F.collect_list(F.struct(label, "centroid"))).alias("_c"))
    met = paired.withColumn("_c", table.scalar())

    def gap(x: Column, c: Column) -> Column:
        return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    met = once(met, _d=F.transform("_c", lambda c: gap(F.col(value).cast("array<double>"), c["centroid"])))
    per = met.select(
        label, value, "_other", "_c", "_d", F.explode(F.sequence(F.lit(-1), F.lit(channels - 1))).alias("channel")
    )

    def changed(d: Column, i: Column) -> Column:
        c = F.get(F.get("_c", i)["centroid"], F.col("channel"))
        old, new = F.get(value, F.col("channel")).cast("double"), F.get("_other", F.col("channel")).cast("double")
        return F.when(F.col("channel") < 0, d).otherwise(d - (old - c) * (old - c) + (new - c) * (new - c))

    per = once(per, _n=F.transform("_d", changed))
    guess = F.get("_c", (F.array_position("_n", F.array_min("_n")) - 1).cast("int"))[label]
    acc = per.groupBy("channel").agg(F.avg((guess == F.col(label)).cast("double")).alias("accuracy"))
    # One row per channel from here on.
    whole = F.max(F.when(F.col("channel") < 0, F.col("accuracy"))).over(Window.partitionBy())
    drop = acc.withColumn("drop", F.greatest(whole - F.col("accuracy"), F.lit(0.0))).where("channel >= 0")
    top = F.max("drop").over(Window.partitionBy())
    scored = drop.withColumn("importance", F.when(top > 1e-12, F.col("drop") / top).otherwise(0.0))
    return scored.orderBy(F.desc("importance"), "channel").limit(int(k)).select("channel", "drop", "importance")


def nearest_centroid(rows: DataFrame, reference: DataFrame, *, label: str = "label", value: str = "x") -> DataFrame:
    """Label of the closest class centroid and a softmax confidence over the distances."""
    table = reference.groupBy().agg(F.sort_array(F.collect_list(F.struct(label, "centroid"))).alias("_c"))
    met = rows.withColumn("_c", table.scalar())

    def gap(x: Column, c: Column) -> Column:
        return F.aggregate(F.zip_with(x, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)

    met = once(met, _d=F.transform("_c", lambda c: F.sqrt(gap(F.col(value), c["centroid"]))))
    met = once(met, _low=F.array_min("_d"))
    guess = F.get("_c", (F.array_position("_d", F.col("_low")) - 1).cast("int"))[label]
    share = F.lit(1.0) / F.aggregate("_d", F.lit(0.0), lambda s, d: s + F.exp(F.col("_low") - d))
    return met.withColumn("hyp", guess).withColumn("conf", share).drop("_c", "_d", "_low")


def sweep_bounds(events: DataFrame, windows: Sequence[int], fs_hz: float) -> DataFrame:
    """For every event and window size (ms): which samples are scored.

    Events under 50 ms (8 frames) are centred in the window, others end it; too short cuts
    are left out. ``n_samples`` is the session length; ``pad`` zeros go in front.
    """
    least = max(8, int(fs_hz * 0.05))
    sizes = F.array(*[F.struct(F.lit(int(w)).alias("window_ms"), F.lit(max(1, int(fs_hz * w / 1000))).cast("long").alias("win")) for w in windows])
    rows = events.where("end_sample > start_sample").withColumn("_w", F.explode(sizes)).select("*", "_w.*").drop("_w")
    win = F.col("win")
    short = F.col("end_sample") - F.col("start_sample") < least
    first = F.greatest(F.lit(0), F.floor((F.col("start_sample") + F.col("end_sample")) / 2) - F.floor(win / 2))
    stop = F.when(short, F.least(F.col("n_samples"), first + win)).otherwise(F.least(F.col("n_samples"), F.col("end_sample")))
    rows = rows.withColumn("cut_end", stop.cast("long"))
    rows = rows.withColumn("cut_start", F.greatest(F.lit(0), F.col("cut_end") - win).cast("long"))
    rows = rows.where(F.col("cut_end") - F.col("cut_start") >= F.greatest(F.lit(4), F.floor(win / 4)))
    return rows.withColumn("pad", win - (F.col("cut_end") - F.col("cut_start")))


def sweep_choice(rows: DataFrame, *, target_p95_ms: float = 500.0, min_accuracy: float = 0.0) -> DataFrame:
    """Best window size: accuracy (.5 if unknown) minus p95 / 2000 among those in both limits; first on ties.

    ``rows(window_ms, accuracy, latency_p95_ms)`` has one row per size.
    """
    acc = F.coalesce("accuracy", F.lit(0.5))
    ok = (F.col("latency_p95_ms") <= target_p95_ms) & (F.col("accuracy").isNull() | (F.col("accuracy") >= min_accuracy))
    scored = rows.withColumn("score", acc - F.col("latency_p95_ms") / 2000).withColumn("allowed", ok)
    best = scored.where("allowed AND score > -1").agg(F.min(F.struct((-F.col("score")).alias("s"), "window_ms"))["window_ms"].alias("best"))
    return scored.withColumn("best", best.scalar()).withColumn("recommended", F.coalesce(F.col("window_ms") == F.col("best"), F.lit(False))).drop("best")


def fit_centroids(train: DataFrame, label: str = "label", value: str = "x") -> DataFrame:
    return centroids(train, [label], value).select(label, "centroid")


def calibrate(
    quality: DataFrame, counts: DataFrame, predictions: DataFrame, *, user: str = "user_id", min_samples: int = 50, motion_warn: float = 0.3,
    motion_reject: float = 0.35, strict: bool = False,
) -> DataFrame:
    """Profile rows of all users at once: threshold, baseline, validation accuracy, warnings.

    ``quality(user, snr_db, motion_index)``, ``counts(user, label, n)`` and validation
    ``predictions(user, ref, hyp, conf)``. With ``strict``, users who moved too much are
    marked rejected.
    """
    level = confidence_threshold(predictions, [user])
    score = predictions.groupBy(user).agg(F.avg((F.col("ref") == F.col("hyp")).cast("double")).alias("val_accuracy"))
    low = F.when(F.col("n") < min_samples, F.col("label"))
    tokens = counts.groupBy(user).agg(
        F.sum("n").alias("calibration_samples"), F.count(F.lit(1)).alias("n_tokens"), F.count(low).alias("n_low_tokens")
    )
    out = tokens.join(level, user, "left").join(score, user, "left").join(quality, user, "left")
    notes = F.array_compact(
        F.array(
            F.when(F.col("n_low_tokens") > 0, F.format_string("%d tokens under %d samples", "n_low_tokens", F.lit(min_samples))),
            F.when(F.col("motion_index") > motion_warn, F.format_string("motion share %.3f is too high", "motion_index")),
        )
    )
    rejected = (F.col("motion_index") > motion_reject) if strict else F.lit(False)
    return out.select(
        user, F.coalesce("threshold", F.lit(0.70)).alias("confidence_threshold"), F.col("snr_db").alias("baseline_snr"), "motion_index",
        "val_accuracy", "calibration_samples", "n_tokens", notes.alias("warnings"), F.coalesce(rejected, F.lit(False)).alias("rejected"),
    )


def compare_configs(results: DataFrame, config: str = "config") -> DataFrame:
    """Rows of configurations with their validation accuracy, best first, the best one marked."""
    best = results.agg(F.min(F.struct((-F.col("val_accuracy")).alias("a"), config))[config])
    return results.withColumn("best", F.coalesce(F.col(config) == best.scalar(), F.lit(False))).orderBy(F.desc("val_accuracy"), config)
