"""Phone spans inside word spans, phone templates and how well phones separate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subvox.functions.arrays import distance, dot, norm, once
from subvox.functions.fixed import PHONE_MS, PHONE_MS_OTHER, PHONE_WEIGHT, PHONE_WEIGHT_OTHER
from subvox.plans.draws import drawn_rows
from subvox.plans.joins import spread_join
from subvox.plans.ordered import exact_percentiles


def phone_weight(phone: Column, mode: str = "pseudo") -> Column:
    table, other = (PHONE_MS, PHONE_MS_OTHER) if mode == "corpus_duration" else (PHONE_WEIGHT, PHONE_WEIGHT_OTHER)
    pairs = [x for p, w in table.items() for x in (F.lit(p), F.lit(float(w)))]
    return F.coalesce(F.create_map(*pairs)[F.upper(F.trim(phone))], F.lit(other))


def phone_lengths(shapes: DataFrame, mode: str = "pseudo", least: int = 2) -> DataFrame:
    """Adds ``lengths``, whole sample counts per phone, to rows of ``phones, n``.

    Each phone gets at least ``least`` samples where ``n`` allows it; the rest is shared by
    weight with the largest remainders rounded up (first phone on ties), so the sum is ``n``.
    """
    n, count = F.col("n"), F.size("phones")
    floor = F.greatest(F.lit(1), F.least(F.lit(least), F.floor(n / count))).cast("long")
    df = once(shapes, _w=F.transform("phones", lambda p: phone_weight(p, mode)))
    df = once(df, _sum=F.aggregate("_w", F.lit(0.0), lambda s, w: s + w), _least=floor, _free=F.greatest(n - floor * count, F.lit(0)))
    df = once(df, _share=F.transform("_w", lambda w: F.col("_free") * w / F.col("_sum")))
    left = F.col("_free") - F.aggregate("_share", F.lit(0).cast("long"), lambda s, x: s + F.floor(x))
    ranked = F.sort_array(F.transform("_share", lambda x, i: F.struct(F.round(-(x - F.floor(x)), 9).alias("f"), i.alias("i"))))
    df = once(df, _up=F.slice(F.transform(ranked, lambda e: e["i"]), 1, left.cast("int")))
    lengths = F.transform("_share", lambda x, i: F.col("_least") + F.floor(x) + F.array_contains("_up", i).cast("long"))
    return once(df, lengths=lengths).select("phones", "n", "lengths")


def phone_spans(words: DataFrame, mode: str = "pseudo", least: int = 2) -> DataFrame:
    """Word spans with ``phones`` to phone spans that cover them without gaps.

    The cut depends on the phones and the length of a word only, so it is worked out once
    per distinct pair and joined to the spans.
    """
    keep = [c for c in words.columns if c not in ("start_sample", "end_sample", "phones")]
    sized = words.withColumn("n", F.col("end_sample") - F.col("start_sample"))
    sized = sized.where((F.size("phones") > 0) & (F.col("n") >= F.size("phones")))
    shapes = phone_lengths(sized.select("phones", "n").distinct(), mode, least)
    cut = F.transform(
        "lengths",
        lambda k, i: F.struct(
            i.alias("phone_idx"), F.get("phones", i).alias("phone"),
            F.aggregate(F.slice("lengths", 1, i), F.lit(0).cast("long"), lambda s, v: s + v).alias("at"), k.alias("k"),
        ),
    )
    cuts = once(shapes, _cut=cut).select("phones", "n", "_cut")
    out = spread_join(sized, cuts, ["phones", "n"], salt_by=["start_sample"]).select(*keep, "start_sample", F.explode("_cut").alias("_s"))
    start = F.col("start_sample") + F.col("_s.at")
    return out.select(*keep, "_s.phone_idx", "_s.phone", start.alias("start_sample"), (start + F.col("_s.k")).alias("end_sample"))


def centroids(vectors: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Mean vector of each key: a mergeable aggregate, so hot keys are summed map-side."""
    rows = vectors.select(*keys, array_to_vector(F.col(value).cast("array<double>")).alias("_v"))
    out = rows.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, vector_to_array("_m").alias("centroid"), "n")


def phone_templates(segments: DataFrame, row_key: Sequence[str], *, cap: int | None = None, seed: int = 1337) -> DataFrame:
    """Per phone: mean channel RMS, mean log-diagonal features (deltas 0), speaking rate
    against the mean over phones, number of segments.

    ``segments(phone, rms array, sigma array)``; with ``cap``, that many repeatably drawn
    segments of a phone, else all.
    """
    keyed = segments.withColumn("phone", F.upper(F.trim("phone")))
    kept = keyed if cap is None else drawn_rows(keyed, ["phone"], row_key, cap, seed)
    rms = centroids(kept, ["phone"], "rms").withColumnRenamed("centroid", "channel_rms").withColumnRenamed("n", "n_segments")
    sigma = centroids(kept, ["phone"], "sigma").select("phone", F.col("centroid").alias("_s"))
    out = rms.join(sigma, "phone")
    rate = F.aggregate("channel_rms", F.lit(0.0), lambda s, v: s + v) / F.size("channel_rms")
    out = out.withColumn("_r", rate).withColumn("spd_diag_delta", F.concat("_s", F.transform("_s", lambda v: v * 0)))
    # One row per phone of the inventory, so the mean over phones is over a few dozen rows.
    overall = out.groupBy().agg(F.avg("_r").alias("_g")).scalar()
    out = out.withColumn("rate_scale", F.col("_r") / (overall + F.lit(1e-9)))
    return out.withColumn("duration_weight", phone_weight(F.col("phone"))).drop("_r", "_s")


def separability(vectors: DataFrame, phone: str = "phone", value: str = "v") -> DataFrame:
    """Median distance to the own centroid, median distance between centroids, their ratio."""
    means = centroids(vectors, [phone], value)
    near = spread_join(vectors, means.select(phone, "centroid"), [phone], salt_by=[c for c in vectors.columns if c != phone][:1])
    within = near.select(F.lit("all").alias("_g"), distance(F.col(value), F.col("centroid")).alias("d"))
    inside = exact_percentiles(within, ["_g"], "d", {"median_within": 0.5})
    # The phone inventory is fixed and small: its centroids fit one row, pairs are measured inside it.
    table = means.groupBy().agg(F.sort_array(F.collect_list(F.struct(phone, "centroid", "n"))).alias("_c"))
    pairs = F.flatten(
        F.transform(
            "_c",
            lambda a, i: F.transform(
                F.filter("_c", lambda b, j: j > i), lambda b: distance(a["centroid"], b["centroid"])
            ),
        )
    )
    total = F.aggregate("_c", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    sides = table.select(
        F.lit("all").alias("_g"), F.size("_c").cast("long").alias("n_phones"), total.alias("n_vectors"), F.sort_array(pairs).alias("_d")
    )
    half = (F.size("_d") - 1) / 2
    low = F.get("_d", F.floor(half).cast("int"))
    high = F.get("_d", F.ceil(half).cast("int"))
    sides = sides.withColumn("median_between", (low + high) / 2).drop("_d")
    out = sides.withColumn("median_within", inside.select("median_within").scalar()).drop("_g")
    ratio = F.when(F.col("median_within") > 0, F.col("median_between") / (F.col("median_within") + F.lit(1e-9)))
    return out.withColumn("between_over_within", ratio)


def centroid_cosine(first: DataFrame, second: DataFrame, phone: str = "phone", value: str = "v") -> DataFrame:
    """Mean cosine of the centroids both corpora have."""
    a = centroids(first, [phone], value).select(phone, F.col("centroid").alias("a"))
    b = centroids(second, [phone], value).select(phone, F.col("centroid").alias("b"))
    cosine = dot(F.col("a"), F.col("b")) / (norm(F.col("a")) * norm(F.col("b")) + F.lit(1e-9))
    return a.join(b, phone).agg(F.avg(cosine).alias("cosine_mean"), F.count(F.lit(1)).alias("n_phones"))


def corpus_stats(
    events: DataFrame, keys: Sequence[str], *, snr: str = "snr_db", motion: str = "motion_index", rms: str = "channel_rms",
    corr: str = "corr_offdiag_mean",
) -> DataFrame:
    """Per corpus: segments, SNR p10/p50/p90, median motion, mean channel RMS and mean correlation."""
    keys = list(keys)
    counts = events.groupBy(*keys).agg(F.count(motion).alias("n_segments"), F.avg(corr).alias("corr_offdiag_mean"))
    levels = exact_percentiles(events, keys, snr, {"snr_p10": 0.1, "median_snr_db": 0.5, "snr_p90": 0.9})
    moved = exact_percentiles(events, keys, motion, {"median_motion_index": 0.5})
    mean_rms = centroids(events, keys, rms).select(*keys, F.col("centroid").alias("channel_rms"))
    return counts.join(levels, keys, "left").join(moved, keys, "left").join(mean_rms, keys, "left")


def corpus_match(stats: DataFrame, corpus: str, reference: str) -> DataFrame:
    """Distance of every corpus from the reference one; lower is closer, ``rank`` 1 is best.

    Inputs are one row per corpus.
    """
    names = [c for c in stats.columns if c != corpus]
    base = stats.where(F.col(corpus) == reference).select(F.struct(*[F.col(c).alias(f"_{c}") for c in names]))
    others = stats.where(F.col(corpus) != reference).withColumn("_base", base.scalar()).select("*", "_base.*").drop("_base")
    others = once(others, _na=norm(F.col("channel_rms")), _nb=norm(F.col("_channel_rms")))
    own = F.transform("channel_rms", lambda v: v / (F.col("_na") + F.lit(1e-9)))
    real = F.transform("_channel_rms", lambda v: v / (F.col("_nb") + F.lit(1e-9)))
    gap = F.abs(F.col("median_snr_db") - F.col("_median_snr_db")) / 5
    scored = others.select(
        corpus,
        F.coalesce(gap, F.lit(5.0)).alias("snr_part"),
        distance(own, real).alias("rms_part"),
        F.abs(F.col("corr_offdiag_mean") - F.col("_corr_offdiag_mean")).alias("corr_part"),
        F.abs(F.col("median_motion_index") - F.col("_median_motion_index")).alias("motion_part"),
    )
    return scored.withColumn("total", F.col("snr_part") + F.col("rms_part") + F.col("corr_part") + F.col("motion_part"))
