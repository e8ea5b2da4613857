"""Error rates, confusion reports, intervals and run comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from subvox.functions.arrays import once
from subvox.functions.fixed import MONTHS, WEEKDAYS, YEAR_PREFIXES
from subvox.plans.ordered import exact_percentiles


def classification_metrics(pred: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Recall, precision and F1 of every label of ``labels(label)``; absent labels get 0.

    The confusion table is built once; everything after it is small.
    """
    keys = list(keys)
    cells = pred.groupBy(*keys, "ref", "hyp").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("ref").alias("label"), F.lit("r").alias("s")),
                F.struct(F.col("hyp").alias("label"), F.lit("h").alias("s")),
            )
        ).alias("e"),
        "n",
        (F.col("ref") == F.col("hyp")).alias("ok"),
    )
    per = sides.groupBy(*keys, F.col("e.label").alias("label")).agg(
        F.sum(F.when(F.col("e.s") == "r", F.col("n")).otherwise(0)).alias("n_ref"),
        F.sum(F.when(F.col("e.s") == "h", F.col("n")).otherwise(0)).alias("n_hyp"),
        F.sum(F.when((F.col("e.s") == "r") & F.col("ok"), F.col("n")).otherwise(0)).alias("n_ok"),
    )
    if keys:
        listed = labels.groupBy().agg(F.collect_set("label")).scalar()
        names = cells.select(*keys).distinct().withColumn("_l", listed).select(*keys, F.explode("_l").alias("label"))
        per = names.join(per, [*keys, "label"], "left")
    else:
        per = labels.select("label").join(per, "label", "left")
    per = per.fillna(0, ["n_ref", "n_hyp", "n_ok"])
    both = F.col("n_ref") + F.col("n_hyp")
    return per.withColumn("recall", F.when(F.col("n_ref") > 0, F.col("n_ok") / F.col("n_ref")).otherwise(0.0)).withColumn(
        "f1", F.when(both > 0, 2 * F.col("n_ok") / both).otherwise(0.0)
    )


def split_summary(per_label: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro-F1 and size from the rows of :func:`classification_metrics`."""
    total = F.sum("n_ref")
    return per_label.groupBy(*keys).agg(
        (F.sum("n_ok") / F.when(total > 0, total)).alias("accuracy"), F.avg("f1").alias("macro_f1"), total.alias("n")
    )


def distance_rate(pairs: DataFrame, hyp: str, ref: str, keys: Sequence[str] = ()) -> DataFrame:
    """Summed edit distance over summed reference length of strings with one character
    per token. Equal pairs are measured once and weighted by their count."""
    distinct = pairs.groupBy(*keys, hyp, ref).agg(F.count(F.lit(1)).alias("_n"))
    measured = distinct.withColumn("_d", F.levenshtein(hyp, ref) * F.col("_n")).withColumn("_l", F.length(ref) * F.col("_n"))
    out = measured.groupBy(*keys).agg(F.sum("_d").alias("distance"), F.sum("_l").alias("ref_length"), F.sum("_n").alias("n"))
    return out.withColumn("rate", F.col("distance") / F.greatest(F.col("ref_length"), F.lit(1)))


def word_error_rate(pred: DataFrame, trial: str = "trial_id", slot: str = "word_idx", segment: int | None = None) -> DataFrame:
    """Corpus WER: edit distance per trial, summed, over the number of words.

    Every distinct word of a trial stands for one character, which makes the built-in string
    distance a word distance; its memory grows with the words of one trial. With ``segment``,
    runs of that many slots are aligned on their own, which can only raise the distance.
    """
    part = F.floor(F.col(slot) / segment) if segment else F.lit(0)
    lines = pred.groupBy(trial, part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct(slot, "ref", "hyp"))).alias("w"))
    lines = once(lines, known=F.array_distinct(F.concat("w.ref", "w.hyp")))

    def letters(words: Column) -> Column:
        code = lambda w: F.lpad(F.hex(F.lit(0x10000) + F.array_position("known", w)), 8, "0")
        return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(code(w)), "UTF-32")), "")

    strings = lines.select(letters(F.col("w.ref")).alias("ref"), letters(F.col("w.hyp")).alias("hyp"))
    return distance_rate(strings, "hyp", "ref").select(
        "distance", F.col("ref_length").alias("n_words"), F.col("rate").alias("wer")
    )


def error_category(ref: Column, hyp: Column, slot: Column) -> Column:
    era = F.split(ref, "_")[0] == F.split(hyp, "_")[0]
    year = (slot == 3) | ref.startswith(YEAR_PREFIXES[0]) | ref.startswith(YEAR_PREFIXES[1]) | ref.contains("thousand")
    said = hyp != ""
    return (
        F.when(ref == hyp, "correct")
        .when((slot == 0) & ref.isin(WEEKDAYS), "weekday")
        .when((slot == 1) & ref.isin(MONTHS), "month")
        .when(slot == 2, "ordinal")
        .when(
            year,
            F.when(said & F.startswith(ref, hyp), "year_truncation")
            .when(said & F.startswith(hyp, ref), "year_overgen")
            .when(said & era, "year_same_era")
            .otherwise("year_other"),
        )
        .otherwise("other")
    )


def error_taxonomy(pred: DataFrame, slot: str = "word_idx") -> DataFrame:
    """Counts by slot and error category; ``correct`` rows are a category too."""
    kind = error_category(F.col("ref"), F.col("hyp"), F.col(slot))
    return pred.groupBy(F.col(slot).alias("slot"), kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def slot_report(pred: DataFrame, slot: str = "slot") -> DataFrame:
    ok = F.sum((F.col("ref") == F.col("hyp")).cast("long"))
    n = F.count(F.lit(1))
    out = pred.groupBy(slot).agg(n.alias("n"), ok.alias("n_correct"))
    out = out.withColumn("n_errors", F.col("n") - F.col("n_correct"))
    return out.withColumn("error_rate", F.col("n_errors") / F.col("n"))


def top_confusions(pred: DataFrame, k: int = 20) -> DataFrame:
    pairs = pred.where("ref <> hyp").groupBy("ref", "hyp").agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.desc("n"), "ref", "hyp").limit(int(k))


#: Draws of one row come from sha256 texts, 16 of 16 bits from each.
DRAWS = 16


def poisson_cuts() -> list[int]:
    """The 16-bit draws from which on a Poisson(1) weight is at least 1, 2, 3, ..."""
    total, out = 0.0, []
    for k in range(12):
        total += math.exp(-1.0) / math.factorial(k)
        if round(total * 65536) < 65536:
            out.append(round(total * 65536))
    return out


def replicate_sums(rows: DataFrame, key: Sequence[str], value: str, *, replicates: int, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """``groups, _rep, _s, _n``: weighted sum of ``value`` and sum of weights per replicate, from 1.

    Every row has a Poisson(1) weight of its own in every replicate, read from sha256 of seed and key, so rows of one key are drawn together.
    A row's weights are one array; tasks add up such arrays per group and hand on one row per group. Null values are left out.
    """
    groups, replicates = list(groups), int(replicates)
    texts = [F.sha2(F.concat_ws(":", F.lit(str(int(seed))), *[F.col(k).cast("string") for k in key], F.lit(str(b))), 256) for b in range(-(-replicates // DRAWS))]
    laid = rows.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_s"), F.unhex(F.concat(*texts)).alias("_u"))
    table = np.searchsorted(poisson_cuts(), np.arange(65536), side="right").astype(np.int64)
    most = max(1, (1 << 22) // replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            names = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
            both = [pa.array([list(v[side]) for v in held.values()], pa.list_(pa.float64())) for side in (0, 1)]
            held.clear()
            return pa.RecordBatch.from_arrays([*names, *both], [*groups, "_a", "_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(g).type for g in groups]
            weight = table[np.frombuffer(b"".join(batch.column("_u").to_pylist()), ">u2").reshape(batch.num_rows, -1)[:, :replicates]]
            codes: dict[tuple, int] = {}
            of = zip(*[batch.column(g).to_pylist() for g in groups]) if groups else [()] * batch.num_rows
            code = np.array([codes.setdefault(k, len(codes)) for k in of])
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(codes)))
            weight, values = weight[order].astype(float), batch.column("_s").to_numpy(zero_copy_only=False)[order]
            sums = np.stack([np.add.reduceat(weight * values[:, None], starts), np.add.reduceat(weight, starts)], axis=1)
            for k, part in zip(codes, sums):
                held[k] = held[k] + part if k in held else part
            if len(held) > most:
                yield flush()
        if held:
            yield flush()

    fields = [*[StructField(g, rows.schema[g].dataType) for g in groups], *[StructField(c, ArrayType(DoubleType())) for c in ("_a", "_b")]]
    parts = laid.mapInArrow(run, StructType(fields)).select(*groups, F.posexplode(F.arrays_zip("_a", "_b")).alias("_at", "_v"))
    sums = parts.groupBy(*groups, (F.col("_at") + 1).alias("_rep")).agg(F.sum("_v._a").alias("_s"), F.sum("_v._b").alias("_n"))
    return sums.where("_n > 0")


def _interval(means: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    p = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    out = means.groupBy(*groups).agg(F.avg("_m").alias("mean"), p.alias("_p"), F.count("_m").alias("n_bootstrap"))
    return out.select(*groups, "mean", F.col("_p")[0].alias("ci95_low"), F.col("_p")[1].alias("ci95_high"), "n_bootstrap")


def bootstrap_ci(scored: DataFrame, key: Sequence[str], score: str, *, replicates: int = 200, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """Mean and 95 % interval of the mean of ``score`` under resampling of rows (Poisson bootstrap, ``replicate_sums``).

    Replicates in which no row is drawn do not count; without rows ``groups`` have no row, and no groups one of nulls.
    """
    sums = replicate_sums(scored, key, score, replicates=replicates, seed=seed, groups=groups)
    return _interval(sums.select(*groups, (F.col("_s") / F.col("_n")).alias("_m")), groups)


def bootstrap_macro_f1_ci(pred: DataFrame, key: Sequence[str], labels: DataFrame, *, replicates: int = 200, seed: int = 0) -> DataFrame:
    """The same for macro-F1 over ``labels(label)``: confusion cells are the groups."""
    cells = replicate_sums(pred.withColumn("_one", F.lit(1.0)), key, "_one", replicates=replicates, seed=seed, groups=["ref", "hyp"])
    hit = F.when(F.col("ref") == F.col("hyp"), F.col("_n")).otherwise(0.0)
    sides = F.array(
        F.struct(F.col("ref").alias("label"), F.col("_n").alias("a"), hit.alias("t")),
        F.struct(F.col("hyp").alias("label"), F.col("_n").alias("a"), F.lit(0.0).alias("t")),
    )
    per = cells.select("_rep", F.explode(sides).alias("e")).groupBy("_rep", F.col("e.label").alias("label")).agg(F.sum("e.a").alias("a"), F.sum("e.t").alias("t"))
    known = labels.select("label").distinct()
    per = per.join(known, "label", "left_semi")
    n_labels = known.agg(F.count(F.lit(1))).scalar()
    f1 = F.sum(F.when(F.col("a") > 0, 2 * F.col("t") / F.col("a")).otherwise(0.0))
    return _interval(per.groupBy("_rep").agg(f1.alias("_f")).select((F.col("_f") / n_labels).alias("_m")))


def pooled_summary(scored: DataFrame, run: str, key: Sequence[str], score: str, *, replicates: int = 200, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """``n_runs``, mean and population deviation of the runs' mean scores, and the interval of the rows of all runs together.

    ``key`` names a row within its run; a row is drawn by run and key.
    """
    each = scored.groupBy(*groups, run).agg(F.avg(score).alias("_score"))
    over = each.groupBy(*groups).agg(F.count("_score").alias("n_runs"), F.avg("_score").alias("run_mean"), F.stddev_pop("_score").alias("run_std"))
    pooled = bootstrap_ci(scored, [run, *key], score, replicates=replicates, seed=seed, groups=groups)
    if groups:
        match = F.lit(True)
        for g in groups:
            match = match & over[g].eqNullSafe(pooled[g])
        return over.join(pooled, match).drop(*[pooled[g] for g in groups])
    one = F.lit(1).alias("_one")
    return over.select("*", one).join(pooled.select("*", one), "_one").drop("_one")


def multiseed_summary(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of run metrics over seeds."""
    aggs = [F.count(F.lit(1)).alias("n_seeds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return runs.groupBy(*keys).agg(*aggs)


def latency_percentiles(samples: DataFrame, stage: str = "stage", ms: str = "ms", budget_ms: float = 500.0) -> DataFrame:
    """p50, p95, p99, mean and n per stage; ``within_budget`` tests the sum of p95 of all stages."""
    points = exact_percentiles(samples, [stage], ms, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    rest = samples.groupBy(stage).agg(F.avg(ms).alias("mean_ms"), F.count(ms).alias("n"))
    out = points.join(rest, stage)
    total = F.sum("p95_ms").over(Window.partitionBy())
    return out.withColumn("total_p95_ms", total).withColumn("within_budget", F.col("total_p95_ms") <= budget_ms)


def best_run(runs: DataFrame, metric: str, run: str, keys: Sequence[str] = (), lower: bool = False) -> DataFrame:
    """Run with the best metric, the smallest run name on ties."""
    sign = 1 if lower else -1
    pick = F.min(F.struct((sign * F.col(metric)).alias("m"), F.col(run).alias("r"))).alias("_b")
    return runs.where(F.col(metric).isNotNull()).groupBy(*keys).agg(pick).select(
        *keys, F.col("_b.r").alias(run), (sign * F.col("_b.m")).alias(metric)
    )
