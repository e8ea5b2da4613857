"""Trial language model: slot, bigram and trigram log probabilities as three tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subvox.functions.fixed import MONTHS, TRAIN_TRIALS, WEEKDAYS
from subvox.plans.joins import spread_join
from subvox.plans.ordered import drop_halo, halo_window, with_halo
from subvox.session import cut_lineage

#: Words of one trial that a window task sees at once; longer trials are split with a halo.
TRIAL_CHUNK = 4096


@dataclass(frozen=True)
class TrialLM:
    slot: DataFrame  # slot, word, logp
    bigram: DataFrame  # prev, word, logp
    trigram: DataFrame  # prev2, prev, word, logp
    slot_words: DataFrame  # slot, word: allowed candidates (counted words and fixed sets)
    backoff: float = 0.1

    def saved(self) -> TrialLM:
        """The same model with its tables written once; for use in many joins."""
        return replace(self, **{f: cut_lineage(getattr(self, f)) for f in ("slot", "bigram", "trigram", "slot_words")})


def with_history(events: DataFrame, trial: str = "trial_id", slot: str = "word_idx", word: str = "label") -> DataFrame:
    """Adds the previous two words of the trial."""
    near = with_halo(events, [trial], slot, chunk=TRIAL_CHUNK, before=2)
    w = halo_window([trial], slot)
    near = near.withColumn("prev", F.lag(word, 1).over(w)).withColumn("prev2", F.lag(word, 2).over(w))
    return drop_halo(near)


def _smooth(count: Column, total: Column, vocab: Column) -> Column:
    return F.log((count + F.lit(0.1)) / (total + F.lit(0.1) * vocab))


def _conditional(counts: DataFrame, context: list[str]) -> DataFrame:
    totals = counts.groupBy(*context).agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_v"))
    joined = spread_join(counts, totals, context, salt_by=["word"])
    return joined.select(*context, "word", _smooth(F.col("n"), F.col("_t"), F.col("_v")).alias("logp"))


def fit_trial_lm(
    events: DataFrame, *, max_trial: int = TRAIN_TRIALS, trial: str = "trial_id", slot: str = "word_idx", word: str = "label",
    date_slots: bool = True,
) -> TrialLM:
    """Counts on the training trials, then ``ln((c + .1) / (total + .1 * vocabulary))``.

    The words are counted once as ``(slot, prev2, prev, word)``; the three models are
    sums of that table, which is written once, so events are read and shuffled once.
    """
    words = with_history(events.where(F.col(trial) < max_trial).select(trial, slot, word), trial, slot, word)
    grams = cut_lineage(
        words.groupBy(F.col(slot).cast("long").alias("slot"), "prev2", "prev", F.col(word).alias("word")).agg(
            F.count(F.lit(1)).alias("n")
        )
    )

    def counts(*cols: str) -> DataFrame:
        known = grams
        for c in cols:
            known = known.where(F.col(c).isNotNull())
        return known.groupBy(*cols).agg(F.sum("n").alias("n"))

    slot_counts = counts("slot", "word")
    allowed = slot_counts.select("slot", "word")
    if date_slots:
        sets = F.when(F.col("slot") == 0, F.array(*map(F.lit, WEEKDAYS))).when(F.col("slot") == 1, F.array(*map(F.lit, MONTHS)))
        extra = slot_counts.select("slot").distinct().where("slot < 2").select("slot", F.explode(sets).alias("word"))
        allowed = allowed.unionByName(extra).distinct()
    return TrialLM(
        slot=_conditional(slot_counts, ["slot"]),
        bigram=_conditional(counts("prev", "word"), ["prev"]),
        trigram=_conditional(counts("prev2", "prev", "word"), ["prev2", "prev"]),
        slot_words=allowed,
    )


def slot_candidates(items: DataFrame, lm: TrialLM, lexicon: DataFrame | None = None) -> DataFrame:
    """``items(slot, ...)`` times the words allowed in their slot; with a lexicon, slots
    without any word get the whole lexicon."""
    cands = lm.slot_words
    if lexicon is not None:
        known = cands.join(lexicon.select("word").distinct(), "word", "left_semi")
        unseen = items.select("slot").distinct().join(known.select("slot").distinct(), "slot", "left_anti")
        # The lexicon is a closed vocabulary; one array of it serves the few slots without words.
        whole = lexicon.groupBy().agg(F.collect_set("word")).scalar()
        cands = known.unionByName(unseen.withColumn("_w", whole).select("slot", F.explode("_w").alias("word")))
    return spread_join(items, cands, ["slot"])


def lm_score(candidates: DataFrame, lm: TrialLM) -> DataFrame:
    """Adds ``lm_score`` to rows of ``slot, word, prev, prev2`` (null history = start of trial)."""
    sizes = lm.slot_words.groupBy("slot").agg(F.count(F.lit(1)).alias("_v"))
    out = candidates.join(lm.slot.withColumnRenamed("logp", "_s"), ["slot", "word"], "left")
    out = spread_join(out, sizes, ["slot"], "left", salt_by=["word", "prev", "prev2"])
    out = out.withColumn("_slot", F.coalesce("_s", F.log(F.lit(lm.backoff) / F.coalesce("_v", F.lit(1)))))
    out = out.join(lm.bigram.withColumnRenamed("logp", "_bi"), ["prev", "word"], "left")
    out = out.join(lm.trigram.withColumnRenamed("logp", "_tri"), ["prev2", "prev", "word"], "left")
    floor = F.lit(math.log(lm.backoff))
    score = (
        F.col("_slot")
        + F.when(F.col("prev").isNull(), 0.0).otherwise(F.coalesce("_bi", floor))
        + F.when(F.col("prev2").isNull(), 0.0).otherwise(F.coalesce("_tri", floor))
    )
    return out.withColumn("lm_score", score).drop("_s", "_v", "_slot", "_bi", "_tri")


def predict_teacher_forced(events: DataFrame, lm: TrialLM, *, trial: str = "trial_id", slot: str = "word_idx", word: str = "label") -> DataFrame:
    """Best word of every slot given the true previous words.

    A guess depends on ``(slot, prev2, prev)`` only, so candidates are scored once per
    distinct context and joined back: the work does not grow with repeated contexts.
    """
    known = with_history(events, trial, slot, word).withColumn("slot", F.col(slot).cast("long"))
    contexts = known.select("slot", "prev2", "prev").distinct()
    scored = lm_score(slot_candidates(contexts, lm), lm)
    rank = F.struct((-F.round("lm_score", 6)).alias("s"), F.col("word").alias("w"))
    best = scored.groupBy("slot", "prev2", "prev").agg(F.min(rank).alias("_b"))
    best = best.select("slot", F.col("prev2").alias("_p2"), F.col("prev").alias("_p1"), F.col("_b.w").alias("hyp"))
    out = known.alias("k").join(
        best.alias("b"),
        (F.col("k.slot") == F.col("b.slot")) & F.col("k.prev2").eqNullSafe(F.col("b._p2")) & F.col("k.prev").eqNullSafe(F.col("b._p1")),
        "left",
    )
    return out.select("k.*", "b.hyp")
