"""From frame posteriors to words: collapse, lexicon scores, trial decoding, weight tuning.

Input is ``frame_posteriors(utt_id, frame, logp array<double>)``; class 0 is the blank. An
utterance is one spoken word or phrase (the live path cuts it at 15 s), so its frames fit one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subvox.functions.fixed import LM_WEIGHTS, PHONES
from subvox.operators.lexicon import phone_code
from subvox.operators.lm import TrialLM, slot_candidates
from subvox.plans.inorder import in_order
from subvox.plans.joins import spread_join
from subvox.plans.ordered import drop_halo, halo_window, with_halo
from subvox.session import cut_lineage

NEVER = -1e30
#: Word pairs and triples of a model that a task may hold; trees of slots that it keeps.
MODEL_ROWS = 200_000
TREES = 64


def frame_classes(posteriors: DataFrame) -> DataFrame:
    """Most likely class of each frame, the first on ties."""
    best = (F.array_position("logp", F.array_max("logp")) - 1).cast("int")
    return posteriors.withColumn("cls", best)


def greedy_collapse(posteriors: DataFrame, key: str = "utt_id", chunk: int = 65_536) -> DataFrame:
    """Phones of each utterance: repeats merged, blanks dropped."""
    near = with_halo(frame_classes(posteriors).select(key, "frame", "cls"), [key], "frame", chunk=chunk, before=1)
    fresh = F.coalesce(F.lag("cls").over(halo_window([key], "frame")) != F.col("cls"), F.lit(True))
    kept = drop_halo(near.withColumn("_new", fresh)).withColumn("_keep", F.col("_new") & (F.col("cls") > 0))
    names = F.array(*map(F.lit, PHONES))
    pairs = F.sort_array(F.collect_list(F.when(F.col("_keep"), F.struct("frame", "cls"))))
    out = kept.groupBy(key).agg(pairs.alias("_p"))
    return out.select(key, F.transform("_p", lambda p: F.get(names, p["cls"])).alias("phones"))


def utterance_rows(posteriors: DataFrame, key: str = "utt_id", carry: Sequence[str] = ()) -> DataFrame:
    """One row per utterance with its frames in order."""
    frames = F.sort_array(F.collect_list(F.struct("frame", "logp")))
    out = posteriors.groupBy(key).agg(*[F.first(c).alias(c) for c in carry], frames.alias("_f"))
    return out.withColumn("logp", F.col("_f.logp")).drop("_f")


class PhoneTrie:
    """Words as a tree of phones: words that begin alike share the states of their common phones.

    A node has two states, its phone and the blank after it; the root is the blank before the first phone. Nodes come after their parents.
    """

    def __init__(self, words: Sequence[Sequence[int]]):
        nodes: dict[tuple[int, int], int] = {}
        parent, phone, ends = [0], [0], []
        for word in words:
            node = 0
            for p in word:
                if (node, p) not in nodes:
                    nodes[node, p] = len(parent)
                    parent.append(node)
                    phone.append(p)
                node = nodes[node, p]
            ends.append(node)
        self.parent, self.phone, self.ends = np.array(parent), np.array(phone), np.array(ends, int)
        # A phone follows another one directly unless they are the same.
        self.direct = (self.parent > 0) & (self.phone != self.phone[self.parent])

    def best(self, logp: np.ndarray) -> np.ndarray:
        """Score of the best path of every word over the frames ``logp`` (frames x classes)."""
        said = np.where(self.parent == 0, logp[0][self.phone], NEVER)
        said[0] = NEVER
        rest = np.full(len(said), NEVER)
        rest[0] = logp[0][0]
        for emit in logp[1:]:
            came = np.maximum(rest[self.parent], np.where(self.direct, said[self.parent], NEVER))
            rest, said = np.maximum(rest, said) + emit[0], np.maximum(said, came) + emit[self.phone]
            said[0] = NEVER
        return np.maximum(said, rest)[self.ends]


def lexicon_scores(utterances: DataFrame, lm: TrialLM, lexicon: DataFrame, *, topk: int | None = None, key: str = "utt_id") -> DataFrame:
    """``(utt, slot, word, score, rank)`` of the candidates of each utterance's slot.

    ``utterances(key, slot, logp array<array>)``. All words of a slot are kept, or the ``topk``
    best. An utterance row meets one array of its slot's words (a closed vocabulary), so its posteriors are not repeated per word;
    a task makes one tree of phones per slot.
    """
    ids = {p: i for i, p in enumerate(PHONES)}
    spoken = lexicon.where(F.size("phones") > 0)
    slots = slot_candidates(utterances.select("slot").distinct(), lm, spoken).join(spoken, "word")
    lists = slots.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("word", "phones"))).alias("_w"))
    met = spread_join(utterances.select(key, "slot", "logp"), lists, ["slot"], salt_by=[key])
    ktype = utterances.schema[key].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[int, tuple[list[str], PhoneTrie]] = {}
        for pdf in batches:
            for utt, slot, logp, cands in zip(pdf[key], pdf["slot"], pdf["logp"], pdf["_w"]):
                if slot not in trees:
                    if len(trees) == TREES:
                        trees.pop(next(iter(trees)))
                    trees[slot] = [c["word"] for c in cands], PhoneTrie([[ids[p] for p in c["phones"] if p in ids] for c in cands])
                words, tree = trees[slot]
                values = tree.best(np.vstack(list(logp)))
                order = np.lexsort((np.arange(len(words)), -values))
                order = order[:topk]
                yield pd.DataFrame(
                    {key: utt, "slot": slot, "word": [words[i] for i in order], "score": values[order], "rank": np.arange(1, len(order) + 1)}
                )

    return met.mapInPandas(score, f"{key} {ktype}, slot bigint, word string, score double, rank int")


def phone_penalty(scores: DataFrame, greedy: DataFrame, lexicon: DataFrame, weight: float, slots: Sequence[int] = (2, 3), key: str = "utt_id") -> DataFrame:
    """Lowers scores in the given slots by the edit distance to the greedy phones per phone of the word."""
    said = greedy.select(key, phone_code(F.col("phones")).alias("_g"))
    codes = lexicon.select("word", phone_code(F.col("phones")).alias("_c"))
    joined = spread_join(scores.join(said, key), codes, ["word"], salt_by=[key])
    cost = F.lit(weight) * F.levenshtein("_g", "_c") / F.greatest(F.length("_c"), F.lit(1))
    return joined.withColumn("score", F.col("score") - F.when(F.col("slot").isin(list(slots)), cost).otherwise(0.0)).drop("_g", "_c")


def decode_trials(
    candidates: DataFrame, lm: TrialLM, n_slots: int, *, keys: Sequence[str] = ("trial_id",), weight: str = "weight", model_rows: int = MODEL_ROWS
) -> DataFrame:
    """Words of each trial in slot order, each chosen given the words chosen before it.

    ``candidates(keys, slot, word, score, weight)``; rows without a word or a score are left out. With ``weight`` 0 or less only the score counts.
    One pass follows all trials through their slots, with the model's word pairs and triples at hand if there are at most ``model_rows``;
    a larger model is joined slot by slot. Both give the same words.
    """
    keys = list(keys)
    sizes = lm.slot_words.groupBy("slot").agg(F.count(F.lit(1)).alias("_v"))
    known = candidates.where(F.col("word").isNotNull() & F.col("score").isNotNull() & F.col("slot").between(0, n_slots - 1))
    base = spread_join(known, sizes, ["slot"], "left", salt_by=[*keys, "word"])
    base = spread_join(base, lm.slot.withColumnRenamed("logp", "_s"), ["slot", "word"], "left", salt_by=keys)
    base = base.withColumn("_slot", F.coalesce("_s", F.log(F.lit(lm.backoff) / F.coalesce("_v", F.lit(1))))).drop("_s", "_v")
    pairs = lm.bigram.select(F.lit(None).cast("string").alias("prev2"), "prev", "word", "logp")
    grams = pairs.unionByName(lm.trigram.select("prev2", "prev", "word", "logp")).limit(model_rows + 1).collect()
    if len(grams) > model_rows:
        return _decode_by_slot(base, lm, n_slots, keys, weight)
    return _decode_in_order(base, {(r["prev2"], r["prev"], r["word"]): r["logp"] for r in grams}, lm.backoff, keys, weight)


def _decode_in_order(base: DataFrame, grams: dict[tuple, float], backoff: float, keys: list[str], weight: str) -> DataFrame:
    """One row per trial and slot, followed through the slots; the words of a slot are a closed vocabulary."""
    cands = F.struct("word", "score", F.greatest(F.col(weight), F.lit(0.0)).alias("weight"), F.col("_slot").alias("slot"))
    rows = base.select(*keys, F.col("slot").cast("long").alias("slot"), cands.alias("_c")).groupBy(*keys, "slot").agg(F.collect_list("_c").alias("_c"))
    fields = ", ".join(f"{k} {base.schema[k].dataType.simpleString()}" for k in keys)
    n, floor = len(keys), math.log(backoff)

    def follow():
        before: list[str | None] = [None, None]

        def step(row) -> list[tuple]:
            prev2, prev = before
            best = None
            for c in row[n + 1]:
                word, score = c["word"], c["score"]
                context = c["slot"] + (0.0 if prev is None else grams.get((None, prev, word), floor))
                context += 0.0 if prev2 is None else grams.get((prev2, prev, word), floor)
                rank = (-(score + c["weight"] * context), -score, word)
                best = rank if best is None else min(best, rank)
            before[:] = prev, best[2]
            return [(*row[: n + 1], best[2])]

        return step

    return in_order(rows, keys, ["slot"], f"{fields}, slot bigint, hyp string", follow)


def _decode_by_slot(base: DataFrame, lm: TrialLM, n_slots: int, keys: list[str], weight: str) -> DataFrame:
    """All trials advance together; a slot costs joins with the tables of the model."""
    floor = F.lit(math.log(lm.backoff))
    state = base.select(*keys).distinct().withColumn("prev2", F.lit(None).cast("string")).withColumn("prev", F.lit(None).cast("string"))
    chosen: list[DataFrame] = []
    for slot in range(n_slots):
        here = base.where(F.col("slot") == slot).join(state, keys)
        here = here.join(lm.bigram.withColumnRenamed("logp", "_bi"), ["prev", "word"], "left")
        here = here.join(lm.trigram.withColumnRenamed("logp", "_tri"), ["prev2", "prev", "word"], "left")
        context = (
            F.col("_slot")
            + F.when(F.col("prev").isNull(), 0.0).otherwise(F.coalesce("_bi", floor))
            + F.when(F.col("prev2").isNull(), 0.0).otherwise(F.coalesce("_tri", floor))
        )
        total = F.col("score") + F.greatest(F.col(weight), F.lit(0.0)) * context
        best = here.groupBy(*keys).agg(
            F.min(F.struct((-total).alias("t"), (-F.col("score")).alias("s"), F.col("word").alias("w")))["w"].alias("hyp")
        )
        chosen.append(best.select(*keys, F.lit(slot).cast("long").alias("slot"), "hyp"))
        state = state.join(best, keys, "left").select(
            *keys,
            F.when(F.col("hyp").isNull(), F.col("prev2")).otherwise(F.col("prev")).alias("prev2"),
            F.coalesce("hyp", "prev").alias("prev"),
        )
        if slot % 4 == 3 and slot + 1 < n_slots:
            state = cut_lineage(state)
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out


def tune_lm_weight(scores: DataFrame, refs: DataFrame, lm: TrialLM, n_slots: int, weights: Sequence[float] = LM_WEIGHTS) -> DataFrame:
    """Accuracy of every weight and the best one (the smallest on ties).

    ``scores(trial_id, slot, word, score)`` are computed once; the weights multiply the
    small candidate rows, and all of them are decoded in one run.
    """
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights]))
    runs = decode_trials(scores.withColumn("weight", grid), lm, n_slots, keys=["weight", "trial_id"])
    scored = runs.join(refs.select("trial_id", "slot", "ref"), ["trial_id", "slot"])
    acc = scored.groupBy("weight").agg(F.avg((F.col("hyp") == F.col("ref")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    best = acc.agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "weight"))["weight"])
    return acc.withColumn("best", F.col("weight") == best.scalar())


def transcript_confidence(score: Column) -> Column:
    """Confidence of a whole-lexicon transcript: ``1 + score / 80`` kept in [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 + score / 80))
