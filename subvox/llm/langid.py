"""Language identification with interpolated Kneser-Ney character models.

Texts become lower-case letters with single blanks between words. Every language has one character model of
order ``ORDER``; the models share sorted arrays of n-gram hashes, one per order, with one column of log
probabilities per language, so that a text is looked up once for all languages. The language with the lowest
cross-entropy per character wins; a text is rejected when that entropy lies beyond what held-back
training texts of the language show at its length.

Bounds of what is fitted (both parameters of ``fit``): at most ``ROWS`` labelled texts per language, whole, and the
``GRAMS`` most frequent n-grams of each order and language. Every text of any length is scored whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
ROWS = 400
LANGUAGES = 200
GRAMS = 60_000
#: One in so many sampled texts is held back to calibrate rejection.
HOLD = 4
#: Rejection leaves this much room beyond the most unusual held-back text.
ROOM = 2.0
#: Letters from which on a text's entropy varies by its style rather than by chance.
STYLE = 200
#: Letters per unit of evidence in the score.
EVIDENCE = 40
DISCOUNT = 0.75
#: Code points scored at once.
SLICE = 1 << 19
UND = "und"
_B = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 32 (a blank) for all else; filled in blocks on first use."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x32000):  # the planes above hold no letters but rare ideographs, which stand for themselves
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0]) if low else c
    for c in range(0x32000, 0x33480):
        table[c] = c if chr(c).isalpha() else 32
    return table


def normalized(text: str) -> np.ndarray:
    """Letters in lower case, one blank around and between words; empty without a letter."""
    cp = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    cp = np.concatenate([[np.uint32(32)], cp, [np.uint32(32)]])
    blank = cp == 32
    cp = cp[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    return cp if len(cp) > 1 else cp[:0]


def gram_hashes(cp: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, for n = 1 to ORDER (n-th array: from position n - 1 on)."""
    one = (cp.astype(np.uint64) + np.uint64(1)) * _M
    one ^= one >> np.uint64(32)
    out = [one]
    for n in range(2, ORDER + 1):
        out.append(out[-1][:-1] * _B + one[n - 1 :])
    return out


def spread(n):
    """How far entropies of texts of ``n`` letters scatter, up to a factor."""
    return np.sqrt(1 / n + 1 / STYLE)


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # per order: sorted hashes
    logs: list[np.ndarray]  # per order: log probability, a column per language
    heads: list[np.ndarray]  # per order above 1: sorted context hashes
    backs: list[np.ndarray]  # per order above 1: log weight of the shorter model, a column per language
    floor: float
    limits: np.ndarray  # per language: mean entropy, allowed excess in units of `spread`

    def look_up(self, hashes: list[np.ndarray], order: int, at: np.ndarray) -> np.ndarray:
        """Log probabilities at positions ``at`` by the model of ``order``, backing off where the n-gram is unknown."""
        if order == 0:
            return np.full((len(at), len(self.languages)), self.floor, np.float32)
        mine = hashes[order - 1][at - order + 1]
        table = self.grams[order - 1]
        if not len(table):
            return self.look_up(hashes, order - 1, at)
        place = np.minimum(np.searchsorted(table, mine), len(table) - 1)
        known = table[place] == mine
        out = self.logs[order - 1][place]
        lost = np.flatnonzero(~known)
        if len(lost):
            rest = self.look_up(hashes, order - 1, at[lost])
            if order > 1:
                head = hashes[order - 2][at[lost] - order + 1]
                heads = self.heads[order - 1]
                where = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
                rest = rest + np.where((heads[where] == head)[:, None], self.backs[order - 1][where], np.float32(0))
            out[lost] = rest
        return out

    def sums(self, cp: np.ndarray) -> np.ndarray:
        """Sum of log probabilities of a normalised text, per language."""
        total = np.zeros(len(self.languages))
        for start in range(0, len(cp), SLICE):
            front = max(start - ORDER + 1, 0)
            part = cp[front : start + SLICE]
            hashes = gram_hashes(part)
            first = start - front
            for p in range(max(first, 1), min(ORDER - 1, len(part))):  # the text's first characters have short contexts
                total += self.look_up(hashes, p + 1, np.array([p]))[0]
            at = np.arange(max(first, ORDER - 1), len(part))
            if len(at):
                total += self.look_up(hashes, ORDER, at).sum(0, dtype=np.float64)
        return total

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """``language, score, entropy, rejected``; without a letter: ``und``, 0, null, rejected."""
        cp = normalized(text or "")
        if not len(cp) or not self.languages:
            return UND, 0.0, math.nan, True
        n = len(cp) - 1
        entropy = -self.sums(cp) / n
        best = int(np.argmin(entropy))  # ties: the first language by name
        odds = np.exp(-(entropy - entropy[best]) * min(n, EVIDENCE))
        mean, room = self.limits[best]
        return self.languages[best], float(1 / odds.sum()), float(entropy[best]), bool(entropy[best] - mean > room * spread(n))


def training_rows(docs: DataFrame, key: str, text: str, lang: str, rows: int, languages: int) -> DataFrame:
    """At most ``rows`` texts of each of the most frequent languages, drawn by a hash of key and text."""
    named = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    order = F.xxhash64(F.lit("langid"), f"`{key}`", f"`{text}`")
    named = named.select(F.col(f"`{lang}`").alias("_lang"), F.col(f"`{text}`").alias("_text"), order.alias("_order"))
    top = named.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).select("_lang")
    by = Window.partitionBy("_lang").orderBy("_order")  # Spark keeps the first rows of each task before it shuffles
    ranked = named.select("_lang", "_order").withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= rows)
    drawn = F.broadcast(ranked.join(F.broadcast(top), "_lang").select("_lang", "_order").distinct())  # at most rows * languages
    return named.join(drawn, ["_lang", "_order"])


def gram_counts(texts: DataFrame, grams: int) -> DataFrame:
    """``_lang, n, gram, head, tail, count`` of the most frequent n-grams (head and tail: without the last, the first character)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("_lang"):
                for cp in map(normalized, own["_text"]):
                    for start in range(0, max(len(cp) - 1, 0), SLICE):
                        part = cp[start : start + SLICE + ORDER - 1]
                        hashes = gram_hashes(part)
                        for n, h in enumerate(hashes, 1):
                            stop = len(h) if start + SLICE + ORDER - 1 >= len(cp) else min(len(h), SLICE)
                            values, first, count = np.unique(h[:stop], return_index=True, return_counts=True)
                            inner = hashes[n - 2] if n > 1 else np.zeros(len(h) + 1, np.uint64)
                            head, tail = inner[first].view(np.int64), inner[first + 1].view(np.int64)
                            yield pd.DataFrame({"_lang": lang, "n": n, "gram": values.view(np.int64), "head": head, "tail": tail, "count": count})

    seen = texts.select("_lang", "_text").mapInPandas(run, "_lang string, n int, gram long, head long, tail long, count long")
    seen = seen.groupBy("_lang", "n", "gram", "head", "tail").agg(F.sum("count").alias("count"))
    by = Window.partitionBy("_lang", "n").orderBy(F.desc("count"), "gram")
    return seen.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= grams).drop("_rank")


def _tables(counts: pd.DataFrame, languages: list[str]) -> Model:
    """Interpolated Kneser-Ney from n-gram counts; lower orders use continuation counts."""
    raw = []  # per order: hashes, heads, tails, counts by language
    for n in range(1, ORDER + 1):
        own = counts[counts["n"] == n]
        gram, inverse = np.unique(own["gram"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        head, tail = np.zeros((2, len(gram)), np.uint64)
        head[inverse] = own["head"].to_numpy(np.int64).view(np.uint64)
        tail[inverse] = own["tail"].to_numpy(np.int64).view(np.uint64)
        table = np.zeros((len(gram), len(languages)))
        np.add.at(table, (inverse, own["_lang"].map({c: i for i, c in enumerate(languages)}).to_numpy(int)), own["count"].to_numpy(float))
        raw.append((gram, head, tail, table))
    logs, heads, backs = [], [np.empty(0, np.uint64)], [np.empty((0, len(languages)))]
    alphabet = max(len(raw[0][0]), 1) + 1
    below: np.ndarray | None = None
    for n in range(1, ORDER + 1):
        gram, front, shorter, table = raw[n - 1]
        if n < ORDER and len(raw[n][0]):  # continuation counts: distinct characters in front
            _, _, inner, seen = raw[n]
            place = np.minimum(np.searchsorted(gram, inner), len(gram) - 1)
            ok = gram[place] == inner
            more = np.zeros_like(table)
            np.add.at(more, place[ok], (seen[ok] > 0).astype(float))
            used = np.where(more > 0, more, (table > 0).astype(float))
        else:
            used = table
        if n == 1:
            total = used.sum(0, keepdims=True)
            kinds = (used > 0).sum(0, keepdims=True)
            prob = np.where(total > 0, (np.maximum(used - DISCOUNT, 0) + DISCOUNT * kinds / alphabet) / np.maximum(total, 1), 1 / alphabet)
        else:
            head, inverse = np.unique(front, return_inverse=True)
            total, kinds = np.zeros((len(head), len(languages))), np.zeros((len(head), len(languages)))
            np.add.at(total, inverse, used)
            np.add.at(kinds, inverse, (used > 0).astype(float))
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            lower = raw[n - 2][0]
            place = np.minimum(np.searchsorted(lower, shorter), max(len(lower) - 1, 0))
            under = np.where((lower[place] == shorter)[:, None], below[place], 1 / alphabet) if len(lower) else np.full_like(used, 1 / alphabet)
            prob = np.maximum(used - DISCOUNT, 0) / np.maximum(total[inverse], 1) + weight[inverse] * under
            heads.append(head)
            backs.append(np.log(weight).astype(np.float32))
        below = prob
        logs.append(np.log(prob).astype(np.float32))
    return Model(languages, [r[0] for r in raw], logs, heads, backs, math.log(1 / alphabet), np.zeros((len(languages), 2)))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", *, rows: int = ROWS, languages: int = LANGUAGES, grams: int = GRAMS) -> Model:
    """Fits on the labelled rows of ``docs``. Null texts and labels teach nothing; no labelled row: a model without languages."""
    held = F.pmod(F.col("_order"), F.lit(HOLD)) == 0
    sample = training_rows(docs, key, text, lang, rows, languages).persist()
    counts = gram_counts(sample.where(~held), grams).toPandas()
    names = sorted(counts["_lang"].unique())
    model = _tables(counts, names)
    if not names:
        sample.unpersist()
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, t in zip(batch["_lang"], batch["_text"]):
                cp = normalized(t)
                if len(cp) and lang in shared.value.languages:
                    n = len(cp) - 1
                    out.append((lang, float(-shared.value.sums(cp)[shared.value.languages.index(lang)] / n), n))
            yield pd.DataFrame(out, columns=["_lang", "entropy", "n"])

    seen = sample.where(held).select("_lang", "_text").mapInPandas(run, "_lang string, entropy double, n long").toPandas()
    sample.unpersist()
    for i, name in enumerate(names):
        own = seen[seen["_lang"] == name]
        if len(own):
            mean = float(np.average(own["entropy"], weights=np.sqrt(own["n"])))
            excess = float(((own["entropy"] - mean) / spread(own["n"])).max())
            model.limits[i] = mean, max(excess, 1.0) * ROOM
        else:
            model.limits[i] = 0.0, math.inf
    return model


def identify(docs: DataFrame, model: Model, text: str = "text"):
    """Column ``struct<lang_pred, score, entropy, rejected>`` of the column ``text``; see ``Model.judge``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, entropy double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([shared.value.judge(t) for t in batch], columns=["lang_pred", "score", "entropy", "rejected"])

    return judge(F.col(f"`{text}`"))
