"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its inner s-mers stands at one of
its two ends. The choice looks at the k-mer alone, so an unchanged passage keeps its anchors
wherever it moves. A fingerprint is the sorted list of the smallest anchor hashes (a bottom-k sketch),
as hexadecimal digits; the likeness of two fingerprints estimates the Jaccard similarity of the
anchor sets and is exact for texts with few anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subvox.llm.common import partitions

K, S = 16, 8
KEEP = 128
#: Code points hashed at once; longer texts go through in overlapping slices.
SLICE = 1 << 20
_B = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def anchors(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of one slice (K = 2 * S, a power of two)."""
    if len(cp) < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, width, base, short = cp.astype(np.uint64), 1, _B, None
    while width < K:  # hashes of doubled width from two of half the width
        if width == S:
            short = h
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), width * 2
    inner = _mix(short)
    least, span, want = inner, 1, K - S + 1
    while span * 2 <= want:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[: len(inner) - want + 1], least[want - span :])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[want - 1 :] == least))
    return at, _mix(h[at])


def fingerprint(text: str | None) -> np.ndarray:
    """The smallest ``KEEP`` anchor hashes (32 bits), sorted. Empty or null: none. Without an anchor: one hash of the text."""
    text = text or ""
    cp, kept = code_points(text), np.empty(0, np.uint32)
    for start in range(0, max(len(cp) - K + 1, 0), SLICE):
        found = (anchors(cp[start : start + SLICE + K - 1])[1] >> np.uint64(32)).astype(np.uint32)
        kept = np.unique(np.concatenate([kept, found]))[:KEEP]
    if text and not len(kept):
        kept = np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4], "<u4")
    return kept


def digits(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def parse(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the smallest ``KEEP`` of both; two empty ones are alike (1)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    double = both[1:][both[1:] == both[:-1]]
    union = np.unique(both)[:KEEP]
    return float(np.searchsorted(double, union[-1], "right") / len(union))


def anchor_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per anchor: ``key, position, anchor`` (for positional matching). Null and short texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch["_key"], batch["_text"]):
                cp = code_points(t or "")
                for start in range(0, max(len(cp) - K + 1, 0), SLICE):
                    at, h = anchors(cp[start : start + SLICE + K - 1])
                    yield pd.DataFrame({key: k, "position": at + start, "anchor": h.view(np.int64)})

    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, position long, anchor long")


def with_next(docs: DataFrame, work, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs ``work(key, text, next_text) -> tuple`` over documents in descending order of the key.

    The last one's next is the first. Rows go into buckets of consecutive keys, and the first row
    of each bucket is handed to the bucket before it as well; a task reads its buckets in
    order and holds two texts. Only bucket borders (a number fixed by the partition count) reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    n = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] or []
    borders = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    bucket = F.when(F.col("_key").isNull(), F.lit(n)).otherwise(F.size(F.filter(borders, lambda b: b > F.col("_key"))))
    rows = rows.withColumn("_bucket", bucket)
    heads = sorted(tuple(r) for r in rows.groupBy("_bucket").agg(F.max("_key").alias("_head")).collect())
    if not heads:
        return rows.limit(0).mapInPandas(lambda it: iter(()), schema)
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    listed = spark.createDataFrame([(b, before[b], h) for b, h in heads], "_b int, _before int, _head long")
    rows = rows.join(F.broadcast(listed), F.col("_bucket") == F.col("_b"))
    own = F.struct(F.col("_bucket").alias("to"), F.lit(False).alias("halo"))
    halo = F.struct(F.col("_before").alias("to"), F.lit(True).alias("halo"))
    to = F.when(F.col("_key").eqNullSafe(F.col("_head")), F.array(own, halo)).otherwise(F.array(own))
    rows = rows.select("_key", "_text", F.explode(to).alias("_to"))
    rows = rows.select("_key", "_text", F.col("_to.to").alias("_bucket"), F.col("_to.halo").alias("_halo"))
    rows = rows.repartition(partitions(spark), "_bucket").sortWithinPartitions(
        "_bucket", "_halo", F.col("_key").desc_nulls_last(), F.xxhash64("_text").desc()
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, done = None, False  # the row that waits for its next one; whether the bucket's halo has come
        state: dict = {}
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for batch in batches:
            out = []
            for k, t, b, h in zip(batch["_key"], batch["_text"], batch["_bucket"], batch["_halo"]):
                if held is not None and held[2] == b:
                    out.append(work(held[0], held[1], t, state))
                held = None if h else (None if pd.isna(k) else int(k), t, b)
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def fingerprints_against_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and both likenesses.

    Edited: the last third replaced by as much of the next document's start. Null text counts as
    empty; null keys come last; repeated keys follow each other in the order of a text hash; a sole row is its
    own next; an empty table gives no rows.
    """

    def work(k, t, after, state):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        # A row's sketch was made when it was the next one of the row before it.
        mine = state["sketch"] if state.get("of") is t else fingerprint(t)
        theirs, changed = fingerprint(after), fingerprint(edited)
        state["of"], state["sketch"] = after, theirs
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return k, len(t), sha, digits(mine), digits(changed), likeness(mine, changed), likeness(mine, theirs)

    schema = f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, work, schema, key, text)
