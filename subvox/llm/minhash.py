"""Near-duplicate documents by one-permutation MinHash.

Each document's distinct word shingles are hashed once and dealt into ``BINS`` bins; a bin keeps its smallest
hash, and an empty bin borrows from a full one by optimal densification (a fixed sequence of bins per
empty bin, the same for all documents). ``ROWS`` bins make a band; documents that agree on a band share a bucket.

Documents with equal shingle sets are one class, and only its smallest id goes on. A bucket does not emit its pairs:
its smallest member is the centre of a star, and each edge centre-member is checked on the full sets. Then
components are found. In buckets that still hold several of them, each member is held against a hub, a document
in the middle of the bucket's main component. Two members that are not in one component can only be linked if they
differ from the hub in the same shingles; a filter on the rarest of these names the pairs to check. Members
far from the hub are compared in rounds of growing size, where sizes, the distances to the hub (Jaccard distance
is a metric) and the shingles that a document alone has settle most pairs without their sets. This ends when each
bucket is one component or is used up, so no pair of different components that shares a bucket stays undecided.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from subvox.llm.common import fresh, saved

#: Bands of ROWS bins: two sets of Jaccard similarity 0.8 miss each other with probability (1 - 0.8^6)^48 < 1e-6.
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
SHINGLE = 5
PERCENT = 80
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes whose words are hashed at once; longer texts go through in slices that end at white space.
SLICE = 1 << 20
#: Words of more bytes are hashed by SHA-256: sums modulo 2^64 can meet for long regular words, whatever the base.
LONG = 64
_BASE = 0x9E3779B97F4A7C15
_BLANKS = b" \t\n\v\f\r"
_BLANK = np.isin(np.arange(256), list(_BLANKS))
_SPACE = re.compile(b"[" + _BLANKS + b"]")
#: Probes per empty bin that are looked up at once.
PROBES = 64
#: Jaccard distance from a hub up to which documents are compared by what they differ in.
NEAR = 0.5
#: Outsiders per bucket that are compared in the first round after the stars; each further round takes so many times more.
CENTRES = 16


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    one = np.full(SLICE, 1, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(inverse)
    return np.cumprod(up), np.cumprod(down)


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.sha256(word).digest()[:8])


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word, A-Z in lower case; a word is a run without ASCII white space."""
    data, out, at = (text or "").encode("utf-8", "surrogatepass").lower(), [], 0
    while at < len(data):
        upto = min(at + SLICE, len(data))
        if upto < len(data) and not _BLANK[data[upto]]:  # the word that is cut goes to the next slice, if another one stands before it
            whole = max(data.rfind(c, at, upto) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            if whole >= 0:
                upto = whole + 1
            else:  # a word longer than a slice
                space = _SPACE.search(data, upto)
                upto = space.start() if space else len(data)
                out.append(np.array([_digest(data[at:upto])], np.uint64))
                at = upto
                continue
        x = np.frombuffer(data, np.uint8, upto - at, at)
        blank = np.concatenate([[True], _BLANK[x], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edge[::2], edge[1::2]
        up, down = _powers()
        total = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)])])
        h = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > LONG):
            h[i] = _digest(data[at + start[i] : at + end[i]])
        out.append(h)
        at = upto
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; fewer words: one hash of the whole sequence; none: empty."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = _mix(out ^ h[i : len(h) - n + 1 + i])
    return np.unique(out)


@functools.cache
def _probes(first: int) -> np.ndarray:
    """Bins that each empty bin tries in turn, the same for all documents."""
    seed = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(_BASE) + np.arange(first, first + PROBES, dtype=np.uint64)
    return (_mix(seed) % np.uint64(BINS)).astype(np.int64)


def signature(sets: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a non-empty set, optimally densified."""
    h = _mix(sets ^ np.uint64(0x5851F42D4C957F2D))
    bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, bins, _mix(h))
    full = np.zeros(BINS, bool)
    full[bins] = True
    source, empty, first = np.arange(BINS), np.flatnonzero(~full), 1
    while len(empty):
        tried = _probes(first)[empty]
        hit = full[tried]
        done = hit.any(1)
        source[empty[done]] = tried[done, hit[done].argmax(1)]
        empty, first = empty[~done], first + PROBES
    return out[source]


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in sig.reshape(BANDS, ROWS).T:
        key = _mix(key ^ column)
    return key.view(np.int64)


def _measured(docs: DataFrame, n: int) -> DataFrame:
    """Per row of ``_id, _text``: size and 128-bit hash of the set, and the band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["_id"], batch["_text"]):
                s = shingles(t, n)
                two = [int(np.bitwise_xor.reduce(_mix(s + np.uint64(k)))) for k in (1, 2)] if len(s) else [0, 0]
                name = f"{two[0]:016x}{two[1]:016x}" if len(s) else None
                out.append((None if pd.isna(i) else int(i), len(s), name, band_keys(signature(s)) if len(s) else None))
            yield pd.DataFrame(out, columns=["_id", "_n", "_set", "_bands"]).astype({"_id": "Int64"})

    return docs.mapInPandas(run, "_id long, _n long, _set string, _bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "_items": [shingles(t, n).view(np.int64) for t in batch["_text"]]})

    return docs.mapInPandas(run, "_id long, _items array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of each vertex of ``a, b``: the smallest vertex of its component.

    Large-star and small-star steps in turn; each is a grouping by vertex with one minimum, and every step
    is written to the shared folder.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = saved(small, "edges")
        # Settled: every vertex has one edge, to a root that has none itself.
        state = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        busy = state.where("n > 1").limit(1).count() or after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        edges = after
        if not busy:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common, union`` of pairs, from the full sets."""
    left = pairs.join(sets.select(F.col("_id").alias("a"), F.col("_items").alias("_x")), "a")
    both = left.join(sets.select(F.col("_id").alias("b"), F.col("_items").alias("_y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("_x", "_y")).cast("long").alias("common"), (F.size("_x") + F.size("_y")).cast("long").alias("sum"))
    return both.select("a", "b", "common", (F.col("sum") - F.col("common")).alias("union"))


def _against(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``_hub, _id, common, union, _added, _gone, _hub_n, _delta`` of pairs of a hub and a document.

    ``_delta``: the shingles that only one of the two has; null if their distance is over ``NEAR``.
    """
    both = pairs.join(sets.select(F.col("_id").alias("_hub"), F.col("_items").alias("_c")), "_hub").join(sets, "_id")
    both = both.select("_hub", "_id", F.size("_c").cast("long").alias("_hub_n"), F.array_except("_items", "_c").alias("_plus"), F.array_except("_c", "_items").alias("_minus"))
    both = both.select("*", F.size("_plus").cast("long").alias("_added"), F.size("_minus").cast("long").alias("_gone"))
    both = both.select("*", (F.col("_hub_n") - F.col("_gone")).alias("common"), (F.col("_hub_n") + F.col("_added")).alias("union"))
    near = 1 - F.col("common") / F.col("union") <= NEAR
    return both.select("_hub", "_id", "common", "union", "_added", "_gone", "_hub_n", F.when(near, F.concat("_plus", "_minus")).alias("_delta"))


def _differing_alike(now: DataFrame, against: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``a, b``: all pairs of different components near one hub that may be linked.

    With ``added`` and ``gone`` shingles against a hub of ``h``, two documents that share ``s`` of them share
    ``h - gone - gone' + s`` shingles. A link thus needs ``(100 + percent) s >= w + w' - (100 - percent) h``, where
    ``w = percent * added + 100 * gone``, and ``w > (100 - percent) h`` for each document that is not linked with the hub. One of the
    two is such a document, so that ``s`` is at least 1, and one shingle of the rarest ones of both is shared. The
    first one shared must leave enough after its places in both.
    """
    total, slack = 100 + percent, (100 - percent) * F.col("_hub_n")
    there = now.select("_hub", "_id", "_n", "_d", "_root").distinct().join(against.drop("common", "union"), ["_hub", "_id"]).where("_delta is not null")
    home = roots.select(F.col("id").alias("_hub"), F.col("root").alias("_home"))
    there = there.join(home, "_hub", "left").withColumn("_out", F.col("_root") != F.coalesce("_home", "_hub"))
    there = there.withColumn("_w", percent * F.col("_added") + 100 * F.col("_gone")).withColumn("_size", F.col("_added") + F.col("_gone"))
    single = there.select("_hub", "_id", F.explode("_delta").alias("_item"))
    often = single.groupBy("_hub", "_item").agg(F.count(F.lit(1)).alias("_in")).where("_in > 1")
    # Shingles of one document alone come first; they are counted, not listed.
    listed = single.join(often, ["_hub", "_item"]).groupBy("_hub", "_id").agg(F.sort_array(F.collect_list(F.struct("_in", "_item"))).alias("_list"))
    there = saved(there.drop("_delta").join(listed, ["_hub", "_id"]).withColumn("_first", F.col("_size") - F.size("_list")), "differing")

    def rarest(need) -> DataFrame:
        upto = F.greatest(F.col("_size") - need + 1 - F.col("_first"), F.lit(0)).cast("int")
        part = there.select("*", F.posexplode(F.slice("_list", F.lit(1), upto)).alias("_place", "_one")).drop("_list")
        return part.select("_hub", "_hub_n", "_id", "_n", "_d", "_root", "_out", "_w", F.col("_one._item").alias("_item"), (F.col("_size") - F.col("_first") - F.col("_place")).alias("_rest"))

    alone = rarest(F.ceil((F.col("_w") - slack) / total)).where("_out").drop("_hub_n", "_out")
    alone = alone.select("_hub", "_item", *[F.col(c).alias("x" + c) for c in ("_id", "_n", "_d", "_root", "_w", "_rest")])
    every = rarest(F.floor(F.col("_w") / total) + 1)
    met = alone.join(every, ["_hub", "_item"]).where(F.col("_root") != F.col("x_root")).where(~F.col("_out") | (F.col("x_id") < F.col("_id")))
    met = met.where(total * F.least("_rest", "x_rest") >= F.col("_w") + F.col("x_w") - slack).where(F.abs(F.col("_d") - F.col("x_d")) <= 1 - percent / 100 + 1e-9)
    met = met.where((100 * F.col("_n") >= percent * F.col("x_n")) & (100 * F.col("x_n") >= percent * F.col("_n")))
    return met.select(F.least("x_id", "_id").alias("a"), F.greatest("x_id", "_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id, kept``: one row per row of ``docs``.

    Texts without words (null, empty, blank) have no shingles and are linked with nothing. A null key is linked
    with nothing, has a null component and is kept. Rows that repeat a key are one document: each has its own size,
    and all have the component of the key. Empty table: no rows.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    measured = saved(_measured(rows, words), "minhash")
    known = measured.where(F.col("_id").isNotNull() & F.col("_set").isNotNull())
    classes = known.groupBy("_set").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"))
    same = saved(known.select("_id", "_set").join(classes.where("_copies > 1"), "_set").where("_id <> _rep").select(F.col("_id").alias("a"), F.col("_rep").alias("b")).distinct(), "copies")

    reps = known.select("_set", "_id", "_n", "_bands").join(classes.select("_set", F.col("_rep").alias("_id")), ["_set", "_id"])
    banded = reps.select("_id", "_n", F.explode("_bands").alias("_key"))
    shared = banded.groupBy("_key").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo <> _hi").select("_key")
    open_ = saved(banded.join(shared, "_key").distinct(), "buckets")

    # Full sets of the documents that meet another one, made from the texts a second time.
    involved = open_.select("_id").distinct()
    sets = saved(_sets(rows.where(F.col("_id").isNotNull()).join(involved, "_id", "left_semi"), words), "sets")

    # Stars: the smallest member of each bucket against the others that are not too small or large for it.
    def sized(x: str, y: str):
        return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))

    def linked(frame: DataFrame) -> DataFrame:
        return frame.where(100 * F.col("common") >= percent * F.col("union")).select("a", "b")

    centre = open_.groupBy("_key").agg(F.min(F.struct("_id", "_n")).alias("_c")).select("_key", F.col("_c._id").alias("_centre"), F.col("_c._n").alias("_cn"))
    stars = open_.join(centre, "_key").where("_id <> _centre").where(sized("_n", "_cn"))
    scored = saved(_scored(stars.select(F.col("_centre").alias("a"), F.col("_id").alias("b")).distinct(), sets), "scored")
    links = linked(scored).unionByName(same)
    roots = saved(components(links), "roots")

    # Buckets that still hold several components; their centres have met all others and leave.
    tried, most = scored.select("a", "b"), CENTRES
    open_ = open_.join(centre, "_key").where("_id <> _centre").select("_key", "_id", "_n")

    def still_mixed(rows: DataFrame) -> DataFrame:
        now = rows.join(roots.select(F.col("id").alias("_id"), F.col("root").alias("_root")), "_id", "left").withColumn("_root", F.coalesce("_root", "_id"))
        held = now.groupBy("_key", "_root").agg(F.count(F.lit(1)).alias("_size"))
        mixed = held.groupBy("_key").agg(F.max(F.struct("_size", (-F.col("_root")).alias("_minus"))).alias("_m"), F.sum("_size").alias("_all"))
        mixed = mixed.where("_m._size < _all").select("_key", (-F.col("_m._minus")).alias("_main"), (F.col("_all") - F.col("_m._size")).alias("_others"))
        return saved(now.join(mixed, "_key"), "mixed")

    now = still_mixed(open_)
    if now.limit(1).count():
        # Shingles that no other of these documents has can't be common ones: they bound what two of them may share.
        items = sets.join(now.select("_id").distinct(), "_id", "left_semi").select("_id", F.explode("_items").alias("_item"))
        lone = items.groupBy("_item").agg(F.count(F.lit(1)).alias("_in"), F.min("_id").alias("_id")).where("_in = 1").groupBy("_id").agg(F.count(F.lit(1)).alias("_lone"))
        now = now.join(lone, "_id", "left").withColumn("_most", F.col("_n") - F.coalesce("_lone", F.lit(0)))
        # A hub per main component: its member with the fewest shingles of its own, which is near its middle.
        now = saved(now, "bounded")
        hubs = now.where("_root = _main").groupBy("_main").agg(F.max(F.struct((F.col("_most") / F.col("_n")).alias("_part"), "_id")).alias("_c")).select("_main", F.col("_c._id").alias("_hub"))
        now = now.join(hubs, "_main").select("_key", "_id", "_n", "_most", "_hub")
        against = saved(_against(now.select("_hub", "_id").distinct(), sets), "against")
        scored = against.where("_id <> _hub").select(F.least("_hub", "_id").alias("a"), F.greatest("_hub", "_id").alias("b"), "common", "union")
        links = links.unionByName(linked(scored))
        roots = saved(components(links), "roots")
        tried = tried.unionByName(scored.select("a", "b"))
        distance = against.select("_hub", "_id", (1 - F.col("common") / F.col("union")).alias("_d"))
        now = still_mixed(now.join(distance, ["_hub", "_id"]))
        scored = saved(_scored(_differing_alike(now, against, roots, percent).join(tried, ["a", "b"], "left_anti"), sets), "scored")
        links = links.unionByName(linked(scored))
        roots = saved(components(links), "roots")
        tried = tried.unionByName(scored.select("a", "b"))
        # Pairs of which both are NEAR the hub are settled; who is nearer by a link's distance meets nobody else.
        left = now.where(F.col("_d") > NEAR - (1 - percent / 100) - 1e-9)
        now = still_mixed(left.select("_key", "_id", "_n", "_d", "_most"))
    while now.limit(1).count():
        # members outside the bucket's main component, some at a time, against all members of other components.
        turn = Window.partitionBy("_key").orderBy("_id")
        outside = now.where("_root <> _main").withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= most)
        outside = outside.select("_key", *[F.col(c).alias("x" + c) for c in ("_id", "_n", "_d", "_most", "_root")])
        close = (F.abs(F.col("_d") - F.col("x_d")) <= 1 - percent / 100 + 1e-9) & (F.greatest("_d", "x_d") > NEAR - 1e-9)
        enough = percent * (F.col("_n") + F.col("x_n")) <= (100 + percent) * F.least("_most", "x_most")
        pairs = outside.join(now, "_key").where(F.col("_root") != F.col("x_root")).where(sized("_n", "x_n")).where(close).where(enough)
        pairs = pairs.select(F.least("x_id", "_id").alias("a"), F.greatest("x_id", "_id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        scored = saved(_scored(pairs, sets), "scored")
        fresh = linked(scored)
        if fresh.limit(1).count():
            links = links.unionByName(fresh)
            roots = saved(components(links), "roots")
        tried = tried.unionByName(scored.select("a", "b"))
        # A bucket all of whose outsiders had their turn is settled; in the others, those that had it leave.
        left = now.where(F.col("_others") > most).join(outside.select("_key", F.col("x_id").alias("_id")), ["_key", "_id"], "left_anti")
        now = still_mixed(left.select("_key", "_id", "_n", "_d", "_most"))
        most *= CENTRES
    of = measured.drop("_bands", "_set").join(roots.select(F.col("id").alias("_id"), F.col("root").alias("_root")), "_id", "left")
    root = F.coalesce("_root", "_id")
    return of.select(F.col("_id").alias(key), F.col("_n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("_id") == root, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are not kept; rows without a key stay.

    Rows that repeat a kept key stay once for each different text: of those with one text, the row with the least hash
    of its columns (maps aside).
    """
    kept = near_duplicates(docs, key, text, **options).where("kept").select(F.col(key).alias("_kept")).where("_kept is not null")
    one, mark = F.col(f"`{key}`"), fresh(docs, "_row")
    named = docs.withColumn(mark, F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]))
    least = named.where(one.isNotNull()).groupBy(one.alias("_key"), F.xxhash64(f"`{text}`").alias("_text")).agg(F.min(mark).alias("_least"))
    least = least.join(kept, F.col("_key") == F.col("_kept"), "left_semi").select(F.col("_key").alias(key), F.col("_least").alias(mark))
    chosen = named.join(least, [key, mark], "left_semi")
    return chosen.dropDuplicates([key, mark]).drop(mark).unionByName(docs.where(one.isNull()))
