"""Best-fit packing of documents into sequences of bounded length.

Lengths are whole numbers up to ``limit``, so documents sorted by length and gaps sorted by size fall
into at most ``limit`` classes each. The sweep goes through the documents' classes from long to short:
each class looks for its successor among the gaps (the smallest that holds it), all documents of the class
are matched to the gaps of that size at once, conflicts are settled by rank (the r-th document
takes the r-th gap), the gaps are updated, and the rest of the class goes on to the next gap size or opens new
sequences. The outcome is best-fit decreasing. The sweep needs the number of documents of each length only (at
most ``limit`` numbers, summed by Spark); it gives intervals of ranks, and one distributed pass ranks the pieces
inside their length and reads their places off the intervals.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subvox.llm.common import saved

LIMIT = 2048
#: Groups into which the ranks of one length are cut, so that no task ranks a whole length.
GROUPS = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters of a run of white space from which it is cut out before the pattern sees it: its backtracking ends at a million.
RUN = 1 << 16
#: White space of the pattern's ``\s``; Python's own also has the separators U+001C to U+001F.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUNS = re.compile(f"(?<!{_SPACE}){_SPACE}{{{RUN},}}")


class Vocabulary:
    """Byte-level merges of a ``tokenizers`` file, run by ``tiktoken``: the same ids at a fifth of the time."""

    #: Pattern that splits a text before merging, as the file's ByteLevel step has it.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(shown[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.code = tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode(self, text: str, special: bool = False) -> np.ndarray:
        """Ids of ``text``. ``special``: a special token's name gives its one id, as in a plain call of ``tokenizers``; else ordinary pieces."""
        parts = self.marks.split(text) if special and self.marks else [text]
        ids = self._ordinary(parts[0])
        for mark, part in zip(parts[1::2], parts[2::2]):
            ids += [self.special[mark], *self._ordinary(part)]
        return np.asarray(ids, "<u4")

    def _ordinary(self, text: str) -> list[int]:
        """Ids without special tokens. A very long run of white space is one piece but for its last character, which starts the next piece; at the end it is whole."""
        if len(text) < RUN:
            return self.code.encode_ordinary(text)
        ids, done = [], 0
        for m in _RUNS.finditer(text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            ids += self.code.encode_ordinary(text[done : m.start()])
            ids += self.code._encode_single_piece(text[m.start() : stop])
            done = stop
        return ids + self.code.encode_ordinary(text[done:])


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and path."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def cut_pieces(ids: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``piece, start, ids``: whole if it fits, else pieces of ``limit`` with the rest in front."""
    start, piece = 0, 0
    stop = len(ids) if len(ids) <= limit else len(ids) % limit or limit
    while start < len(ids):
        yield piece, start, ids[start:stop]
        start, stop, piece = stop, stop + limit, piece + 1


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = 0, *, special: bool = False) -> DataFrame:
    """One row per piece of a tokenized document. Null text is empty: the end id alone. ``special`` as in ``Vocabulary.encode``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for batch in batches:
            out = []
            for k, t in zip(batch["_key"], batch["_text"]):
                ids = np.append(words.encode(t or "", special), np.uint32(end_id)).astype("<u4")
                k = None if pd.isna(k) else int(k)
                out.extend((k, p, s, len(part), zlib.crc32(part.tobytes())) for p, s, part in cut_pieces(ids, limit))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInPandas(run, PIECES)


def sweep(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int]]:
    """Intervals ``length, first_rank, first_sequence, offset`` of best-fit decreasing over length classes.

    The documents of a length from ``first_rank`` to the next interval's go to consecutive sequences.
    """
    plan: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, how many) with that gap
    sizes: list[int] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):  # no gap holds it: each new sequence takes one of them, and is a gap for the rest
                per = limit // length
                gap, first, many = limit, opened, -(-left // per)
                opened += many
            else:
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            used = min(left, many)
            plan.append((length, rank, first, limit - gap))
            for size, run in ((gap - length, (first, used)), (gap, (first + used, many - used))):
                if size and run[1]:
                    if size not in gaps:
                        gaps[size] = []
                        bisect.insort(sizes, size)
                    gaps[size].append(run)
            rank, left = rank + used, left - used
    return plan


def pack(pieces: DataFrame, limit: int = LIMIT, groups: int = GROUPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` must be 1 to ``limit``.

    Pieces of one length differ by rank only: repeated rows get places of their own. Empty input gives no rows.
    """
    # The group is drawn from all columns, so that rerun tasks give the same ranks.
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    rows = pieces.withColumn("_group", group)
    counts = rows.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "pack-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `limit` rows
    plan = sweep(totals, limit)
    by: dict[int, tuple[list, list, list]] = {}
    for length, rank, first, offset in plan:
        ranks, firsts, offsets = by.setdefault(length, ([], [], []))
        ranks.append(rank), firsts.append(first), offsets.append(offset)
    table = pieces.sparkSession.sparkContext.broadcast({k: tuple(map(np.array, v)) for k, v in by.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for size in np.unique(n):
            ranks, firsts, offsets = table.value[int(size)]
            mine = np.flatnonzero(n == size)
            at = np.searchsorted(ranks, r[mine], "right") - 1
            seq[mine], off[mine] = firsts[at] + r[mine] - ranks[at], offsets[at]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = rows.join(counts.drop("_n"), ["length", "_group"]).withColumn("_rank", F.row_number().over(inside) - 1 + F.col("_before"))
    return ranked.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.*")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, *, special: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs ``docs``; the tokenized pieces are written once and ranked from there."""
    return pack(saved(token_pieces(docs, path, limit=limit, special=special), "pack-pieces"), limit)
