"""Ranked lexical search: one Aho-Corasick automaton of all items' terms scans the documents.

No index of documents is made. Texts are read as UTF-8 bytes in which A-Z are lower case and each ASCII character that belongs to no term is a
blank; the automaton holds each term between two blanks, so that it meets whole terms only. Its outputs are numbers of terms, which
map to the items that ask for them. One scan counts the documents per term, a second one scores; each task hands on at most ``top``
documents per item, and these are merged by item and hash bucket, then by item.

Items go in blocks of at most ``BLOCK_BYTES`` of text in expectation, so that the automaton that a task holds is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
#: Text of the items whose terms share an automaton.
BLOCK_BYTES = 8 << 20
#: Bytes of a text that are matched at once; slices end at a blank.
SLICE = 1 << 20
#: Bytes of the longest term in the automaton, whose depth is bounded so; longer terms are looked up whole.
LONG = 1024
#: Hash buckets per item in which the tasks' best documents are merged first.
SALT = 32
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def cleaned(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z in lower case and a blank for each character outside terms."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN)


def _slices(clean: bytes) -> Iterator[bytes]:
    """Pieces that hold whole terms; a term longer than a slice stays whole."""
    start = 0
    while start < len(clean):
        end = start + SLICE
        if end < len(clean):
            end = clean.rfind(b" ", start, end) + 1 or clean.find(b" ", end) + 1 or len(clean)
        yield clean[start:end]
        start = end


class Query:
    """Items' terms as numbers: ``terms[t]``, and the items of term ``t`` in ``items[first[t] : first[t + 1]]``."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        wanted: dict = {}
        for item, text in rows:
            wanted.setdefault(item, set()).update(cleaned(text).split())
        self.ids = list(wanted)
        self.terms = sorted(set().union(*wanted.values())) if wanted else []
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[t], i) for i, item in enumerate(self.ids) for t in wanted[item])
        self.items = np.array([i for _, i in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))

    def scanner(self) -> Scanner:
        return Scanner(self.terms)


class Scanner:
    """The automaton of the terms, made once per task; ``scan`` runs it over a text."""

    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            if len(term) <= LONG:
                self.automaton.add_word(f" {term.decode('latin-1')} ", i)
        self.automaton.make_automaton()
        self.long = {term: i for i, term in enumerate(terms) if len(term) > LONG}

    def scan(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of terms of the text; those that items ask for, and how often each occurs."""
        n, found = 0, []
        for piece in _slices(cleaned(text)):
            x = np.frombuffer(piece, np.uint8) != 32
            n += int(np.count_nonzero(x[1:] & ~x[:-1])) + int(x[0])
            if len(self.automaton):
                found.append(np.fromiter((t for _, t in self.automaton.iter(f" {piece.decode('latin-1')} ")), np.int64))
            if self.long:
                edge = np.flatnonzero(np.diff(np.r_[False, x, False]))
                begins, ends = edge[::2], edge[1::2]
                wide = np.flatnonzero(ends - begins > LONG)
                found.append(np.array([t for k in wide if (t := self.long.get(piece[begins[k] : ends[k]])) is not None], np.int64))
        return n, *np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)


def _statistics(docs: DataFrame, query: Query) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and documents per term of the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, df, some, length = query.scanner(), np.zeros(len(query.terms), np.int64), 0, 0
        for batch in batches:
            for text in batch["_text"]:
                n, terms, _ = scanner.scan(text)
                some, length = some + (n > 0), length + n
                df[terms] += 1
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"_t": np.concatenate([[-2, -1], seen]), "_n": np.concatenate([[some, length], df[seen]])}).astype("int64")

    sums = docs.select("_text").mapInPandas(run, "_t long, _n long").groupBy("_t").agg(F.sum("_n").alias("_n"))
    found = {r["_t"]: r["_n"] for r in sums.collect()}
    df = np.zeros(len(query.terms), np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return found.get(-2, 0), found.get(-1, 0), df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)


def _best(item, score, doc, top: int):
    """The ``top`` rows of each item: greatest score, then smallest document; documents without an id come last."""
    order = np.lexsort((doc[1], doc[0], -score, item))
    item = item[order]
    begins = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    place = np.arange(len(item)) - np.repeat(begins, np.diff(np.r_[begins, len(item)]))
    return order[place < top]


def _scored(docs: DataFrame, query: Query, documents: int, length: int, df: np.ndarray, top: int) -> DataFrame:
    """``_item, _score, _doc``: the best documents of each task per item."""
    w = weights(documents, df)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = query.scanner()
        item, score = np.empty(0, np.int64), np.empty(0, np.int64)
        missing, doc = np.empty(0, bool), np.empty(0, np.int64)
        least = np.zeros(len(query.ids), np.int64)  # a document below this score has ``top`` better ones in its task
        for batch in batches:
            keys = batch["_id"].to_numpy(dtype=np.int64, na_value=0)
            null = batch["_id"].isna().to_numpy()
            at, parts = [], []
            for i, text in enumerate(batch["_text"]):
                n, terms, tf = scanner.scan(text)
                if not len(terms):
                    continue
                m = 10 + 90 * n * documents // length
                part = w[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                total = np.zeros(len(query.ids), np.int64)
                width = query.first[terms + 1] - query.first[terms]
                where = np.repeat(query.first[terms] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
                np.add.at(total, query.items[where], np.repeat(part, width))
                hit = np.flatnonzero((total > 0) & (total >= least))
                at.append(np.full(len(hit), i))
                parts.append((hit, total[hit]))
            if not parts:
                continue
            at = np.concatenate(at)
            item, score = np.r_[item, *[p[0] for p in parts]], np.r_[score, *[p[1] for p in parts]]
            missing, doc = np.r_[missing, null[at]], np.r_[doc, keys[at]]
            if not len(item):
                continue
            kept = _best(item, score, (missing, doc), top)
            item, score, missing, doc = item[kept], score[kept], missing[kept], doc[kept]
            full = np.bincount(item, minlength=len(query.ids)) >= top
            low = np.full(len(query.ids), np.iinfo(np.int64).max)
            np.minimum.at(low, item, score)
            least = np.where(full, low, 0)
        yield pd.DataFrame({"_item": item, "_score": score, "_doc": pd.arrays.IntegerArray(doc, missing)})

    return docs.mapInPandas(run, "_item int, _score long, _doc long")


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text", *, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0, by score, then by ascending ``doc_id``.

    Texts of any length are scanned whole. Null and empty texts have no terms and count for nothing; items without terms, or whose terms no document has, have no rows.
    Each row of ``docs`` is a document, also if it repeats a key or has a null one (null comes last among equal scores); rows of ``items`` with
    one id are one item with the terms of all. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    asked = items.select(F.col(f"`{item}`").cast("long").alias("_item"), F.col(f"`{question}`").cast("string").alias("_text"))
    size = asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    out = None
    for b in range(blocks):
        here = asked.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b) if blocks > 1 else asked
        query = Query([(r["_item"], r["_text"]) for r in here.collect()])
        documents, length, df = _statistics(rows, query)
        if not documents:
            break
        found = _scored(rows, query, documents, length, df, top)
        order = [F.desc("_score"), F.asc_nulls_last("_doc")]
        salted = found.withColumn("_salt", F.pmod(F.xxhash64("_doc", "_score"), F.lit(SALT)))
        first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_item", "_salt").orderBy(*order))).where(F.col("_rank") <= top)
        last = first.withColumn("_rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).where(F.col("_rank") <= top)
        ids = spark.createDataFrame(list(enumerate(query.ids)), f"_item int, {item} long")
        part = last.join(ids, "_item").select(item, F.col("_rank").alias("rank"), F.col("_doc").alias(key), F.col("_score").alias("score"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"{item} long, rank int, {key} long, score long") if out is None else out
