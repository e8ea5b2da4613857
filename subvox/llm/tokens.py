"""Token counts by a longest-match automaton, without building the pieces.

The vocabulary is a trie over bytes. Each node carries a failure link (the node of what is left when the longest pieces
on its path are cut off) and the number of pieces cut off. A word is read once, byte by byte: where the trie
has no edge, the failure link is followed and its count added. That gives the greedy longest-match-first
number of word pieces in time linear in the word.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counted words that a worker remembers; a bounded memory, never a limit on words.
REMEMBER = 200_000


class Automaton:
    """``starts``: pieces that begin a word; ``inner``: pieces that continue one (both bytes).

    A word that the pieces can't cover counts as one unknown token.
    """

    def __init__(self, starts: Iterable[bytes], inner: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # node 0 begins words, node 1 continues them
        whole = [False, False]
        for root, pieces in ((0, starts), (1, inner)):
            for piece in pieces:
                node = root
                for b in piece:
                    step = self.edges[node].get(b)
                    if step is None:
                        step = self.edges[node][b] = len(self.edges)
                        self.edges.append({})
                        whole.append(False)
                    node = step
                if node > 1:
                    whole[node] = True
        self.fail = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for b, child in self.edges[node].items():
                if whole[child]:
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    back, cut = self.fail[node], self.pops[node]
                    while back >= 0 and b not in self.edges[back]:
                        cut += self.pops[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[child], self.pops[child] = self.edges[back][b], cut
                queue.append(child)

    def count(self, word: bytes) -> tuple[int, int]:
        """``tokens, unknown``: pieces of the word, or one unknown token."""
        if not word:
            return 0, 0
        edges, fail, pops = self.edges, self.fail, self.pops
        node, n = 0, 0
        for b in word:
            while True:
                step = edges[node].get(b)
                if step is not None:
                    node = step
                    break
                if fail[node] < 0:
                    return 1, 1
                n += pops[node]
                node = fail[node]
        while node != 1:
            if fail[node] < 0:
                return 1, 1
            n += pops[node]
            node = fail[node]
        return n, 0


def byte_vocabulary(path: str) -> Automaton:
    """Word pieces of a byte-level ``tokenizers`` file: pieces with the blank in front begin words, the others continue them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    pieces = [bytes(shown[c] for c in p) for p in spec["model"]["vocab"] if p not in special]
    starts = [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1 and b" " not in p[1:]]
    inner = [p for p in pieces if b" " not in p]
    return Automaton({*starts, *(bytes([b]) for b in range(256))}, inner)


def token_counts(docs: DataFrame, automaton: Automaton, text: str = "text") -> Column:
    """Column ``struct<n_words, n_tokens, n_unknown>`` of ``text``; null and empty texts have zeros.

    Words are separated by white space; the automaton's size is that of the vocabulary, whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            out = []
            for t in batch:
                words = (t or "").split()
                tokens = unknown = 0
                for word, times in Counter(words).items():
                    pair = known.get(word)
                    if pair is None:
                        if len(known) >= REMEMBER:
                            known.clear()
                        pair = known[word] = shared.value.count(word.encode("utf-8", "surrogatepass"))
                    tokens += times * pair[0]
                    unknown += times * pair[1]
                out.append((len(words), tokens, unknown))
            yield pd.DataFrame(out, columns=["n_words", "n_tokens", "n_unknown"])

    return count(F.col(f"`{text}`"))
