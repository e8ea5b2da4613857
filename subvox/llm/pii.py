"""Personal data by candidate generation and gradient boosting.

Generators propose many overlapping spans: the four base patterns (whose hits always stay) and loose forms of them
(masked mail addresses, numbers without country code, grouped digits, addresses with other separators). Boosted
trees judge the loose ones by their format and by the words and marks around them; a threshold calibrated on
held-back spans picks those that are redacted. Base hits in documents are the positive examples, and so are
the same hits rewritten in a loose form; number-like and mail-like spans that break the rules, and rewritten hits that were
damaged, are the negative ones.

Bound of what is fitted: ``ROWS`` texts, drawn by a hash from all that hold a digit or an at sign.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of the kinds in results.
KINDS = ("email", "ip", "card", "phone")
ROWS = 2000
#: Precision that the threshold must reach on held-back candidates.
PRECISION = 0.995
SEED = 7

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive forms of the contract's patterns: the same hits, in linear time on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Loose generators, by kind. They overlap the base patterns and each other.
LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9])", re.I)),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,3}[0-9]{4}){3}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-]{1,2}[0-9]{4}(?![0-9])")),
)
_WORDS = re.compile(r"[^\W\d_]+")
#: Words whose nearness speaks for personal data, as plain values.
HINTS = ("mail", "email", "contact", "write", "phone", "tel", "call", "fax", "mobile", "card", "visa", "ip", "host", "addr", "address", "server")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Hits of the mail pattern, found from their at signs: linear on long runs of name characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at) if start < at else None
        if hit:
            yield start, hit.end()
            done = hit.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans ``kind, start, end``, by kind and start."""
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for kind, pattern, fits in (("card", _CARD, lambda d: 16 <= len(d) <= 19 and luhn(d)), ("phone", _PHONE, lambda d: 8 <= len(d) <= 15)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if fits(_digits(m.group()))]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, pattern in LOOSE for m in pattern.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    span, before, after = text[start:end], text[max(start - 40, 0) : start], text[end : end + 40]
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    near = {w.lower() for w in _WORDS.findall(before)[-5:] + _WORDS.findall(after)[:3]}
    tld = re.split(r"[.\s\])}]+", span)[-1]
    return [
        float(KINDS.index(kind)), float(len(span)), float(len(digits)), len(digits) / max(len(span), 1), float(len(groups)),
        float(max(map(len, groups), default=0)), float(sum(map(len, groups[:1]))), float(all(int(g[-4:]) <= 255 and len(g) <= 3 for g in groups)),
        float(16 <= len(digits) <= 19 and luhn(digits)), float(int(digits[:1] or 0)), float(len(set(digits))),
        float("@" in span), float(any(m in span.lower() for m in ("(at)", "[at]", "{at}"))), float(any(m in span.lower() for m in ("dot)", "dot]", "dot}"))),
        float(span.count(" ")), float(span.count("-")), float(span.count(".")), float("(" in span), float(span[:2] == "00"),
        float(len(tld)), float(tld.isalpha() and tld.islower()), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€#=/"),
        float(after[:1] in "%€$="), float(bool(near & set(HINTS))), float(re.sub(r"[0-9]", "", span).strip() == ""),
    ]


class Boosted:
    """Logistic gradient boosting of regression trees over quantile bins; small and exact to rerun."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, least: int = 5):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[list] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree: list = []
            self._grow(tree, x, y - q, q * (1 - q) + 1e-9, np.arange(len(y)), self.depth, cuts)
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, tree: list, x, g, h, rows, depth: int, cuts) -> int:
        at = len(tree)
        tree.append(None)
        own = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.least:
            for j, points in enumerate(cuts):
                side = np.searchsorted(points, x[rows, j], "left")  # side <= i: value at most points[i]
                sums = [np.bincount(side, w, len(points) + 1).cumsum() for w in (g[rows], h[rows], np.ones(len(rows)))]
                (lg, lh, ln), (tg, th, tn) = (s[:-1] for s in sums), (s[-1] for s in sums)
                gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - own
                gain = np.where((ln >= self.least) & (tn - ln >= self.least), gain, -1)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, float(points[gain.argmax()]))
        _, j, cut = best
        if j is None:
            tree[at] = self.rate * g[rows].sum() / (h[rows].sum() + 1)
            return at
        left = x[rows, j] <= cut
        tree[at] = (j, cut, self._grow(tree, x, g, h, rows[left], depth - 1, cuts), self._grow(tree, x, g, h, rows[~left], depth - 1, cuts))
        return at

    @staticmethod
    def _walk(tree: list, x: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(x)), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if isinstance(tree[at], tuple):
                j, cut, a, b = tree[at]
                left = x[rows, j] <= cut
                todo += [(a, rows[left]), (b, rows[~left])]
            else:
                out[rows] = tree[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x))))))


def _rewrites(text: str, kind: str, start: int, end: int, rng: np.random.Generator) -> Iterator[tuple[str, int]]:
    """Loose forms of a base hit (1), and damaged ones (0), in its own context."""
    span = text[start:end]
    pick = lambda *forms: forms[int(rng.integers(len(forms)))]
    digits = _digits(span)
    if kind == "email":
        name, host = span.rsplit("@", 1)
        bare = "".join(c for c in name if c.isalpha()) or "x"
        for who in (name, pick(bare, f"{bare[:2]}.{bare[2:]}x")):
            dot = pick("(dot)", "[dot]", " [dot] ", " (dot) ", ".")
            yield f"{who}{pick('(at)', '[at]', ' [at] ', ' (at) ')}{host.replace('.', dot)}", 1
            yield f"{who} at {pick(host.split('.')[0], bare[::-1])}.{pick('The', 'And', 'In', 'of', '12', 'es')}", 0
    elif kind == "ip":
        yield span.replace(".", pick("[.]", "(.)", "[dot]")), 1
        yield pick("[.]", "(.)").join(str(int(p) + 256) for p in span.split(".")), 0
    elif kind == "card":
        forms = [digits[i : i + 4] for i in range(0, 16, 4)]
        if len(digits) == 16:
            yield pick(".", "/", " - ", "_", "  ").join(forms), 1
            wrong = digits[:15] + str((int(digits[15]) + 1 + int(rng.integers(8))) % 10)
            yield pick(" ", ".", "/", " - ").join(wrong[i : i + 4] for i in range(0, 16, 4)), 0
    elif kind == "phone":
        tail = digits[-10:]
        if len(tail) == 10:
            yield pick(f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"001 ({tail[:3]}) {tail[3:6]} {tail[6:]}", f"({tail[:3]}) {tail[3:6]}.{tail[6:]}"), 1
            yield f"{tail[:3]} {tail[3:6]} {tail[6:]}{pick('%', '0', ' 12', 'x')}", 0


class Finder:
    """Base spans, and loose spans that the trees accept; ``model`` None: base spans only."""

    def __init__(self, model: Boosted | None = None, threshold: float = 1.0):
        self.model, self.threshold = model, threshold

    def find(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """``base, all``, each by kind and start. An accepted loose span overlaps no other span."""
        text = text or ""
        base = base_spans(text)
        if self.model is None:
            return base, base
        taken = sorted((s, e) for _, s, e in base)
        starts, ends = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
        loose = []
        for kind, s, e in candidates(text):
            i = int(np.searchsorted(starts, e, "left")) if taken else 0  # spans that begin before e
            if not (i and ends[i - 1] > s):
                loose.append((kind, s, e))
        if not loose:
            return base, base
        score = self.model.score(np.array([features(text, *c) for c in loose]))
        free, chosen = 0, []
        for s, e, kind in sorted((s, e, k) for (k, s, e), p in zip(loose, score) if p >= self.threshold):
            if s >= free:
                chosen.append((kind, s, e))
                free = e
        return base, sorted(base + chosen, key=lambda x: (KINDS.index(x[0]), x[1]))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> Finder:
    """Fits trees and threshold on candidates of at most ``rows`` texts of ``docs``. Without positives: base spans only.

    The texts stay in the tasks; the driver gets one feature row per candidate.
    """
    marked = docs.where(F.col(f"`{text}`").rlike("[@+0-9]")).select(F.col(f"`{text}`").alias("_text"), F.xxhash64(F.lit("pii"), f"`{key}`", f"`{text}`").alias("_order"))
    drawn = marked.select("_order").distinct().orderBy("_order").limit(rows)
    sample = marked.join(F.broadcast(drawn), "_order").dropDuplicates(["_order"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, order in zip(batch["_text"], batch["_order"]):
                rng = np.random.default_rng([SEED, int(order) & (2**63 - 1)])
                base = base_spans(text)
                inside = {(s, e) for _, s, e in base}
                for kind, s, e in base:
                    out.append((order, 1.0, features(text, kind, s, e)))
                    for form, label in _rewrites(text, kind, s, e, rng):
                        changed = text[max(s - 60, 0) : s] + form + text[e : e + 60]
                        out.append((order, float(label), features(changed, kind, min(s, 60), min(s, 60) + len(form))))
                for kind, s, e in candidates(text):
                    if not any(s < b and a < e for a, b in inside):
                        out.append((order, 0.0, features(text, kind, s, e)))
            yield pd.DataFrame(out, columns=["_order", "label", "x"])

    seen = sample.mapInPandas(run, "_order long, label double, x array<double>").toPandas()
    if not len(seen) or seen["label"].sum() < 1 or seen["label"].min() > 0:
        return Finder()
    seen = seen.assign(_x=seen["x"].map(tuple)).sort_values(["_order", "label", "_x"])
    x, y = np.stack(seen["x"].to_numpy()), seen["label"].to_numpy()
    held = np.array([int(hashlib.md5(str(o).encode()).hexdigest()[:4], 16) % 4 == 0 for o in seen["_order"]])
    if held.all() or not held.any():
        return Finder()
    model = Boosted().fit(x[~held], y[~held])
    score, label = model.score(x[held]), y[held]
    order = np.argsort(-score, kind="stable")
    precise = np.cumsum(label[order]) / np.arange(1, len(order) + 1) >= PRECISION
    at = np.flatnonzero(precise)
    return Finder(model, float(max(score[order][at[-1]], 0.5)) if len(at) else 1.0)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every stretch covered by spans replaced by the kind of its first span, in angle brackets."""
    out, done = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e in spans):
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def detect(docs: DataFrame, finder: Finder, text: str = "text", *, redacted: bool = False) -> Column:
    """Column ``struct<n_email, n_ip, n_card, n_phone, base_sha256, spans>`` of ``text``, with ``redacted`` on demand.

    Counts and digest are of the base spans, ``spans`` has all. Null counts as empty; its ``redacted`` is null.
    """
    columns = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"] + ["redacted"] * redacted
    shared = docs.sparkSession.sparkContext.broadcast(finder)

    @F.pandas_udf(", ".join(f"{c} {'long' if c[:2] == 'n_' else 'string'}" for c in columns))
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                base, spans = shared.value.find(t)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), *([None if t is None else redact(t, spans)] * redacted)))
            yield pd.DataFrame(out, columns=columns)

    return judge(F.col(f"`{text}`"))
