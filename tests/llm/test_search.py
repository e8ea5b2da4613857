"""URL filter, whitening and ranked search against brute force on small fixtures."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from subvox.llm import search, urls, whitening

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def judged(url, rules):
    host, path = split_url(url)
    fits = []
    for rule, verdict in rules:
        if not rule or rule.find("/") < 1:
            continue
        rhost, rpath = rule[: rule.index("/")].lower(), rule[rule.index("/") :]
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath):
            fits.append((len(rhost) + len(rpath), len(rhost), rhost + rpath, verdict))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def pages_of(spark, addresses):
    """Pages with columns whose names clash with inner and outer ones."""
    rows = [(i, u, "<p>", "h", "r", "x", 1) for i, u in enumerate(addresses)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, _row string, _hosts string, _n int").repartition(3)


def test_urls_of_all_forms(spark):
    addresses = [
        None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://NET/x", "http://a.example.net/en/1", "http://a.example.net/en", "http://example.net?/en/", "http://xnet/",
        "http://x.net#/en/", "http://x.net/#en", "https://example.com/de/a?b=http://q.net/", "https://example.com/DE/a", "ftp://u@example.org:80/fr/", "http://é.org/fr/ü", "http://org/fr/", "http://.net/", "http://net./",
        "a://b://c.net/", "://net/", "http://a.net/\nb", "http://example.net/en/" + "x" * 200_000, "http://" + "a." * 20_000 + "net/", "http://example.net/en/1", "http://example.net/en/1",
    ]
    got = urls.judge(pages_of(spark, addresses), spark.createDataFrame(RULES, "rule string, verdict string"))
    assert got.columns == ["page_id", "url", "html", "_row", "_hosts", "_n", "host", "path", "rule", "verdict"]
    rows = {r.page_id: r for r in got.collect()}
    assert len(rows) == len(addresses) and got.count() == len(addresses)
    for i, u in enumerate(addresses):
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == judged(u, RULES), u
        assert rows[i].url == u


def test_many_rules_and_a_crowded_filter(spark):
    """Lists of thousands of rules, also with a filter far too small for them, give the same verdicts."""
    rng = random.Random(5)
    hosts = [".".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    paths = ["/" + "/".join(rng.choice("pqr") for _ in range(rng.randint(0, 4))) for _ in range(60)]
    rules = [(h + p, rng.choice(["allow", "block"])) for h in hosts for p in rng.sample(paths, 3)] + [(None, "block"), ("", "block"), ("/x", "block"), ("nopath", "block"), ("A.Z/", None)]
    rules += rules[:5]
    addresses = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'q', '/pq', '?a'])}" for _ in range(600)] + [f"http://other{i}.info/p/q" for i in range(300)]
    listed = spark.createDataFrame(rules, "rule string, verdict string")
    greatest: dict = {}
    for r, v in rules:
        if r and r.find("/") > 0:
            greatest[r.lower()] = max(greatest.get(r.lower()) or "", v or "") or None
    want = [judged(u, list(greatest.items())) for u in addresses]
    for blocks in (urls.MAX_BLOCKS, 1):
        rows = {r.page_id: r for r in urls.judge(pages_of(spark, addresses), listed, max_blocks=blocks).collect()}
        assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(len(addresses))] == want
    kept = urls.allowed(pages_of(spark, addresses), listed)
    assert kept.columns == pages_of(spark, []).columns
    assert sorted(r.page_id for r in kept.collect()) == [i for i, w in enumerate(want) if w[3] != "block"]


def test_filter_lets_few_others_pass(spark):
    rules = spark.createDataFrame([(f"host{i}.example/p{i}/", "block") for i in range(3000)], "rule string, verdict string")
    made = urls.Rules(rules)
    keys = made.table.selectExpr("xxhash64(_host, _path) AS h").unionByName(spark.range(20_000).selectExpr("xxhash64(concat('other', id), '/') AS h"))
    rows = keys.select("h", made.block(keys["h"]).alias("b"))
    n = rows.where(urls.may_hold(rows["b"], rows["h"])).count()
    assert 3000 <= n <= 3000 + 200  # all listed ones, and under 1 % of the others


def test_urls_empty_and_native(spark):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    assert urls.judge(pages_of(spark, []), rules).count() == 0
    got = urls.judge(pages_of(spark, ["http://a.net/", None]), rules.limit(0)).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")] * 2
    plan = urls.judge(pages_of(spark, ["http://a.net/"]), rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, _id string, _x int, component int").repartition(3)


def brute_whitening(rows, k=4):
    sound = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in sound})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[float(sum((Fraction(x[a]) - Fraction(sums[a], n)) * (Fraction(x[b]) - Fraction(sums[b], n)) for x in fit) / n) for b in range(d)] for a in range(d)])
    values, axes = np.linalg.eigh(cov)
    return sound, n, sums, cov, values[::-1][:k], axes[:, ::-1][:, :k]


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(100 + i, [float(c) for c in base[0]]) for i in range(40)]  # a hot vector
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [0.5] * 6), (204, []), (204, [-0.0] * 6), (204, [-0.0] * 6), (205, [1.0, 2.0])]
    vectors = vectors_of(spark, [(i, v, "a", 1, 2) for i, v in rows])
    model = whitening.fit(vectors)
    got = whitening.whiten(vectors, model).collect()
    sound, n, sums, cov, values, axes = brute_whitening([r for r in rows if r[0] != 205])
    assert model.n == n and model.sums == sums
    np.testing.assert_allclose(model.covariance, cov, rtol=1e-15, atol=0)
    assert len(got) == 4 * len(sound)
    by = Counter((r.vec_id, r.component) for r in got)
    assert by == Counter((i, k) for i, _ in sound for k in (1, 2, 3, 4))
    x = {i: np.array(v) for i, v in sound}
    sign = {}
    for r in got:
        centred = x[r.vec_id] - np.array(sums) / n
        want = float(centred @ axes[:, r.component - 1] / math.sqrt(values[r.component - 1]))
        if abs(want) > 1e-6:
            sign.setdefault(r.component, np.sign(r.whitened * want))
        assert math.isclose(r.whitened, sign.get(r.component, 1) * want, rel_tol=1e-9, abs_tol=1e-9)
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id].tolist(), sums)) and r.n == n
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(cov), rel_tol=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_does_not_depend_on_partitions(spark):
    rows = [(i, [math.sin(i * j + 1) * 3 for j in range(5)], "a", 1, 2) for i in range(50)]
    one, many = (whitening.fit(vectors_of(spark, rows).repartition(p)) for p in (1, 7))
    assert (one.covariance == many.covariance).all() and (one.axes == many.axes).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, [0.5, 1.0]), (2, [0.5, 2.0])], [(1, [3.0]), (2, [4.0])]])
def test_whitening_of_few_vectors(spark, rows):
    vectors = vectors_of(spark, [(i, v, "a", 1, 2) for i, v in rows])
    model = whitening.fit(vectors)
    got = whitening.whiten(vectors, model).collect()
    sound = [v for _, v in rows if v]
    assert len(got) == sum(min(4, len(v)) for v in sound)
    flat = len({tuple(v) for v in sound}) < 2
    for r in got:
        assert (r.whitened is None) == (flat or r.component > 1)
        assert r.identity_error < 1e-9 and r.explained == (0 if flat or r.component > 1 else 1)


def test_squares_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 30, 1 << 44, (1 << 62) - 1):
        v = rng.integers(-top, top, size=(300, 3))
        assert whitening.square_sums(v).tolist() == [sum(int(c) ** 2 for c in v[:, j]) for j in range(3)]
        assert whitening.square_sums(v, 1).tolist() == [sum(int(c) ** 2 for c in row) for row in v]
    far = whitening._centred(np.array([[1 << 60, -5]]), 1000, [7, 8])
    assert far.tolist() == [[1000 * (1 << 60) - 7, -5008]]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_rank(docs, items, top=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, row[3], -row[0]) for r, row in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def ranked(frame):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()], key=str)


def frames(spark, docs, items):
    a = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, score string, _item int").repartition(4)
    return a, spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, rank double")


def test_ranked_search(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta", "gämma", "d2", "e", "ÉTÉ", "日本", "the", "a", "aa", "a_a", "x-y", "№", "\u00a0", "\u2028z"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", ".", "\n", "_", "\x7f", "\x00"]) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    docs += [(900 + i, "the same text, the same") for i in range(30)]  # ties
    docs += [(500, None), (501, ""), (502, " .,;\n"), (None, "alpha beta"), (None, "alpha beta"), (3, "alpha"), (3, "alpha"), (503, "rare " + "the " * 30_000), (504, "q" * 3_000_000 + " rare")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "unheard"), (53, "same"), (54, "RARE rare"), (55, "the"), (56, "q" * 3_000_000), (None, "alpha"), (1, "d2 and more"), (57, "a a a")]
    want = brute_rank(docs, items)
    a, b = frames(spark, docs, items)
    assert ranked(search.rank(a, b)) == want
    assert ranked(search.rank(a, b, block_bytes=1_000_000)) == want  # several automata


def test_slices_hold_whole_terms(spark, monkeypatch):
    monkeypatch.setattr(search, "SLICE", 7)
    monkeypatch.setattr(search, "LONG", 9)
    made = search.Query([(0, "ab abcdefghijk c")]).scanner()
    for text in ("ab ab  abcdefghijk c ab", " ab", "abcdefghijk", "c c c c c c c c", "x" * 30 + " c", ""):
        n, terms, tf = made.scan(text)
        names = ["ab", "abcdefghijk", "c"]
        assert (n, {names[t]: c for t, c in zip(terms, tf)}) == (len(text.split()), {w: c for w, c in Counter(text.split()).items() if w in names})


def test_search_of_empty_tables(spark):
    a, b = frames(spark, [(1, "alpha")], [(1, "alpha")])
    for docs, items in ((a.limit(0), b), (a, b.limit(0)), (a.limit(0), b.limit(0))):
        got = search.rank(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
    assert ranked(search.rank(a, b)) == brute_rank([(1, "alpha")], [(1, "alpha")])
