"""Near-duplicates, mixing, pages, images and the pipeline against brute force."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from subvox.llm import images, minhash, mixing, pages
import slow_images
import slow_pages
from test_texts import docs_of, odd, prose  # noqa: F401  (fixture)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sets(rows, n):
    out = {}
    for key, text, *_ in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        k = min(n, len(words))
        out[key] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    return out


def brute_components(sets):
    root = {k: k for k in sets if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(root)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def copies(seed=1):
    """Chains and groups of near copies: neighbours in a chain are alike, its ends are not."""
    rng, rows, key = random.Random(seed), [], 1000
    for _ in range(12):
        words = prose(rng, 120, ["ab", "cd", "ef", "gh"]).split()
        for _ in range(10):
            rows.append((key, " ".join(words), None, None))
            key += 1
            for _ in range(rng.choice([1, 2, 4, 6])):
                words[rng.randrange(len(words))] = prose(rng, 1, ["xy", "zw"])
    for i in range(8):
        rows.append((key + i, f"tiny text {i % 2}", None, None))
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark, odd):  # noqa: F811
    rows = [r for r in odd if r[0] != 7] + copies()
    for n in (2, 5):
        got = minhash.near_duplicates(docs_of(spark, rows), words=n).collect()
        sets = brute_sets(rows, n)
        want = brute_components(sets)
        assert len(got) == len(rows)
        for r in got:
            assert r.n_shingles == len(sets[r.doc_id])
            assert r.component_id == want.get(r.doc_id)
            assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(docs_of(spark, rows).where("false")).count() == 0
    left = minhash.keep_one(docs_of(spark, rows), words=5)
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(k for k, v in want.items() if k == v)
    assert left.columns == docs_of(spark, rows).columns


def test_long_words_and_slices(monkeypatch):
    text = prose(random.Random(2), 500, ["ab", "c"]) + "\t" + "q" * 400 + "\x0b" + "End of\x1cit"
    whole = minhash.word_hashes(text)
    assert len(whole) == len(WORD.findall(text))
    monkeypatch.setattr(minhash, "SLICE", 450)
    assert minhash.word_hashes(text).tolist() == whole.tolist()
    monkeypatch.setattr(minhash, "SLICE", 90)  # one word is longer than a slice
    assert minhash.word_hashes(text).tolist() == whole.tolist()


def test_regular_words_of_one_sum_differ(spark):
    """Words of a and b in a pattern that makes sums modulo 2^64 equal for every base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    hashes = [int(minhash.word_hashes(w[:n])[0]) for w in (one, other) for n in (32, 64, 65, 128, 1024, 2048)]
    assert len(set(hashes)) == len(hashes)
    got = minhash.near_duplicates(docs_of(spark, [(1, one, None, None), (2, other, None, None)]), words=2)
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2}


def test_repeated_keys_keep_their_texts(spark):
    rows = [(1, "a b c", 1, "x"), (1, "a b c", 1, "x"), (1, "a b c", 2, "x"), (1, "other words here", 1, "x"), (2, "a b c", 1, "x"), (3, None, 1, "x"), (3, None, 1, "x"), (None, "a b c", 1, "x"), (None, "a b c", 1, "x")]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, _kept int, _row string")
    left = [minhash.keep_one(docs.repartition(n), words=2) for n in (1, 7)]
    assert left[0].columns == docs.columns
    one, two = (sorted(map(tuple, df.collect()), key=repr) for df in left)
    assert one == two and sorted((r[:2] for r in one), key=repr) == sorted([(1, "a b c"), (1, "other words here"), (3, None), *[(None, "a b c")] * 6], key=repr)
    assert minhash.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)]
    got = {r.id: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    import itertools

    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in itertools.islice(edges, len(edges)))}


def waterfill(sizes, goal):
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = goal - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 2.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over
        if len(full) == len(order):
            return {s: 2.0 * sizes[s] for s in order}


def test_mixing(spark, odd):  # noqa: F811
    rng = random.Random(7)
    rows = list(odd) + [(i, prose(rng, rng.randint(0, 60), ["ab", "c"]), None, rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(100, 900)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    again = mixing.mix(docs_of(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, text, _, src in rows:
        sizes[src] += len(WORD.findall(text or ""))
    target = waterfill(sizes, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for src, goal in target.items():
        largest = max(len(WORD.findall(t or "")) for _, t, _, s in rows if s == src)
        assert abs(taken[src] - goal) <= largest / 2 + 1, src
    mixed = mixing.mixed_documents(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows).columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs_of(spark, rows).where("false")).count() == 0


def test_mixing_with_unequal_odds(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, None, "a" if i % 2 else "b") for i in range(4000)]
    got = mixing.mix(docs_of(spark, rows), share=0.5, weights=(1,), appetite=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0)).collect()
    rich, poor = ([r.copies for r in got if (r.doc_id % 4 < 2) == x] for x in (True, False))
    assert abs(sum(r.taken for r in got) - 0.5 * 40_000) <= 20
    assert 2.4 < np.mean(rich) / np.mean(poor) < 3.6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p>";</script></head><body class="home">
<header><a href="/">Site</a><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav></header><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy now</div>{open}<h1>Head &amp; line</h1><p>First <b>bo</b>ld&nbsp;text\n here<br>next</p><p>Tiny.<p>Unclosed para &lt;x&gt; &eacute;
<div class="sidebar">Side</div><form><input><label>Mail</label></form>{close}<section id="comments"><p>I liked it</p></section><aside>More</aside><footer>&copy; me</footer></body></html>"""


TAGS = "div p article main section h1 h2 span b form header ul li table tr td nav aside br script".split()
ATTRS = ["", "", "", " class='ad'", " class='comment-list'", " class='layout has-sidebar'", " id='comments'", " role='form'", " hidden", " class=x"]
BITS = ["<", ">", "</", "<!doctype html>", "&amp;", "&#65;", "<!-- c -->", "<!--", "-->", "<![foo]>", "<![CDATA[", "]]>", "<!", "<?x>", "<a b='", "&", "one two, three. ", "four " * 30]


def test_pages_of_broken_markup():
    """Any soup of markup gives the text that the slow version finds."""
    draw = random.Random(5)
    for _ in range(1500):
        parts = []
        for _ in range(draw.choice([3, 10, 30, 80])):
            kind = draw.random()
            opening = f"<{draw.choice(TAGS)}{draw.choice(ATTRS)}>"
            parts.append(opening if kind < 0.4 else f"</{draw.choice(TAGS)}>" if kind < 0.6 else draw.choice(BITS))
        html = "".join(parts)
        assert pages.main_text(html) == slow_pages.main_text(html), html


def test_pages_of_odd_declarations_and_depth():
    assert pages.main_text("<![foo]>text") == pages.main_text("<![if !IE]><p>text</p><![endif]>") == pages.main_text("<!>text") == "text"
    assert pages.main_text("<![CDATA[x]]>text") == pages.main_text("<!-- x --!> text") == pages.main_text("<!-- text") == "text"
    assert pages.main_text("a <![ x") == "a <![ x"
    began = time.time()
    for piece, end in (("<a ", ""), ("<a ", ">"), ("<!--", ""), ("<![CDATA[", ">"), ("<div>t", ""), ("<header>", ""), ("<p><b>", ""), ("</a ", ">"), ("<i><div><b>", "</i>" * 50_000)):
        pages.main_text(piece * (500_000 // len(piece)) + end)
    pages.main_text("<div>" * 60_000 + "</x>" * 60_000)
    pages.main_text("<body>" + "<h1>a</h1><p>x</p>" * 25_000)
    assert time.time() - began < 60  # some seconds; hours if it grew with the square


def test_pages(spark):
    want = "Head & line First bold text here next Tiny. Unclosed para <x> é"
    for tags in (("<article>", "</article>"), ('<div class="post"><div>', "</div></div>"), ("<main>", "</main>")):
        assert pages.main_text(PAGE.format(open=tags[0], close=tags[1])) == want
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<p> </p>") == pages.main_text("<nav>x</nav>") == ""
    assert pages.main_text("just text") == "just text"
    assert pages.main_text("<article><p>cut off &am") == "cut off &am"
    long = "<article>" + "<p>word and more</p>" * 20_000 + "</article>"
    assert pages.main_text(long) == " ".join(["word and more"] * 20_000)
    frame = spark.createDataFrame([(1, "<p>a</p>"), (2, None)], "page_id long, html string")
    got = {r.page_id: r.m for r in frame.select("page_id", pages.extract().alias("m")).collect()}
    assert got[1].text == "a" and got[1].n_chars == 1 and got[2].text == "" and got[2].n_chars == 0


def test_marked_wrappers_and_blocks_beside_the_region():
    para = "A paragraph with many plain words that goes on for quite a while, as the ones of articles do."
    body = f"<p>{para}</p>" * 6
    text = " ".join([para] * 6)
    side = "<div class='sidebar'><p>Side words</p></div><div class='menu'><a href=1>One</a></div>"
    notes = f"<div id='comments'>{body * 3}</div>"
    for name in ("layout has-sidebar", "no-sidebar", "page-with-toc", "reader-view", "post has-comments"):
        for inside in (f"<article><h1>Head</h1>{body}</article>", f"<main><h1>Head</h1>{body}</main>", f"<div><h1>Head</h1>{body}</div>"):
            assert pages.main_text(f"<body><div class='{name}'>{inside}{side}</div>{side}<footer>F</footer></body>") == "Head " + text, (name, inside[:9])
            assert pages.main_text(f"<main><div class='{name}'>{inside}{side}{notes}</div></main>") == "Head " + text, (name, inside[:9])
    assert pages.main_text(f"<body><form action='/p' id='aspnetForm'><nav>N</nav><div><h1>Head</h1>{body}</div>{side}</form></body>") == "Head " + text
    assert pages.main_text(f"<body><div class='post'>{body}</div>{notes}</body>") == text
    assert pages.main_text(f"<article>{body}</article><div class='related'><article>{para}</article></div><div class='cookie-consent'>{body * 3}</div>") == text
    assert pages.main_text(f"<article>{body}</article><div id='comments'><article class='comment-body'>{body * 3}</article></div>") == text
    lead, more = para.replace("A", "Lead", 1), para.replace("A", "More", 1)
    many = f"<p>{para}</p>" * 30
    post = f"<div class=post><h1>Head</h1><p>{lead}</p><div class=body>{many}</div><h2>On</h2><div>{f'<p>{more}</p>' * 3}</div></div>"
    links = "<ul>" + "<li><a href=x>Li</a></li>" * 30 + "</ul>"
    assert pages.main_text(f"<body>{links}<div>{post}</div>{links}</body>") == " ".join(["Head", lead, *[para] * 30, "On", *[more] * 3])
    assert pages.main_text(f"<div class='ad'>{para}</div><article><h1>Head</h1><p>Tiny</p></article>") == "Head Tiny"


def test_images(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(120)]
    rows[60] = (60, rows[0][1])  # a copy of the image of the query 0
    rows[61] = (61, (np.array(rows[50][1]) + rng.normal(size=64) * 0.02).tolist())  # nearly that of the query 50
    rows += [(200, None), (201, []), (202, [1.0] * 64), (203, [float("nan")] * 64), (None, rows[5][1]), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in images.find_copies(frame, images.vector_image, images.cropped, key="vec_id", data="embedding").collect()}
    assert got[60].class_id == got[0].class_id == 0 and got[7].class_id == 7
    assert [got[k].own_found for k in (0, 50, 100)] == [True] * 3
    assert got[50].best_match == 61 and got[0].n_links == 1 and got[100].n_links == 1
    assert all(got[k].class_id is None for k in (200, 201, 202, 203)) and got[200].is_query and got[200].n_links is None
    assert images.find_copies(frame.where("false"), images.vector_image, images.cropped, key="vec_id", data="embedding").count() == 0


def test_image_turns():
    rng = np.random.default_rng(2)
    x = images.vector_image(rng.normal(size=64), 96)
    mine, turned = images.describe(x), images.describe(np.rot90(x).copy())
    near = sum(min(int((a[4] != b[4]).sum()) for b in turned) <= images.BITS for a in mine)
    assert mine and near >= 0.8 * len(mine)


def pictures():
    """Smooth pictures of two sizes, flat ones, and noisy copies and quarter turns of some."""
    rng = np.random.default_rng(6)
    base = [images.vector_image(rng.normal(size=64), 64 if i % 2 else 50) for i in range(14)]
    noisy = [np.round(x + rng.normal(size=x.shape) * 2) for x in base[:5]]
    return [*base, *noisy, *(np.rot90(x).copy() for x in base[:5]), np.full((64, 64), 7.0), np.zeros((20, 64)), rng.normal(size=(40, 33)) * 50]


def corners_of(found):
    rows = [(i, d) for i, d in enumerate(found) if d]
    columns = [[i for i, _ in rows], [len(d) for _, d in rows], *([[c[k] for c in d] for _, d in rows] for k in range(4)), [images.pieces(np.array([c[4] for c in d])).ravel() for _, d in rows]]
    return images.Corners(pa.table(dict(zip(("_id", "_n", "_row", "_col", "_turn", "_scale", "_keys"), columns))))


def test_stacks_of_images_have_the_corners_of_each_image(spark):
    shown, shapes = pictures(), {}
    for x in shown:
        shapes.setdefault(x.shape, []).append(x)
    for stack in shapes.values():
        of, *values, bits = images.describe_all(np.stack(stack))
        for i, x in enumerate(stack):
            want = slow_images.describe(x)
            assert np.array_equal(bits[of == i], np.array([c[4] for c in want]).reshape(-1, images.TESTS))
            assert all(np.allclose(v[of == i], [c[k] for c in want], rtol=0, atol=1e-9) for k, v in enumerate(values))
    frame = spark.createDataFrame([(i, [float(len(x)), *x.ravel().tolist()]) for i, x in enumerate(shown)], "_id long, _data array<double>").coalesce(1)
    got = {r["_id"]: r for r in images.described(frame, lambda d: np.array(d[1:]).reshape(int(d[0]), -1)).collect()}
    assert {i: len(images.describe(x)) for i, x in enumerate(shown) if images.describe(x)} == {i: r["_n"] for i, r in got.items()}
    assert all(r["_row"] == [c[0] for c in images.describe(shown[i])] and len(r["_keys"]) == images.TABLES * r["_n"] for i, r in got.items())


def test_image_votes_are_those_of_all_pairs_of_corners(spark, monkeypatch):
    shown = pictures()
    index, asked = [images.describe(x) for x in shown], [images.describe(images.cropped(x)) for x in shown]
    corners, tables = corners_of(index), images.HammingTables(corners_of(asked))
    pairs = {(q, i): slow_images.near(asked[q], index[i]) for q in range(len(asked)) for i in range(len(index))}
    want = {k: n for k, (_, matches) in pairs.items() if (n := slow_images.inliers(matches))}
    assert len(want) > len(tables.corners.ids) and sum((q, q) in want for q in range(19)) >= 15
    n = len(corners.ids)
    for candidates, counters, together in ((1 << 20, 1 << 17, n), (1 << 20, 1 << 17, 5), (40, 1, 7), (1, 1 << 17, n)):
        monkeypatch.setattr(images, "CANDIDATES", candidates)
        monkeypatch.setattr(images, "COUNTERS", counters)
        found = [tables.votes(corners, k, min(k + together, n)) for k in range(0, n, together)]
        assert {(r.query, r.image): r.inliers for part in found for r in part.itertuples()} == want


def test_few_pairs_that_share_a_piece_are_compared():
    """Pictures that have nothing in common: most such pairs are alone with their turn and zoom."""
    rng = np.random.default_rng(9)
    found = [images.describe(images.vector_image(rng.normal(size=64))) for _ in range(30)]
    corners = corners_of(found)
    met = sum(slow_images.near(a, b)[0] for i, a in enumerate(found) for j, b in enumerate(found) if i != j)
    compared = sum((corners.of[other] != corners.of[mine]).sum() for other, mine, *_ in images.HammingTables(corners).candidates(corners, 0, 30))
    assert met > 5000 and 3 * compared < met


def test_blocks_of_searched_images_find_what_one_block_does(spark, monkeypatch):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(30)], "_id long, _data array<double>")
    rows = images.described(frame, images.vector_image)
    one = sorted(images.matched_images(rows, rows).collect())
    monkeypatch.setattr(images, "BLOCK_CORNERS", 60)
    assert sorted(images.matched_images(rows, rows).collect()) == one and len(one) >= 30


def test_pipeline(spark, tmp_path, odd):  # noqa: F811
    import corpus_pipeline as cp

    rng = random.Random(11)
    en, de = ["the", "ing", "er", "on", "sh"], ["sch", "ein", "keit", "ü", "ver"]
    rows = [(i, prose(rng, rng.randint(20, 90), en if i % 2 else de), "en" if i % 2 else "de", rng.choice(["a", "b", None])) for i in range(2000, 2200)]
    rows += [(i + 1000, rows[i - 2000][1], rows[i - 2000][2], "a") for i in range(2000, 2020)]
    rows += [(5000, "zzqx kkwv xxjq " * 40, None, "b"), (5001, "the ering onsh a.b@mail.example.com " + prose(rng, 40, en), "en", "b"), (5002, None, "en", "b")]
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert not {5000, 5002} & set(seen["language"]) and len(seen["language"]) >= len(rows) - 5
    want = brute_components(brute_sets([tuple(r)[:2] for r in seen["language"].values()], 5))
    assert set(seen["near_duplicates"]) == {k for k, v in want.items() if k == v}
    assert "<EMAIL>" in seen["personal_data"][5001].text and seen["personal_data"][5001].n_chars == len(seen["personal_data"][5001].text)
    assert set(seen["mixing"]) <= set(seen["personal_data"])
    packed = cp.run(spark, str(tmp_path))
    assert set(r.doc_id for r in packed.select("doc_id").distinct().collect()) == set(seen["mixing"])
    assert cp.ORACLE_SQL is None


def test_stages_without_languages_and_with_clashing_names(spark):
    import corpus_pipeline as cp

    rows = [(i, f"the words of document {i} a.b@mail.example.com", None, "a", 0, "mine", "yours") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _judged string, _found string")
    assert cp.language(spark, docs, "").count() == 2
    langs = docs.withColumn("lang", F.lit("en"))
    assert {(r._judged, r._found) for r in cp.language(spark, langs, "").collect()} <= {("mine", "yours")}
    out = cp.personal_data(spark, docs, "")
    assert out.columns == docs.columns and {(r._judged, r._found, "<EMAIL>" in r.text) for r in out.collect()} == {("mine", "yours", True)}


def test_pairs_near_a_hub_lose_no_link(spark):
    """Sets that differ from the hub in 0 to 60 % of their items, and copies of the far ones: all links between components are named."""
    rng, hub = np.random.default_rng(5), set(range(100))
    sets = {0: hub}
    for i in range(1, 90):
        if i % 3 == 0 and len(sets[i - 1] & hub) < 89:  # near the one before, far from the hub
            base, changed = sets[i - 1], int(rng.integers(0, 8))
        else:
            base, changed = hub, int(rng.integers(0, 45))
        gone = set(rng.choice(sorted(base), changed, replace=False).tolist())
        sets[i] = (base - gone) | {int(x) for x in rng.integers(100, 260, changed)}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    home = {0, *(b for (a, b), j in like.items() if a == 0 and j >= 0.8)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "_id long, _items array<long>")
    against = minhash._against(rows.select(F.lit(0).cast("long").alias("_hub"), "_id"), rows)
    seen = {r["_id"]: r for r in against.collect()}
    assert all(seen[b]["common"] / seen[b]["union"] == like[0, b] for b in sets if b)
    now = spark.createDataFrame([(0, i, len(s), 1 - (like[0, i] if i else 1.0), 0 if i in home else i) for i, s in sets.items()], "_hub long, _id long, _n long, _d double, _root long")
    roots = spark.createDataFrame([(i, 0) for i in sorted(home)], "id long, root long")
    found = {(r["a"], r["b"]) for r in minhash._differing_alike(now, against, roots, 80).collect()}
    near = {0, *(b for b in sets if b and like[0, b] >= 0.5)}
    need = {p for p, j in like.items() if j >= 0.8 and set(p) <= near and not set(p) <= home}
    assert len(need) > 10 and need <= found
    assert not any(set(p) <= home for p in found)
    assert len(found) < len(near) * (len(near) - 1) / 4
