"""Text operators against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from subvox.llm import langid, licenses, packing, pii, syncmers, tokens
from subvox.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id long, size long, _key string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 0, 1, "k") for i, t, lang, src in rows], SCHEMA).repartition(3)


def prose(rng, n, parts):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    en = ["the", "ing", "er", "on", "th", "and", "sh"]
    rows = [(i, prose(rng, 60, en), "en", "a") for i in range(0, 40, 2)]
    rows += [(1, None, "en", None), (3, "", None, "b"), (5, " \n\t ", "en", "b"), (7, prose(rng, 40_000, en), "en", "b"), (9, "12 + 34 !!", "en", "b"), (None, "no key at all", None, "c")]
    rows += [(11, "same text", "en", "a"), (11, "same text", "en", "a"), (13, "é" * 50, "fr", "a"), (15, "a", "en", "a")]
    return rows


def brute_sketch(text):
    if not text:
        return []
    b, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mix(h):
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 29)) * 0x94D049BB133111EB) & mask
        return h ^ (h >> 32)

    def poly(s):
        h = 0
        for c in s:
            h = (h * b + ord(c)) & mask
        return h

    found = set()
    for i in range(len(text) - syncmers.K + 1):
        kmer = text[i : i + syncmers.K]
        inner = [mix(poly(kmer[j : j + syncmers.S])) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.add(mix(poly(kmer)) >> 32)
    if not found:
        found = {int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "little")}
    return sorted(found)[: syncmers.KEEP]


def test_fingerprints(spark, odd):
    rows = [r for r in odd if r[0] != 7]
    got = syncmers.fingerprints_against_edits(docs_of(spark, rows)).collect()
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    assert len(got) == len(rows)
    for i, (key, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        row = next(g for g in got if g.doc_id == key and g.edited_sha256 == sha)
        assert row.n_chars == len(text)
        assert row.fingerprint == "".join(f"{x:08x}" for x in brute_sketch(text))
        assert row.edited_fingerprint == "".join(f"{x:08x}" for x in brute_sketch(edited))
        assert row.near_next == syncmers.likeness(np.array(brute_sketch(text), np.uint32), np.array(brute_sketch(after), np.uint32))


def test_fingerprints_slices_and_empty(spark, monkeypatch):
    text = prose(random.Random(1), 3000, ["ab", "cd", "xyz"])
    whole = syncmers.fingerprint(text)
    monkeypatch.setattr(syncmers, "SLICE", 500)
    assert syncmers.fingerprint(text).tolist() == whole.tolist()
    assert syncmers.likeness(whole, whole) == 1 and syncmers.likeness(whole[:0], whole) == 0
    empty = docs_of(spark, [(1, "x", None, None)]).where("false")
    assert syncmers.fingerprints_against_edits(empty).count() == 0
    one = syncmers.fingerprints_against_edits(docs_of(spark, [(1, "only one text here", None, None)])).first()
    assert one.near_next == 1


def test_licenses_against_brute_force(spark, odd):
    mit, apache = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["Apache-2.0"]
    rows = odd + [(101, "intro\n" + apache[0] + "\nend", None, None), (102, mit.replace(" the ", "\n the "), None, None), (103, "x\n\n" + mit + "\n\ny", None, None), (104, mit[: len(mit) // 2], None, None), (105, "a b\n" + mit.upper(), None, None)]
    items, keys = licenses.compiled(licenses.TEMPLATES, licenses.THRESHOLD)
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, rows)).collect()}
    for key, text, *_ in rows:
        low, found = (text or "").lower(), set()
        for unit in {*low.split("\n"), *re.split("\n{2,}", low), low}:
            mine = set(licenses.bigrams(unit))
            for name, grams in items:
                if mine and 2 * len(mine & set(grams)) / (len(mine) + len(grams)) >= licenses.THRESHOLD - 1e-12:
                    found.add(name)
                    assert any(k in low for k in keys)
        assert got[key].licenses == ",".join(sorted(found)), key
    assert got[101].licenses == "Apache-2.0" and got[102].licenses == got[103].licenses == got[105].licenses == "MIT" and got[104].licenses == ""
    assert licenses.scan(docs_of(spark, rows).where("false")).count() == 0


def test_licenses_as_they_are_shipped(spark):
    rng = random.Random(8)
    other = lambda n: prose(rng, n, ["ab", "zu", "lo", "ki"])
    wrap = lambda text, n: "\n".join(" ".join(w[i : i + n]) for w in [text.split()] for i in range(0, len(w), n))
    mit, isc, apache = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["ISC"][0], licenses.TEMPLATES["Apache-2.0"][1]
    three = mit.replace(": The above", ":\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    four = apache.replace(" You may", "\n\nYou may").replace(" http", "\n\nhttp").replace(" Unless", "\n\nUnless")
    texts = [(three, "MIT"), (isc.replace(" THE SOFTWARE", "\n\nTHE SOFTWARE", 1), "ISC"), (four, "Apache-2.0"), (wrap(mit, 9), "MIT"), (mit, "MIT")]
    texts += [(licenses.TEMPLATES["GPL-3.0"][0], "GPL-3.0"), (licenses.TEMPLATES["LGPL-3.0"][0], "LGPL-3.0")]
    texts += [(licenses.TEMPLATES[name][-1], name) for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense")]
    rows = [(i, f"{other(400)}{gap}{text}{gap}{other(300)}", None, None) for i, (text, gap) in enumerate((t, g) for t, _ in texts for g in ("\n\n", " "))]
    rows.append((900, f"{other(50)} {mit} {other(150)} {mit} {other(20)} {isc}", None, None))
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, rows)).collect()}
    for i in range(2 * len(texts)):
        assert texts[i // 2][1] in got[i].licenses.split(",") and got[i].best_license == texts[i // 2][1] and got[i].best_dice > 0.85, (i, got[i])
    assert got[900].licenses == "ISC,MIT"


def test_licenses_cut_only_texts_that_may_hold_one(spark, monkeypatch):
    rng = random.Random(9)
    plain = [(i, "\n\n".join(prose(rng, 40, ["the", "of", "and", "license", "ab", "software"]) for _ in range(30)), None, None) for i in range(5)]
    monkeypatch.setattr(licenses, "_bigrams", lambda unit: F.array(F.raise_error(unit).cast("string")))
    assert {(r.licenses, r.best_license, r.n_matches) for r in licenses.scan(docs_of(spark, plain)).collect()} == {("", None, 0)}


def test_licenses_of_damaged_templates(spark):
    rng, rows = random.Random(10), []
    items, _ = licenses.compiled(licenses.TEMPLATES, licenses.THRESHOLD)
    for i, (_, text) in enumerate((name, x) for name, texts in licenses.TEMPLATES.items() for x in texts for _ in range(3)):
        kept = [w for w in text.split() if rng.random() > 0.1] or ["a"]
        rows.append((i, prose(rng, 30, ["ab", "zu"]) + "\n" + " ".join(kept) + "\n" + prose(rng, 30, ["ab", "zu"]), None, None))
    got, reached = {r.doc_id: r for r in licenses.scan(docs_of(spark, rows)).collect()}, 0
    for key, text, *_ in rows:
        for unit in (*text.lower().split("\n"), text.lower()):
            mine = set(licenses.bigrams(unit))
            best = max((2 * len(mine & set(grams)) / (len(mine) + len(grams)), name) for name, grams in items)
            if best[0] >= licenses.THRESHOLD:
                reached += 1
                assert best[1] in got[key].licenses.split(",") and got[key].best_dice >= round(best[0], 6), (key, best, got[key])
    assert reached > 10


def test_licenses_pairs_of_words(spark):
    texts = ["", "a", "a b", "a b a b", "ab1 2 c", "x" * 300_000, "x" * 300_000 + " y", " ".join("abc" * 50_000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", licenses._pairs(F.col("x")).alias("p")).collect()
    for r in got:
        w = texts[r.i].split()
        assert r.p == [f"{a} {b}" for a, b in zip(w, w[1:])], r.i


def test_language(spark):
    rng, rows = random.Random(5), []
    kinds = {"aa": ["the", "ing", "er", "on"], "bb": ["sch", "ein", "keit", "ü"], "cc": ["ción", "ado", "que", "ñ"]}
    for i in range(300):
        lang = list(kinds)[i % 3]
        rows.append((i, prose(rng, rng.randint(5, 80), kinds[lang]), lang, None))
    docs = docs_of(spark, rows)
    model = langid.fit(docs.where("doc_id % 5 <> 0"))
    assert model.languages == ["aa", "bb", "cc"]
    extra = [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 .. %%", "aa", None), (1003, "zkwx vjkq zzxk qqpw " * 30, None, None), (None, rows[0][1] * 300, None, None)]
    got = {r.doc_id: r._l for r in docs_of(spark, rows + extra).select("doc_id", langid.identify(docs, model).alias("_l")).collect()}
    held = [got[i].lang_pred == lang for i, _, lang, _ in rows if i % 5 == 0]
    assert np.mean(held) > 0.98
    assert sum(got[i].rejected for i, *_ in rows) <= 3
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].rejected and got[None].lang_pred == "aa" and not got[None].rejected
    assert all(0 <= v.score <= 1 for v in got.values())


def test_language_model_sums_to_one_and_slices(spark, monkeypatch):
    rng = random.Random(8)
    docs = docs_of(spark, [(i, prose(rng, 50, ["ab", "ba", "cab"]), "x", None) for i in range(40)])
    model = langid.fit(docs)
    letters = [ord(c) for c in "abc "]
    for context in ("ab", "ba ", "cab"):
        total = sum(np.exp(model.look_up(langid.gram_hashes(np.array([*map(ord, "   " + context), c], np.uint32)), 4, np.array([3 + len(context)]))[0, 0]) for c in letters)
        assert 0.9 < total <= 1.001, context
    cp = langid.normalized(prose(rng, 2000, ["ab", "ba", "cab"]))
    whole = model.sums(cp)
    monkeypatch.setattr(langid, "SLICE", 700)
    assert np.allclose(model.sums(cp), whole)
    nothing = langid.fit(docs.where("false"))
    assert nothing.languages == [] and nothing.judge("text")[0] == "und"


def greedy(word, starts, inner):
    n, at = 0, 0
    while at < len(word):
        pieces = starts if at == 0 else inner
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 1, 1
        n, at = n + 1, at + size
    return n, 0


def test_token_counts(spark, odd):
    rng = random.Random(2)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))).encode() for _ in range(60)}
    starts, inner = set(sorted(pieces)[:30]), set(sorted(pieces)[20:])
    auto = tokens.Automaton(starts, inner)
    for _ in range(5000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode()
        assert auto.count(word) == greedy(word, starts, inner), word
    real = tokens.byte_vocabulary(tokenizer_path())
    got = {r.doc_id: r._n for r in docs_of(spark, odd).select("doc_id", tokens.token_counts(docs_of(spark, odd), real).alias("_n")).collect()}
    for key, text, *_ in odd:
        if key != 7:
            assert got[key].n_words == len((text or "").split())
    assert got[1].n_tokens == got[3].n_tokens == got[5].n_tokens == 0 and all(v.n_unknown == 0 for v in got.values())


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans():
    rng = random.Random(4)
    bits = ["a", "b.c", "@", ".", "-", "1", "23", "255", "256", "001", " ", "+", "(", ")", "x@y.z", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "é", "٣", "\n", "+1 (555) 123-4567"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == brute_spans(text), text
    long = "1" * 200_000 + "a" * 200_000 + "1.2 " * 50_000  # linear on long runs
    assert pii.base_spans(long) == []


def test_personal_data(spark, odd):
    rng = random.Random(6)
    rows = list(odd)
    for i in range(200, 420):
        front = f"4{rng.randrange(10**14):014d}"
        card = next(f"{front}{d}" for d in range(10) if pii.luhn(f"{front}{d}"))
        item = rng.choice([f"n{i}.{i}@mail{i % 7}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card, f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}", f"{rng.randrange(10**6)}", f"version {i}.{i}.1"])
        rows.append((i, f"and the {item} was here of {i}", "en", "a"))
    docs = docs_of(spark, rows)
    finder = pii.fit(docs)
    got = {r.doc_id: r._f for r in docs.select("doc_id", pii.detect(docs, finder, redacted=True).alias("_f")).collect()}
    for key, text, *_ in rows:
        base = brute_spans(text or "")
        row = got[key]
        assert row.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(row.spans.split(",")) or not base
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for k, *_ in base) for x in pii.KINDS]
        if not base and key not in (7,) and not row.spans:
            assert row.redacted == text
    assert pii.redact("ab cd ef", [("ip", 3, 5), ("card", 4, 7)]) == "ab <IP>f"
    assert pii.fit(docs.where("false")).model is None
    assert finder.model is not None
    _, spans = finder.find("write to joe.doe [at] mail3.example [dot] com today")
    assert any(k == "email" for k, *_ in spans)
    assert finder.find("In 2019 the 1200 of 34567 had 12 of 99 and 3.14.15 too")[1] == []


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    rows = odd + [(i, prose(random.Random(i), random.Random(i).randint(1, 700), ["ab", "the", "zz"]), None, None) for i in range(300, 420)] + [(500, "it's  two\n\n blanks\t<|endoftext|> \r\n 'll ３４", None, None)]
    docs = docs_of(spark, rows)
    real = Tokenizer.from_file(tokenizer_path())
    real.encode_special_tokens = True
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    seen = {}
    for key, text, *_ in rows:
        ids = [*real.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, first, *range(first + 2048, len(ids) + 1, 2048)]
        for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
            item = (key, p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))
            seen[item] = seen.get(item, 0) + 1
    for r in got:
        item = tuple(r)[:5]
        seen[item] -= 1
    assert not any(seen.values())
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 2048) * 1.05 + 1
    assert packing.pack_documents(docs.where("false"), tokenizer_path()).count() == 0


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(30):
        limit = rng.choice([10, 64, 200])
        lengths = [min(limit, 1 + int(rng.expovariate(4 / limit))) for _ in range(rng.randint(1, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.sweep(counts, limit)
        gaps = []
        for n in sorted(lengths, reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                gaps.append(limit - n)
            else:
                gaps[gaps.index(fit)] -= n
        used = {}
        for i, (n, rank, first, offset) in enumerate(plan):
            stop = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == n else counts[n]
            for k in range(stop - rank):
                used.setdefault(first + k, []).append((offset, n))
        assert len(used) == len(gaps)
        for parts in used.values():
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]


def test_packing_of_special_names_and_long_blanks(spark):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(tokenizer_path())
    words = packing.Vocabulary(tokenizer_path())
    rng = random.Random(5)
    texts = ["a <|endoftext|> b", " \n<|endoftext|>\n\n x", "<|endoftext|>" * 2, "<|endoftext|", "x<|endoftext|>'s"]
    runs = [" " * 1_000_000, "\n" * 1_200_000]
    texts += [runs[0], "it's" + runs[1] + "'s x"]
    for n in (packing.RUN - 1, packing.RUN):
        texts += [a + " " * n + sep + "\n" * n + b for a, b, sep in (("", "", ""), ("q", "r", "w"), ("\x1c", "\x1f", "\x1d"), (" <|endoftext|>", "<|endoftext|>", "\u3000"))]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "\n", "a", "'s", "1", " b", "é"]) for _ in range(30)) for _ in range(300)]
    for text in texts:
        assert words.encode(text, True).tolist() == real.encode(text, add_special_tokens=False).ids, (text[:20], len(text))
    real.encode_special_tokens = True
    for text in texts:
        assert words.encode(text).tolist() == real.encode(text, add_special_tokens=False).ids, (text[:20], len(text))
    rows = docs_of(spark, [(1, "a <|endoftext|> b", None, None), (2, runs[0] + "x", None, None)])
    got = {(r.doc_id, r.piece): r for r in packing.pack_documents(rows, tokenizer_path(), special=True).collect()}
    real.encode_special_tokens = False
    ids = [*real.encode("a <|endoftext|> b").ids, 0]
    assert 50256 in ids and got[1, 0].length == len(ids) and got[1, 0].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sum(r.length for r in got.values() if r.doc_id == 2) == len(real.encode(runs[0] + "x").ids) + 1
