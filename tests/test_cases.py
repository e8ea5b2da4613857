"""Small hand-made cases with known answers."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subvox.functions import arrays, text
from subvox.functions.fixed import PHONES
from subvox.operators import classify as cl
from subvox.operators import decode as dc
from subvox.operators import events as ev
from subvox.operators import lexicon as lx
from subvox.operators import lm as lmod
from subvox.operators import metrics as m
from subvox.operators import monitor as mon
from subvox.operators import phones as ph
from subvox.operators import sessions as ss
from subvox.operators import signal as sg
from subvox.operators import splits as sp


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# --- markers and labels -----------------------------------------------------------------


def test_marker_layouts(spark):
    at = spark.createDataFrame([(0.5, "a"), (1.0, "b")], " Time_S double, label string")
    assert rows(ev.normalize_markers(at, 250)) == [(125, 155, "a"), (250, 280, "b")]
    points = spark.createDataFrame([(100, "a"), (400, "b")], "sample int, label string")
    assert rows(ev.normalize_markers(points, 250)) == [(100, 130, "a"), (400, 430, "b")]
    spans = spark.createDataFrame([(10, 20, "a"), (20, 20, "b")], "start_sample int, end_sample int, label string")
    assert rows(ev.normalize_markers(spans, 250)) == [(10, 20, "a")]
    with pytest.raises(ValueError):
        ev.normalize_markers(spark.createDataFrame([("a",)], "label string"), 250)


def test_null_trials(spark):
    df = spark.createDataFrame([(0.0, None, "a"), (None, 1.0, "b"), (2.0, 3.0, "c")], "trial_id double, word_idx double, label string")
    assert rows(ev.sanitize_trial_events(df)) == [(0, 0, "a"), (2, 3, "c")]


def test_slug(spark):
    df = spark.createDataFrame([("  Hello, World! ",), ("***",), ("x" * 60,)], "t string")
    assert [r[0] for r in df.select(text.slug(F.col("t"))).collect()] == ["hello_world", "unknown", "x" * 48]


def test_merge(spark):
    a = spark.createDataFrame([(0, 5, 3)], "start_sample long, end_sample long, trial_id long")
    merged = ev.merge_sessions(a, a, 100)
    assert rows(merged, "start_sample", "end_sample", "trial_id") == [(0, 5, 3), (100, 105, 7)]


def test_counts_round_trip(spark):
    df = spark.createDataFrame([([5, -7, 32767, -32768],)], "c array<int>")
    back = df.select(arrays.quantize(arrays.scale_counts(F.col("c")))).first()[0]
    assert back == [5, -7, 32767, -32768]
    assert spark.range(1).select(arrays.quantize_value(F.lit(1e9)), arrays.quantize_value(F.lit(-1e9))).first()[:] == (32767, -32768)


def test_channel_range(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    assert df.select(arrays.select_channels(F.col("x"), F.lit(2), [1])).first()[0] == [2.0, 4.0]
    with pytest.raises(Exception, match="out of range"):
        df.select(arrays.select_channels(F.col("x"), F.lit(2), [2])).collect()


# --- splits -------------------------------------------------------------------------------


def test_balanced_split(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "id int, label string")
    got = sp.split_stratified(df, ["id"], 0.25, 1).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {(c, s): n for c in "abc" for s, n in (("train", 15), ("val", 5))}


def test_rare_label_stays_in_training(spark):
    df = spark.createDataFrame([(0, "rare")] + [(i, "common") for i in range(1, 5)], "id int, label string")
    got = rows(sp.split_stratified(df, ["id"], 0.5, 1), "label", "split")
    assert ("rare", "train") in got and got.count(("common", "val")) == 2


def test_groups_do_not_leak(spark):
    df = spark.createDataFrame([(t, w, "abcd"[(t + w) % 4]) for t in range(40) for w in range(4)], "trial_id int, w int, label string")
    got = sp.split_grouped(df, ["trial_id"], 0.25, 3).select("trial_id", "split").distinct()
    assert got.count() == 40 and got.where("split = 'val'").count() > 0


def test_official_and_merged(spark):
    df = spark.createDataFrame([(0, t) for t in range(600)] + [(1, t) for t in range(500)], "session_id int, trial_id int")
    n = {s: c for s, c in rows(sp.split_official(df.where("session_id = 1")).groupBy("split").count())}
    assert n == {"train": 370, "val": 30, "test": 100}
    merged = sp.split_merged(df)
    assert {s: c for s, c in rows(merged.where("session_id = 0").groupBy("split").count())} == {"train": 470, "val": 30, "test": 100}
    assert merged.where("session_id = 0 AND trial_id >= 500 AND split <> 'train'").count() == 0


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "abc"[i * i % 3]) for i in range(200)], "id int, label string")
    spread = [rows(sp.split_stratified(d, ["id"], 0.3, 5)) for d in (df.coalesce(1), df.repartition(7))]
    assert spread[0] == spread[1]


def test_sample_fractions(spark):
    df = spark.createDataFrame([(0, t, w) for t in range(400) for w in range(4)], "session_id int, trial_id int, w int")
    assert sp.sample_trials(df, 0, 1).count() == 0 and sp.sample_trials(df, 1, 1).count() == df.count()
    assert sp.sample_trials(df, 0.1, 1).count() == 37 * 4


# --- sessions and gaps ----------------------------------------------------------------------


def test_modes(spark):
    df = spark.createDataFrame([("wide", "clinical"), (None, "gowda"), ("x", "y"), (None, None)], "model_mode string, profile_mode string")
    assert rows(ss.resolve_mode(df), "mode", "mode_conflict") == [("gowda", False), ("standard", False), ("standard", False), ("wide", True)]


def test_gaps(spark):
    df = spark.createDataFrame([("d", 0, 0, 10), ("d", 1, 12, 10), ("d", 2, 5, 10), ("d", 3, 20, 1)], "device_id string, arrival_no long, sample_index long, frames long")
    assert rows(sg.detect_gaps(df, chunk=2), "arrival_no", "lost", "lost_total") == [(0, 0, 0), (1, 2, 2), (2, 0, 2), (3, 5, 7)]


# --- lexicon and phones -----------------------------------------------------------------------


def test_base_lexicon_is_valid(spark):
    base = lx.base_lexicon(spark)
    assert lx.validate_lexicon(base).count() == 0
    bad = spark.createDataFrame([("a", []), ("b", ["1x", "AA"])], "word string, phones array<string>")
    assert rows(lx.validate_lexicon(bad), "word", "issue") == [("a", "empty phone list"), ("b", "invalid phone")]


def test_look_up(spark):
    lex = spark.createDataFrame([("nineteen", ["N", "AY"]), ("eighty", ["EY", "T"]), ("icecream", ["AY", "S"])], "word string, phones array<string>")
    words = spark.createDataFrame([("nineteen_eighty",), ("Ice-cream",), ("fm",), ("unknownword",), ("nineteen x",)], "word string")
    got = {r.word: r.phones for r in lx.look_up(words, lex).collect()}
    assert got == {"nineteen_eighty": ["N", "AY", "EY", "T"], "Ice-cream": ["AY", "S"], "fm": ["F", "M"], "unknownword": None, "nineteen x": ["N", "AY"]}


def test_pronunciations(spark, tmp_path):
    (tmp_path / "d.txt").write_text(";;; note\nREAD  R EH1 D\nREAD(1)  R IY1 D\nBAD\nTHE(2)  DH IY0\n")
    got = {r.word: r.phones for r in lx.read_pronunciations(spark, str(tmp_path / "d.txt")).collect()}
    assert got == {"read": ["R", "EH", "D"], "the": ["DH", "IY"]}


def test_phone_spans_cover_the_word(spark):
    df = spark.createDataFrame([(i, 0, 10 + i, ["B", "AA", "T", "ZZ"][: 1 + i % 4]) for i in range(40)], "event_id long, start_sample long, end_sample long, phones array<string>")
    for mode in ("pseudo", "corpus_duration"):
        got = {}
        for r in ph.phone_spans(df, mode).orderBy("event_id", "phone_idx").collect():
            got.setdefault(r.event_id, []).append((r.start_sample, r.end_sample))
        for i, spans in got.items():
            assert spans[0][0] == 0 and spans[-1][1] == 10 + i and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert all(b - a >= 2 for a, b in spans)


def test_separability_of_tight_clusters(spark):
    rng = np.random.default_rng(0)
    data = [(p, [float(v) for v in rng.normal(size=4) * 0.01 + 10 * (c + 1)]) for c, p in enumerate("abc") for _ in range(20)]
    df = spark.createDataFrame(data, "phone string, v array<double>")
    a, b = ph.separability(df).first(), ph.separability(df.repartition(5)).first()
    assert a.n_phones == 3 and a.n_vectors == 60 and a.between_over_within > 100
    assert a.between_over_within == pytest.approx(b.between_over_within)
    assert ph.centroid_cosine(df, df).first().cosine_mean == pytest.approx(1, abs=1e-6)


# --- language model and decoding ----------------------------------------------------------------

DATES = [(0, ["monday", "january", "first", "nineteen_ninety"]), (1, ["tuesday", "january", "second", "nineteen_ninety"])]


@pytest.fixture(scope="module")
def dates(spark):
    return spark.createDataFrame([(t, i, w) for t, ws in DATES for i, w in enumerate(ws)], "trial_id long, word_idx long, label string")


def test_trial_lm(dates):
    model = lmod.fit_trial_lm(dates)
    slot = {(r.slot, r.word): r.logp for r in model.slot.collect()}
    assert slot[1, "january"] == pytest.approx(math.log(2.1 / 2.1)) and slot[0, "monday"] == pytest.approx(math.log(1.1 / 2.2))
    assert {r.word for r in model.slot_words.where("slot = 0").collect()} >= {"sunday", "monday"}
    assert model.slot_words.where("slot = 1").count() == 12
    tri = {(r.prev2, r.prev, r.word): r.logp for r in model.trigram.collect()}
    assert tri["monday", "january", "first"] == pytest.approx(math.log(1.1 / 1.1))


def reference_score(word, prev, slot):
    slots = {0: {"monday": 1, "tuesday": 1}, 1: {"january": 2}, 2: {"first": 1, "second": 1}, 3: {"nineteen_ninety": 2}}
    sizes = {0: 7, 1: 12, 2: 2, 3: 1}
    smooth = lambda c, ctr: math.log((c + 0.1) / (sum(ctr.values()) + 0.1 * len(ctr)))
    out = smooth(slots[slot][word], slots[slot]) if word in slots[slot] else math.log(0.1 / sizes[slot])
    bi = {}
    for _, ws in DATES:
        for a, b in zip(ws, ws[1:]):
            bi.setdefault(a, {}).setdefault(b, 0)
            bi[a][b] += 1
    if prev:
        ctr = bi.get(prev, {})
        out += smooth(ctr[word], ctr) if word in ctr else math.log(0.1)
    return out


def test_lm_score(spark, dates):
    model = lmod.fit_trial_lm(dates)
    asked = [("monday", None, 0), ("sunday", None, 0), ("january", "monday", 1), ("march", "monday", 1), ("first", "january", 2)]
    df = spark.createDataFrame([(s, w, p, None) for w, p, s in asked], "slot long, word string, prev string, prev2 string")
    got = {(r.word, r.prev, r.slot): r.lm_score for r in lmod.lm_score(df, model).collect()}
    for key in asked:
        assert got[key] == pytest.approx(reference_score(*key))


def all_paths(logp, ids):
    """Best score over every alignment of ``ids`` with blanks allowed between."""
    best = -math.inf
    for path in itertools.product(range(logp.shape[1]), repeat=len(logp)):
        merged = [c for i, c in enumerate(path) if c and (i == 0 or path[i - 1] != c)]
        if merged == ids:
            best = max(best, sum(logp[t, c] for t, c in enumerate(path)))
    return best


def test_paths_against_brute_force():
    rng = np.random.default_rng(4)
    logp = np.log(rng.dirichlet(np.ones(4), size=6))
    words = [[1, 2], [3], [1, 1], [2, 3, 1], [1], [1, 2, 3], [1, 2], [2, 2, 2], []]
    got = dc.PhoneTrie(words).best(logp)
    for w, score in zip(words, got):
        assert score == pytest.approx(all_paths(logp, w))
    assert dc.PhoneTrie([[1, 2, 1, 2, 1, 2, 3]]).best(logp)[0] < -1e29  # more phones than frames


def test_words_share_the_states_of_common_phones():
    tree = dc.PhoneTrie([[1, 2, 3], [1, 2], [1, 2, 3, 4], [2]])
    assert len(tree.parent) == 1 + 5 and len(dc.PhoneTrie([]).best(np.zeros((3, 4)))) == 0


def test_greedy(spark):
    def frame(c):
        return [0.0 if i == c else -9.0 for i in range(40)]

    data = [("u", i, frame(c)) for i, c in enumerate([0, 5, 5, 0, 5, 7, 7])] + [("silent", 0, frame(0))]
    df = spark.createDataFrame(data, "utt_id string, frame int, logp array<double>")
    got = {r.utt_id: r.phones for r in dc.greedy_collapse(df, chunk=2).collect()}
    assert got == {"u": [PHONES[5], PHONES[5], PHONES[7]], "silent": []}


def test_trial_decoding_follows_the_model(spark, dates):
    """The score is even, so the model decides; the second trial starts with tuesday by score."""
    model = lmod.fit_trial_lm(dates).saved()
    cands = [(t, s, w, 0.5 if (t, w) == (1, "tuesday") else 0.0, 1.0) for t in (0, 1) for s, w in ((0, "monday"), (0, "tuesday"), (1, "january"), (1, "march"), (2, "first"), (2, "second"), (3, "nineteen_ninety"))]
    df = spark.createDataFrame(cands, "trial_id long, slot long, word string, score double, weight double")
    got = {(r.trial_id, r.slot): r.hyp for r in dc.decode_trials(df, model, 4).collect()}
    assert [got[0, s] for s in range(4)] == ["monday", "january", "first", "nineteen_ninety"]
    assert [got[1, s] for s in range(4)] == ["tuesday", "january", "second", "nineteen_ninety"]
    refs = spark.createDataFrame([(t, i, w) for t, ws in DATES for i, w in enumerate(ws)], "trial_id long, slot long, ref string")
    tuned = {r.weight: r for r in dc.tune_lm_weight(df.drop("weight"), refs, model, 4, [0.0, 1.0, 2.0]).collect()}
    assert tuned[1.0].best and tuned[1.0].accuracy == 1.0 and not tuned[2.0].best and tuned[0.0].accuracy < 1.0


def test_one_pass_and_joins_decode_alike(spark, dates):
    """A model that is too large for the tasks is joined; missing slots, unknown words, ties and repeated rows included."""
    model = lmod.fit_trial_lm(dates).saved()
    rng = np.random.default_rng(8)
    words = [w for _, ws in DATES for w in ws] + ["other", "another", None]
    rows = [
        (trial, slot, words[rng.integers(len(words))], None if rng.random() < 0.05 else float(rng.integers(0, 3)), float(rng.choice([-1.0, 0.0, 0.7, 2.0])))
        for trial in range(40) for slot in range(6) if rng.random() < 0.8 for _ in range(4)
    ]
    df = spark.createDataFrame(rows + rows[:20], "trial_id long, slot long, word string, score double, weight double").repartition(4)
    one, joined = (sorted(map(tuple, dc.decode_trials(df, model, 6, model_rows=n).collect())) for n in (dc.MODEL_ROWS, 3))
    assert one == joined and len(one) > 150
    assert dc.decode_trials(df.limit(0), model, 6).count() == 0


@pytest.mark.parametrize("bucket", [4096, 10])
def test_importance_of_channels(spark, bucket):
    """Channel 0 tells the classes apart, channel 1 is noise, channel 2 is even; all values stay in their channel."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(i % 2) * 4 + rng.normal() * 0.1, rng.normal() * 0.1, 1.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "frame long, label long, x array<double>").repartition(4)
    got = {r.channel: r for r in cl.channel_importance(df, cl.fit_centroids(df), 3, bucket=bucket).collect()}
    digest = {i: hashlib.md5(f"0:{i}".encode()).hexdigest() for i, _, _ in rows}
    n = max(1, len(rows) // bucket)
    groups: dict = {}
    for i in sorted(digest, key=digest.get):
        groups.setdefault(int(digest[i][:12], 16) % n, []).append(i)
    donor = {i: g[(at + 1) % len(g)] for g in groups.values() for at, i in enumerate(g)}
    kept = sum(i % 2 == donor[i] % 2 for i in donor)
    assert got[0].drop == pytest.approx(1 - kept / len(rows)) and got[0].importance == 1.0
    assert got[1].drop == got[2].drop == 0.0
    assert cl.channel_importance(df.where("frame = 0"), cl.fit_centroids(df), 3).first().drop == 0.0


# --- metrics ---------------------------------------------------------------------------------


def test_error_rates(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abd", "abc")], "hyp string, ref string")
    assert m.distance_rate(df, "hyp", "ref").first().rate == pytest.approx(1 / 6)
    words = [(0, i, r, h) for i, (r, h) in enumerate([("a", "a"), ("b", "x"), ("c", "c"), ("d", "d")])]
    pred = spark.createDataFrame(words, "trial_id long, word_idx long, ref string, hyp string")
    assert m.word_error_rate(pred).first().wer == pytest.approx(0.25)
    assert m.word_error_rate(pred, segment=2).first().n_words == 4
    shifted = spark.createDataFrame([(0, i, f"w{i % 999}", f"w{(i + 1) % 999}" if i < 1099 else "end") for i in range(1100)], pred.schema)
    assert m.word_error_rate(shifted).first().distance == 2  # one alignment of the whole trial


def test_absent_class_scores_zero(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "ref string, hyp string")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    got = {r.label: r for r in m.classification_metrics(pred, labels).collect()}
    assert got["c"].f1 == 0 and got["a"].recall == 0.5
    assert m.split_summary(m.classification_metrics(pred, labels)).first().macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    keyed = m.classification_metrics(pred.withColumn("g", F.lit(1)), labels, ["g"])
    assert keyed.count() == 3


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(2000).select("id", (F.col("id") % 4 == 0).cast("double").alias("hit"))
    b = m.bootstrap_ci(df, ["id"], "hit", replicates=300).first()
    assert b.ci95_low < 0.25 < b.ci95_high and 0.02 < b.ci95_high - b.ci95_low < 0.06


def _weights(seed, key, replicates):
    """Poisson weights of one row, read from sha256 texts one by one."""
    cuts, out = m.poisson_cuts(), []
    for r in range(replicates):
        text = hashlib.sha256(f"{seed}:{key}:{r // 16}".encode()).hexdigest()
        u = int(text[r % 16 * 4 : r % 16 * 4 + 4], 16)
        out.append(sum(u >= c for c in cuts))
    return out


def test_poisson_cuts():
    weight = np.searchsorted(m.poisson_cuts(), np.arange(65536), side="right")
    assert abs(weight.mean() - 1) < 1e-3 and abs(weight.var() - 1) < 1e-3


def test_replicate_sums_are_those_of_every_row(spark):
    rows = [(i, None if i % 7 == 3 else ["a", "b", "a:b"][i % 3], None if i % 11 == 5 else i * 0.5) for i in range(400)] + [(5, "b", 2.0)] * 3
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    got = {(r.g, r._rep): (r._s, r._n) for r in m.replicate_sums(df, ["id"], "v", replicates=21, seed=9, groups=["g"]).collect()}
    want: dict = {}
    for i, g, v in rows:
        if v is not None:
            for rep, w in enumerate(_weights(9, i, 21), 1):
                s, n = want.get((g, rep), (0.0, 0))
                want[g, rep] = (s + w * v, n + w)
    want = {k: v for k, v in want.items() if v[1]}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r._rep for r in m.replicate_sums(df, ["id"], "v", replicates=3).collect()} == {1, 2, 3}


def test_bootstrap_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([(1, "a", 0.5)], "id long, g string, v double")
    assert m.bootstrap_ci(df.limit(0), ["id"], "v").first().mean is None
    assert m.bootstrap_ci(df.limit(0), ["id"], "v", groups=["g"]).count() == 0
    one = m.bootstrap_ci(df, ["id"], "v").first()
    assert one.mean == one.ci95_low == one.ci95_high == 0.5 and 90 < one.n_bootstrap < 160  # a third of the draws leave the row out
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    cells = spark.createDataFrame([(i, "ab"[i % 2], "ab"[i % 2]) for i in range(200)], "id long, ref string, hyp string")
    whole = m.bootstrap_macro_f1_ci(cells, ["id"], labels, replicates=20).first()
    assert (whole.mean, whole.ci95_low, whole.n_bootstrap) == (1.0, 1.0, 20)


def test_pooled_interval_over_runs(spark):
    rows = [(run, i, g, float((i * 7 + run) % (3 + run) == 0)) for run in range(3) for i in range(300) for g in ("x", None)]
    df = spark.createDataFrame(rows, "run long, id long, g string, hit double")
    for r in m.pooled_summary(df, "run", ["id"], "hit", groups=["g"]).collect():
        own = [[x[3] for x in rows if x[0] == k and x[2] == r.g] for k in range(3)]
        means = [sum(o) / len(o) for o in own]
        assert r.n_runs == 3 and r.run_mean == pytest.approx(np.mean(means)) and r.run_std == pytest.approx(np.std(means))
        assert r.ci95_low < np.mean(sum(own, [])) < r.ci95_high
    assert m.pooled_summary(df, "run", ["id"], "hit").count() == 1


def test_error_categories(spark):
    cases = [("monday", "sunday", 0, "weekday"), ("march", "may", 1, "month"), ("x", "y", 2, "ordinal"), ("nineteen_ten", "nineteen", 3, "year_truncation"),
             ("nineteen", "nineteen_ten", 3, "year_overgen"), ("nineteen_ten", "nineteen_two", 3, "year_same_era"), ("a", "", 3, "year_other"), ("a", "b", 5, "other"), ("a", "a", 0, "correct")]
    df = spark.createDataFrame([c[:3] for c in cases], "ref string, hyp string, slot int")
    got = [r[0] for r in df.select(m.error_category(F.col("ref"), F.col("hyp"), F.col("slot"))).collect()]
    assert got == [c[3] for c in cases]


# --- gates and monitors -------------------------------------------------------------------------


def gate(spark, rows_, cfg):
    data = [("s", i, t, tok, c, snr, ab) for i, (tok, c, t, snr, ab) in enumerate(rows_)]
    df = spark.createDataFrame(data, "session_id string, step long, t double, token string, confidence double, snr_db double, abstain boolean")
    return [(r.step, r.token) for r in mon.stabilize_tokens(df, cfg).orderBy("step").collect()]


def test_gate(spark):
    seq = [("a", 0.9, 0.0, None, False), ("b", 0.9, 0.1, None, False), ("a", 0.9, 0.2, None, False), ("a", 0.9, 0.3, None, False)]
    assert gate(spark, seq, mon.GateConfig(stable_n=2)) == [(3, "a")]
    again = seq + [("a", 0.9, 0.4, None, False), ("a", 0.9, 0.6, None, False)]
    assert gate(spark, again, mon.GateConfig(stable_n=2)) == [(3, "a"), (5, "a")]
    cleared = seq[:3] + [("a", 0.9, 0.25, None, True), seq[3]]
    assert gate(spark, cleared, mon.GateConfig(stable_n=2)) == []
    weak = [("a", 0.72, 0.1 * i, 10.0, False) for i in range(3)]
    assert gate(spark, weak, mon.GateConfig(stable_n=2)) and not gate(spark, weak, mon.GateConfig(stable_n=2, baseline_snr_db=20.0))
    assert gate(spark, seq, mon.GateConfig(stable_n=2, blank="a")) == []


def test_recalibration(spark):
    data = [("s", i, 100.0 + 10 * i, 14.0, 0.0, 20.0) for i in range(5)]
    df = spark.createDataFrame(data, "session_id string, seq long, t double, snr_db double, motion_index double, baseline double")
    got = mon.recalibration_monitor(df).orderBy("seq").collect()
    assert [r.suggested for r in got] == [False, False, True, True, True]
    assert [r.broadcast for r in got] == [False, False, True, False, False]
    once = spark.createDataFrame([("a", 14.0, 20.0, 0.0), ("b", None, 20.0, 0.0), ("c", 19.0, 20.0, 0.5)], "session_id string, snr_db double, baseline double, motion_index double")
    checked = {r.session_id: (r.suggested, list(r.reasons)) for r in mon.session_recal_check(once).collect()}
    assert checked == {"a": (True, ["snr_deficit_6.0db"]), "b": (False, ["missing_baseline_or_session_snr"]), "c": (False, ["motion_index_0.50"])}


def test_threshold_without_right_answers(spark):
    df = spark.createDataFrame([("u", "a", "b", 0.9), ("v", "a", "a", 0.9)], "user_id string, ref string, hyp string, conf double")
    assert {r.user_id: r.threshold for r in cl.confidence_threshold(df, ["user_id"]).collect()} == {"u": 0.70, "v": 0.9}


def test_sweep_bounds(spark):
    df = spark.createDataFrame([(0, 100, 105, 1000), (1, 100, 400, 1000), (2, 5, 30, 1000)], "event_id long, start_sample long, end_sample long, n_samples long")
    got = {r.event_id: (r.cut_start, r.cut_end, r.pad) for r in cl.sweep_bounds(df, [400], 250).collect()}
    assert got == {0: (52, 152, 0), 1: (300, 400, 0), 2: (0, 30, 70)}


def test_utterance_rules(spark):
    chunks = spark.createDataFrame([("s", i, 50) for i in range(30)], "session_id string, seq long, n_frames long")
    controls = spark.createDataFrame([("s", 10, "start", 0), ("s", 12, "end", 1), ("s", 20, "start", 2)], "session_id string, seq long, cmd string, at int")
    got = mon.ptt_utterances(chunks, controls, 1000.0, chunk=4)
    assert rows(got, "utterance", "seq") == [(1, s) for s in range(2, 12)]
    assert mon.ptt_utterances(chunks, controls, 1000.0, min_ms=501).count() == 0
    assert mon.ptt_utterances(chunks, controls, 1000.0, max_ms=120).agg(F.sum("keep_frames")).first()[0] == 120
