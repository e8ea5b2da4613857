"""Queries over lexicons, phones, covariance features and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from subvox.catalog.registry import query
from subvox.functions.fixed import BASE_LEXICON, PHONE_MS, PHONE_WEIGHT, PHONES
from subvox.operators import lexicon as lx
from subvox.operators import metrics as m
from subvox.operators import phones as ph
from subvox.operators import spd
from subvox.plans import proxies as px

FRAMES_PER_EVENT = 50


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


BASE_SQL = "base(word, phones) AS (VALUES " + ", ".join(f"('{w}', [{quoted(p)}])" for w, p in BASE_LEXICON.items()) + ")"
# Every part type word is given phones by its letters; a letter is a phone when the inventory has it.
LETTERS_SQL = f"""letters AS (SELECT DISTINCT lower(p_type) AS word,
  list_filter(string_split(upper(p_type), ''), lambda c: list_contains([{quoted(PHONES[1:])}], c)) AS phones FROM part)"""


def letters(spark, sf):
    """A lexicon from the part types: the letters that are phones."""
    word = F.col("p_type")
    spelled = F.filter(F.split(F.upper(word), ""), lambda c: c.isin(PHONES[1:]))
    return px.table(spark, sf, "part").select(F.lower(word).alias("word"), spelled.alias("phones")).distinct()


LOOK_SQL = f"""{LETTERS_SQL}, lex AS (SELECT word, phones FROM letters WHERE len(phones) > 0),
q AS (SELECT DISTINCT w AS word, replace(regexp_replace(lower(trim(w)), '\\s+', ' ', 'g'), '_', '-') AS k FROM (
  SELECT p_type AS w FROM part UNION ALL SELECT p_type || '_' || split_part(p_name, ' ', 1) FROM part UNION ALL
  SELECT upper(p_type) || ' ' || lower(p_type) FROM part UNION ALL SELECT substr(p_name, 1, 2) FROM part)),
whole AS (SELECT q.word, q.k, l.phones FROM q LEFT JOIN lex l ON l.word = q.k),
parts AS (SELECT word, unnest(range(1, len(regexp_split_to_array(k, '[ \\-]+')) + 1)) AS i, unnest(regexp_split_to_array(k, '[ \\-]+')) AS part
          FROM whole WHERE phones IS NULL AND regexp_matches(k, '[ -]')),
found AS (SELECT p.word, p.i, coalesce(l.phones, CASE WHEN length(p.part) <= 3 AND regexp_full_match(p.part, '[a-z]+') THEN
            list_filter(string_split(upper(p.part), ''), lambda c: list_contains([{quoted(PHONES[1:])}], c)) END) AS phones
          FROM parts p LEFT JOIN lex l ON l.word = p.part WHERE p.part <> ''),
glued AS (SELECT word, flatten(list(phones ORDER BY i)) AS phones FROM found WHERE len(phones) > 0 GROUP BY word),
done AS (SELECT w.word, coalesce(w.phones, g.phones, CASE WHEN NOT regexp_matches(w.k, '[ -]') AND length(w.k) <= 3 AND regexp_full_match(w.k, '[a-z]+')
  THEN CASE WHEN len(list_filter(string_split(upper(w.k), ''), lambda c: list_contains([{quoted(PHONES[1:])}], c))) > 0 THEN
       list_filter(string_split(upper(w.k), ''), lambda c: list_contains([{quoted(PHONES[1:])}], c)) END END) AS phones
  FROM whole w LEFT JOIN glued g USING (word))"""


@query("look_up_phones", f"WITH {LOOK_SQL} SELECT word, array_to_string(phones, ' ') AS phones FROM done")
def look_up_phones(spark, sf):
    part = px.table(spark, sf, "part")
    forms = F.array(
        F.col("p_type"),
        F.concat("p_type", F.lit("_"), F.split("p_name", " ")[0]),
        F.concat(F.upper("p_type"), F.lit(" "), F.lower("p_type")),
        F.substring("p_name", 1, 2),
    )
    words = part.select(F.explode(forms).alias("word"))
    found = lx.look_up(words, letters(spark, sf).where(F.size("phones") > 0))
    return found.select("word", F.array_join("phones", " ").alias("phones"))


@query(
    "lexicon_overlay",
    f"""WITH {BASE_SQL}, {LETTERS_SQL}, mine AS (SELECT word, phones FROM letters UNION ALL SELECT 'stop', ['X'] UNION ALL SELECT 'no', []::VARCHAR[])
SELECT coalesce(m.word, b.word) AS word, array_to_string(coalesce(m.phones, b.phones), ' ') AS phones FROM base b FULL JOIN mine m ON m.word = b.word""",
)
def lexicon_overlay(spark, sf):
    extra = spark.createDataFrame([(" STOP ", ["x", " "]), ("No", [])], "word string, phones array<string>")
    merged = lx.overlay(lx.base_lexicon(spark), letters(spark, sf).unionByName(extra))
    return merged.select("word", F.array_join("phones", " ").alias("phones"))


@query(
    "validate_lexicon",
    """WITH l AS (SELECT p_partkey::VARCHAR AS word, CASE WHEN p_size % 5 = 0 THEN [] ELSE [p_type, p_brand, split_part(p_name, ' ', 2)] END AS phones FROM part)
SELECT word, 'empty phone list' AS issue, NULL AS phone FROM l WHERE len(phones) = 0
UNION ALL SELECT word, 'invalid phone', p FROM (SELECT word, unnest(phones) AS p FROM l) WHERE NOT regexp_full_match(p, '[A-Za-z@][A-Za-z0-9@\\-]*')""",
)
def validate_lexicon(spark, sf):
    p = px.table(spark, sf, "part")
    given = F.array("p_type", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(2)))
    phones = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(given)
    return lx.validate_lexicon(p.select(F.col("p_partkey").cast("string").alias("word"), phones.alias("phones")))


@query(
    "phone_inventory",
    f"""WITH {LETTERS_SQL}, w AS (SELECT DISTINCT lower(p_type) AS word FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 1)) FROM part)
SELECT DISTINCT unnest(CASE WHEN l.word IS NULL THEN ['@' || w.word] ELSE l.phones END) AS phone FROM w LEFT JOIN letters l USING (word)""",
)
def phone_inventory(spark, sf):
    p = px.table(spark, sf, "part")
    labels = p.select(F.explode(F.array("p_type", F.split("p_name", " ")[0])).alias("label"))
    return lx.phone_inventory(labels, letters(spark, sf))


@query(
    "nearest_words",
    """WITH lex AS (SELECT p_type AS word, row_number() OVER (ORDER BY p_type) - 1 AS rank FROM (SELECT DISTINCT p_type FROM part)),
h AS (SELECT DISTINCT event_type AS code FROM events UNION SELECT DISTINCT upper(event_type) FROM events UNION SELECT DISTINCT p_type FROM part
      UNION SELECT DISTINCT upper(p_name) FROM part)
SELECT code, word, CAST(d AS BIGINT) AS distance FROM (
  SELECT h.code, l.word, levenshtein(h.code, l.word) AS d, row_number() OVER (PARTITION BY h.code ORDER BY levenshtein(h.code, l.word), l.rank) AS r
  FROM h, lex l WHERE h.code <> '') WHERE r = 1""",
)
def nearest_words(spark, sf):
    from pyspark.sql import Window

    part, e = px.table(spark, sf, "part"), px.table(spark, sf, "events")
    # The distinct part types are a closed vocabulary of a few words.
    ranked = part.select(F.col("p_type").alias("word")).distinct().withColumn("rank", F.row_number().over(Window.orderBy("word")) - 1)
    codes = e.select("event_type").distinct().select(F.explode(F.array("event_type", F.upper("event_type"))).alias("code"))
    codes = codes.unionByName(part.select(F.explode(F.array("p_type", F.upper("p_name"))).alias("code")))
    out = lx.nearest_words(codes, ranked.withColumn("code", F.col("word")))
    return out.select("code", "word", F.col("distance").cast("long").alias("distance"))


def _weights(table, other) -> str:
    return "CASE p " + " ".join(f"WHEN '{p}' THEN {float(w)!r}::DOUBLE" for p, w in table.items()) + f" ELSE {other!r}::DOUBLE END"


def _phone_span_sql(table, other: float) -> str:
    return f"""WITH w AS (SELECT l_orderkey AS event_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_orderkey * 100 AS a,
  l_orderkey * 100 + CAST(l_quantity AS BIGINT) * 2 AS b, upper(p_type) AS word FROM lineitem JOIN part ON p_partkey = l_partkey),
l AS (SELECT *, list_filter(string_split(word, ''), lambda c: c <> '') AS ps FROM w),
k AS (SELECT *, b - a AS n, len(ps) AS c, greatest(1, least(2, (b - a) // len(ps))) AS m FROM l WHERE b - a >= len(ps)),
e AS (SELECT *, unnest(range(0, c)) AS i, unnest(ps) AS p FROM k),
s AS (SELECT *, greatest(n - m * c, 0) * ({_weights(table, other)}) / sum({_weights(table, other)}) OVER (PARTITION BY event_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS share,
             greatest(n - m * c, 0) AS free FROM e),
f AS (SELECT *, floor(share) AS fl, free - sum(floor(share)) OVER (PARTITION BY event_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS extra,
             row_number() OVER (PARTITION BY event_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice ORDER BY round(-(share - floor(share)), 9), i) AS r FROM s),
g AS (SELECT *, m + fl + CASE WHEN r <= extra THEN 1 ELSE 0 END AS len FROM f),
z AS (SELECT event_id, i, p, a, len, sum(len) OVER (PARTITION BY event_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice ORDER BY i) AS upto FROM g)
SELECT event_id, CAST(i AS BIGINT) AS phone_idx, p AS phone, CAST(a + upto - len AS BIGINT) AS start_sample, CAST(a + upto AS BIGINT) AS end_sample FROM z"""


def _phone_spans(spark, sf, mode):
    li, part = px.table(spark, sf, "lineitem"), px.table(spark, sf, "part")
    words = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("event_id"), (F.col("l_orderkey") * 100).alias("start_sample"),
        (F.col("l_orderkey") * 100 + F.col("l_quantity").cast("long") * 2).alias("end_sample"),
        F.filter(F.split(F.upper("p_type"), ""), lambda c: c != "").alias("phones"),
    )
    out = ph.phone_spans(words, mode)
    return out.select("event_id", F.col("phone_idx").cast("long").alias("phone_idx"), "phone", "start_sample", "end_sample")


@query("phone_spans", _phone_span_sql(PHONE_WEIGHT, 0.6))
def phone_spans(spark, sf):
    return _phone_spans(spark, sf, "pseudo")


@query("phone_spans_corpus", _phone_span_sql(PHONE_MS, 80.0))
def phone_spans_corpus(spark, sf):
    return _phone_spans(spark, sf, "corpus_duration")


VECTORS_SQL = """v AS (SELECT vec_id, CAST(label AS BIGINT) AS phone, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT phone, k, avg(x) AS m FROM v GROUP BY ALL)"""


@query(
    "separability",
    f"""WITH {VECTORS_SQL},
w AS (SELECT vec_id, sqrt(sum((x - m) * (x - m))) AS d FROM v JOIN c USING (phone, k) GROUP BY vec_id),
b AS (SELECT a.phone AS p, c2.phone AS q, sqrt(sum((a.m - c2.m) * (a.m - c2.m))) AS d FROM c a JOIN c c2 ON a.k = c2.k AND a.phone < c2.phone GROUP BY ALL),
s AS (SELECT (SELECT quantile_cont(d, 0.5) FROM w) AS within, (SELECT quantile_cont(d, 0.5) FROM b) AS between)
SELECT (SELECT count(DISTINCT phone) FROM c) AS n_phones, (SELECT count(*) FROM embeddings) AS n_vectors, round(within, 6) AS median_within,
       round(between, 6) AS median_between, round(between / (within + 1e-9::DOUBLE), 6) AS between_over_within FROM s""",
)
def separability(spark, sf):
    s = ph.separability(px.px_frames(spark, sf), "phone", "x")
    return s.select("n_phones", "n_vectors", *[F.round(c, 6).alias(c) for c in ("median_within", "median_between", "between_over_within")])


@query(
    "centroid_cosine",
    """WITH v AS (SELECT vec_id % 2 AS half, CAST(label AS BIGINT) AS phone, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT half, phone, k, avg(x) AS m FROM v GROUP BY ALL),
d AS (SELECT a.phone, sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m)) + 1e-9::DOUBLE) AS cosine
      FROM c a JOIN c b ON a.phone = b.phone AND a.k = b.k AND a.half = 0 AND b.half = 1 GROUP BY a.phone)
SELECT round(avg(cosine), 6) AS cosine_mean, count(*) AS n_phones FROM d""",
)
def centroid_cosine(spark, sf):
    f = px.px_frames(spark, sf)
    even, odd = f.where(F.col("frame") % 2 == 0), f.where(F.col("frame") % 2 == 1)
    return ph.centroid_cosine(even, odd, "phone", "x").select(F.round("cosine_mean", 6).alias("cosine_mean"), "n_phones")


@query(
    "phone_templates",
    """WITH v AS (SELECT CAST(label AS VARCHAR) AS phone, vec_id, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT phone, k, avg(abs(x)) AS rms, avg(x) AS s, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT phone, avg(rms) AS rate, max(n) AS n, sum(rms) AS rms_total, sum(s) AS sigma_total FROM c GROUP BY phone)
SELECT phone, n AS n_segments, round(rms_total, 5) AS rms_total, round(sigma_total, 5) + 0.0 AS sigma_total, CAST(128 AS BIGINT) AS n_features,
       round(rate / (avg(rate) OVER () + 1e-9::DOUBLE), 6) AS rate_scale, 0.6::DOUBLE AS duration_weight FROM t""",
)
def phone_templates(spark, sf):
    f = px.px_frames(spark, sf)
    segments = f.select("frame", F.col("phone").cast("string").alias("phone"), F.transform("x", lambda v: F.abs(v)).alias("rms"), F.col("x").alias("sigma"))
    t = ph.phone_templates(segments, ["frame"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return t.select(
        "phone", "n_segments", F.round(total("channel_rms"), 5).alias("rms_total"), (F.round(total("spd_diag_delta"), 5) + 0.0).alias("sigma_total"),
        F.size("spd_diag_delta").cast("long").alias("n_features"), F.round("rate_scale", 6).alias("rate_scale"), "duration_weight",
    )


STATS_SQL = """e AS (SELECT CAST(label AS VARCHAR) AS corpus, vec_id, embedding[1]::DOUBLE * 100 AS snr_db, abs(embedding[2]::DOUBLE) AS motion_index,
  embedding[3]::DOUBLE AS corr, embedding FROM embeddings),
p AS (SELECT corpus, count(*) AS n_segments, quantile_cont(snr_db, 0.1) AS snr_p10, quantile_cont(snr_db, 0.5) AS median_snr_db, quantile_cont(snr_db, 0.9) AS snr_p90,
             quantile_cont(motion_index, 0.5) AS median_motion_index, avg(corr) AS corr_offdiag_mean FROM e GROUP BY corpus)"""


def _corpora(spark, sf):
    f = px.px_frames(spark, sf)
    x = lambda i: F.get("x", F.lit(i)).cast("double")
    events = f.select(
        F.col("phone").cast("string").alias("corpus"), (x(0) * 100).alias("snr_db"), F.abs(x(1)).alias("motion_index"),
        x(2).alias("corr_offdiag_mean"), F.col("x").alias("channel_rms"),
    )
    return ph.corpus_stats(events, ["corpus"])


@query(
    "corpus_stats",
    f"""WITH {STATS_SQL} SELECT corpus, n_segments, round(snr_p10, 4) AS snr_p10, round(median_snr_db, 4) AS median_snr_db, round(snr_p90, 4) AS snr_p90,
  round(median_motion_index, 6) AS median_motion_index, round(corr_offdiag_mean, 6) + 0.0 AS corr_offdiag_mean FROM p""",
)
def corpus_stats(spark, sf):
    s = _corpora(spark, sf)
    return s.select(
        "corpus", "n_segments", *[F.round(c, 4).alias(c) for c in ("snr_p10", "median_snr_db", "snr_p90")],
        F.round("median_motion_index", 6).alias("median_motion_index"), (F.round("corr_offdiag_mean", 6) + 0.0).alias("corr_offdiag_mean"),
    )


@query(
    "corpus_match",
    f"""WITH {STATS_SQL}, v AS (SELECT corpus, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM e),
c AS (SELECT corpus, k, avg(x) AS m FROM v GROUP BY ALL),
u AS (SELECT corpus, k, m / (sqrt(sum(m * m) OVER (PARTITION BY corpus)) + 1e-9::DOUBLE) AS m FROM c),
r AS (SELECT a.corpus, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM u a JOIN u b ON a.k = b.k AND b.corpus = '0' AND a.corpus <> '0' GROUP BY a.corpus)
SELECT p.corpus, round(abs(p.median_snr_db - z.median_snr_db) / 5, 5) AS snr_part, round(r.d, 5) AS rms_part,
       round(abs(p.median_snr_db - z.median_snr_db) / 5 + r.d + abs(p.corr_offdiag_mean - z.corr_offdiag_mean) + abs(p.median_motion_index - z.median_motion_index), 5) AS total
FROM p JOIN r USING (corpus), p z WHERE z.corpus = '0'""",
)
def corpus_match(spark, sf):
    c = ph.corpus_match(_corpora(spark, sf), "corpus", "0")
    return c.select("corpus", *[F.round(x, 5).alias(x) for x in ("snr_part", "rms_part", "total")])


def frame_events(spark, sf):
    """Events of fifty 64-channel frames each."""
    f = px.px_frames(spark, sf).withColumn("event_id", F.floor(F.col("frame") / FRAMES_PER_EVENT))
    rows = f.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("frame", "x"))).alias("r"))
    return rows.select(
        F.lit(0).cast("long").alias("session_id"), "event_id", F.flatten("r.x").alias("samples"), F.lit(64).alias("channels"),
        F.size("r").alias("n_frames"), F.lit(80.0).alias("fs_hz"),
    )


WINDOWS_SQL = f"""g AS (SELECT vec_id // {FRAMES_PER_EVENT} AS event_id, vec_id % {FRAMES_PER_EVENT} AS i, embedding FROM embeddings),
n AS (SELECT event_id, count(*) AS n FROM g GROUP BY event_id),
k AS (SELECT event_id, unnest(range(0, n - 7, 4)) AS s FROM n),
x AS (SELECT k.event_id, k.s // 4 AS frame, g.i, unnest(range(0, 64)) AS c, unnest(g.embedding)::DOUBLE AS x FROM k JOIN g ON g.event_id = k.event_id AND g.i >= k.s AND g.i < k.s + 8),
cov AS (SELECT a.event_id, a.frame, a.c AS i, b.c AS j, covar_samp(a.x, b.x) AS e FROM x a JOIN x b ON a.event_id = b.event_id AND a.frame = b.frame AND a.i = b.i AND a.c <= b.c GROUP BY ALL)"""


def _entries(covs):
    """Upper triangles as rows ``(event_id, frame, at, e)``."""
    return covs.select("event_id", F.col("frame").cast("long").alias("frame"), F.posexplode("cov").alias("at", "e"))


@query(
    "window_cov",
    f"""WITH {WINDOWS_SQL} SELECT event_id, CAST(frame AS BIGINT) AS frame, CAST(i * 64 - i * (i - 1) // 2 + j - i AS BIGINT) AS at, round(e, 7) + 0.0 AS e FROM cov""",
)
def window_cov(spark, sf):
    c = _entries(spd.window_cov(frame_events(spark, sf), 8, 4))
    return c.select("event_id", "frame", F.col("at").cast("long").alias("at"), (F.round("e", 7) + 0.0).alias("e"))


@query(
    "spd_regularize",
    f"""WITH {WINDOWS_SQL}, t AS (SELECT event_id, frame, sum(e) FILTER (i = j) / 64 AS m FROM cov GROUP BY ALL)
SELECT event_id, CAST(frame AS BIGINT) AS frame, CAST(i * 64 - i * (i - 1) // 2 + j - i AS BIGINT) AS at,
       round(0.9::DOUBLE * e + CASE WHEN i = j THEN 0.1::DOUBLE * m ELSE 0 END, 7) + 0.0 AS e FROM cov JOIN t USING (event_id, frame)""",
)
def spd_regularize(spark, sf):
    c = _entries(spd.spd_regularize(spd.window_cov(frame_events(spark, sf), 8, 4)))
    return c.select("event_id", "frame", F.col("at").cast("long").alias("at"), (F.round("e", 7) + 0.0).alias("e"))


@query(
    "append_deltas",
    """WITH v AS (SELECT vec_id, label, unnest(range(0, 64)) AS k, unnest(embedding) AS x FROM embeddings),
f AS (SELECT vec_id, CAST(label AS BIGINT) AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings),
d AS (SELECT f.label, f.frame, v.k, v.x, v.x - lag(v.x, 1, v.x) OVER (PARTITION BY f.label, v.k ORDER BY f.frame) AS d FROM v JOIN f USING (vec_id))
SELECT label AS phone, frame, CAST(k AS BIGINT) AS at, round(x::DOUBLE, 6) + 0.0 AS v FROM d
UNION ALL SELECT label, frame, CAST(k + 64 AS BIGINT), round(d::DOUBLE, 6) + 0.0 FROM d""",
)
def append_deltas(spark, sf):
    from subvox.plans.ordered import add_position

    f = add_position(px.px_frames(spark, sf).withColumnRenamed("frame", "vec_id"), ["phone"], ["vec_id"], on=F.col("vec_id"), name="frame")
    out = spd.append_deltas(f.select("phone", "frame", F.col("x").alias("sigma")), ["phone"])
    return out.select("phone", "frame", F.posexplode("sigma").alias("at", "v")).select(
        "phone", "frame", F.col("at").cast("long").alias("at"), (F.round(F.col("v").cast("double"), 6) + 0.0).alias("v")
    )


@query("log_euclidean_mean")
def log_euclidean_mean(spark, sf):
    c = spd.spd_regularize(spd.window_cov(frame_events(spark, sf), 8, 4))
    return spd.log_euclidean_mean(c, ["session_id"]).select("session_id", "n_matrices", F.transform("mean_log", lambda v: F.round(v, 5)).alias("mean_log"))


@query("fit_basis")
def fit_basis(spark, sf):
    c = spd.spd_regularize(spd.window_cov(frame_events(spark, sf), 8, 4))
    b = spd.fit_basis(c, ["session_id"], ["session_id", "event_id", "frame"])
    return b.select("session_id", "n_matrices", F.size("q").alias("n_values"), F.round(F.get("q", F.lit(0)), 4).alias("q00"))


@query("project_sigma")
def project_sigma(spark, sf):
    c = spd.spd_regularize(spd.window_cov(frame_events(spark, sf), 8, 4))
    b = spd.fit_basis(c, ["session_id"], ["session_id", "event_id", "frame"])
    out = spd.project_sigma(c, b, ["session_id"], "upper_tri")
    return out.select("event_id", "frame", F.transform("sigma", lambda v: F.round(v.cast("double"), 4)).alias("sigma"))


@query("sigma_sequences")
def sigma_sequences(spark, sf):
    ev = frame_events(spark, sf)
    c = spd.spd_regularize(spd.window_cov(ev, 8, 4))
    b = spd.fit_basis(c, ["session_id"], ["session_id", "event_id", "frame"])
    out = spd.sigma_sequences(ev, b, ["session_id"])
    return out.select("event_id", "frame", F.transform("sigma", lambda v: F.round(v.cast("double"), 3)).alias("sigma"))


def _unit_sql(*parts: str) -> str:
    """A repeatable draw from [0, 1) by copy, event and place."""
    return f"(('0x' || substr(md5(concat_ws(':', '5', copy, '0', event_id, {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(
    "augment_sigma",
    f"""WITH placed AS (SELECT CAST(label AS BIGINT) AS event_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings),
events AS (SELECT event_id, count(*) AS t FROM placed GROUP BY event_id),
copies AS (SELECT event_id, t, unnest([1, 2]) AS copy FROM events),
times AS (SELECT *, unnest(range(1, CASE WHEN t > 4 THEN greatest(1, round_even(t * 0.08::DOUBLE, 0))::BIGINT ELSE 0 END + 1)) AS m FROM copies),
wide AS (SELECT *, 1 + CAST(floor({_unit_sql("'w'", "m")} * greatest(1, t // 8)) AS BIGINT) AS width FROM times),
masks AS (SELECT *, CAST(floor({_unit_sql("'s'", "m")} * greatest(1, t - width)) AS BIGINT) AS start FROM wide),
dropped AS (SELECT DISTINCT event_id, copy, CAST(floor({_unit_sql("'f'", "m")} * 64) AS BIGINT) AS c FROM (SELECT *, unnest([1, 2, 3]) AS m FROM copies)),
cells AS (SELECT event_id, frame, copy, unnest(range(0, 64)) AS c, unnest(embedding)::DOUBLE AS v FROM placed JOIN copies USING (event_id)),
drawn AS (SELECT *, sqrt(-2 * ln(1 - {_unit_sql("frame", "c", "'a'")})) * cos(2 * pi() * {_unit_sql("frame", "c", "'b'")}) AS gauss FROM cells)
SELECT event_id, CAST(frame AS BIGINT) AS frame, CAST(copy AS BIGINT) AS copy, CAST(c AS BIGINT) AS at,
       CASE WHEN EXISTS (SELECT 1 FROM masks k WHERE k.event_id = d.event_id AND k.copy = d.copy AND d.frame >= k.start AND d.frame < k.start + k.width)
              OR EXISTS (SELECT 1 FROM dropped f WHERE f.event_id = d.event_id AND f.copy = d.copy AND f.c = d.c)
            THEN 0.0::DOUBLE ELSE round(CAST(CAST(v + 0.02::DOUBLE * gauss AS FLOAT) AS DOUBLE), 4) + 0.0 END AS v FROM drawn d""",
)
def augment_sigma(spark, sf):
    from subvox.plans.ordered import add_position

    f = px.px_frames(spark, sf).select(F.lit(0).alias("session_id"), F.col("phone").alias("event_id"), "frame", F.col("x").alias("sigma"))
    counted = f.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_rows"))
    placed = add_position(f.withColumnRenamed("frame", "vec_id"), ["event_id"], ["vec_id"], on=F.col("vec_id"), name="frame")
    out = spd.augment_sigma(placed.join(counted, "event_id"), copies=2, seed=5)
    cells = out.select("event_id", "frame", "copy", F.posexplode("sigma").alias("at", "v"))
    return cells.select(*[F.col(c).cast("long").alias(c) for c in ("event_id", "frame", "copy", "at")], (F.round(F.col("v").cast("double"), 4) + 0.0).alias("v"))


@query(
    "phone_error_rate_coded",
    f"""WITH {LETTERS_SQL}, p AS (SELECT a.word AS x, b.word AS y, array_to_string(a.phones, '') AS h, array_to_string(b.phones, '') AS r, count(*) AS n
  FROM lineitem JOIN part pa ON pa.p_partkey = l_partkey JOIN letters a ON a.word = lower(pa.p_type)
  JOIN part pb ON pb.p_partkey = l_suppkey JOIN letters b ON b.word = lower(pb.p_type) GROUP BY ALL)
SELECT CAST(sum(n * levenshtein(h, r)) AS BIGINT) AS distance, CAST(sum(n * length(r)) AS BIGINT) AS ref_length,
       round(sum(n * levenshtein(h, r)) / greatest(sum(n * length(r)), 1)::DOUBLE, 6) AS rate, CAST(sum(n) AS BIGINT) AS n FROM p""",
)
def phone_error_rate_coded(spark, sf):
    part = px.table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("word")).join(letters(spark, sf), "word")
    coded = part.select("p_partkey", lx.phone_code(F.col("phones")).alias("code"))
    li = px.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    pairs = li.join(coded.select(F.col("p_partkey").alias("l_partkey"), F.col("code").alias("hyp")), "l_partkey")
    pairs = pairs.join(coded.select(F.col("p_partkey").alias("l_suppkey"), F.col("code").alias("ref")), "l_suppkey")
    r = m.distance_rate(pairs, "hyp", "ref")
    return r.select("distance", "ref_length", F.round("rate", 6).alias("rate"), "n")


@query("quality_events")
def quality_events(spark, sf):
    from subvox.operators import quality as ql

    ev = frame_events(spark, sf).withColumn("low_hz", F.lit(8.0)).withColumn("high_hz", F.lit(35.0))
    out = ql.quality_events(ev, (0.5, 8.0))
    names = ["snr_db", "band_snr_db", "motion_index", "baseline_wander", "signal_power"]
    return out.select("event_id", "n_frames", *[F.round(c, 4).alias(c) for c in names])


@query(
    "onboard_users",
    f"""WITH n AS (SELECT vec_id // {FRAMES_PER_EVENT} AS event_id, count(*) AS n FROM embeddings GROUP BY ALL),
b AS (SELECT event_id % 3 AS user_id, CAST(sum((n - 8) // 4 + 1) AS BIGINT) AS basis_matrices FROM n WHERE n >= 8 GROUP BY ALL)
SELECT user_id, basis_matrices, round(coalesce(c_acctbal / 20000, 0.7), 6) AS confidence_threshold, CAST(600 AS BIGINT) AS window_ms
FROM b LEFT JOIN customer ON c_custkey = user_id AND c_custkey <> 1""",
)
def onboard_users(spark, sf):
    from subvox.operators.onboarding import onboard

    ev = frame_events(spark, sf).withColumn("user_id", F.col("event_id") % 3)
    known = px.table(spark, sf, "customer").where("c_custkey <> 1").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 20000).alias("confidence_threshold")
    )
    _, rows = onboard(ev, known, 8, 4)
    return rows.select("user_id", "basis_matrices", F.round("confidence_threshold", 6).alias("confidence_threshold"), F.col("window_ms").cast("long").alias("window_ms"))
