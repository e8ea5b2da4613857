"""Queries over error rates, intervals and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from subvox.catalog.registry import query
from subvox.operators import metrics as m
from subvox.plans import proxies as px

P = px.PX_PRED_SQL
CELLS_SQL = f"""{P},
names AS (SELECT DISTINCT p_brand AS label FROM part UNION SELECT 'Brand#none'),
per AS (SELECT label, count(*) FILTER (ref = label) AS n_ref, count(*) FILTER (hyp = label) AS n_hyp,
               count(*) FILTER (ref = label AND hyp = label) AS n_ok
        FROM names LEFT JOIN px_pred ON ref = label OR hyp = label GROUP BY label),
scored AS (SELECT *, CASE WHEN n_ref > 0 THEN n_ok / n_ref::DOUBLE ELSE 0 END AS recall,
                  CASE WHEN n_ref + n_hyp > 0 THEN 2 * n_ok / (n_ref + n_hyp)::DOUBLE ELSE 0 END AS f1 FROM per)"""


def _labels(spark, sf):
    brands = px.table(spark, sf, "part").select(F.col("p_brand").alias("label")).distinct()
    return brands.unionByName(spark.createDataFrame([("Brand#none",)], "label string"))


@query(
    "classification_metrics",
    f"WITH {CELLS_SQL} SELECT label, n_ref, n_hyp, n_ok, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scored",
)
def classification_metrics(spark, sf):
    c = m.classification_metrics(px.px_pred(spark, sf), _labels(spark, sf))
    return c.select("label", "n_ref", "n_hyp", "n_ok", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query(
    "split_summary",
    f"""WITH {CELLS_SQL} SELECT round(sum(n_ok) / sum(n_ref)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  CAST(sum(n_ref) AS BIGINT) AS n FROM scored""",
)
def split_summary(spark, sf):
    s = m.split_summary(m.classification_metrics(px.px_pred(spark, sf), _labels(spark, sf)))
    return s.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "n")


@query(
    "train_val_gap",
    f"""WITH {P}, a AS (
  SELECT avg(CASE WHEN ref = hyp THEN 1.0 ELSE 0.0 END) FILTER (trial_id % 500 < 370) AS tr,
         avg(CASE WHEN ref = hyp THEN 1.0 ELSE 0.0 END) FILTER (trial_id % 500 >= 370 AND trial_id % 500 < 400) AS va FROM px_pred)
SELECT round(tr, 6) AS train_accuracy, round(va, 6) AS val_accuracy, round(tr - va, 6) AS gap FROM a""",
)
def train_val_gap(spark, sf):
    p = px.px_pred(spark, sf)
    t, hit = F.col("trial_id") % 500, (F.col("ref") == F.col("hyp")).cast("double")
    a = p.agg(F.avg(F.when(t < 370, hit)).alias("tr"), F.avg(F.when((t >= 370) & (t < 400), hit)).alias("va"))
    return a.select(
        F.round("tr", 6).alias("train_accuracy"), F.round("va", 6).alias("val_accuracy"), F.round(F.col("tr") - F.col("va"), 6).alias("gap")
    )


@query(
    "phone_error_rate",
    f"""WITH {P} SELECT CAST(sum(levenshtein(hyp, ref)) AS BIGINT) AS distance, CAST(sum(length(ref)) AS BIGINT) AS ref_length,
  round(sum(levenshtein(hyp, ref)) / sum(length(ref))::DOUBLE, 6) AS rate, count(*) AS n FROM px_pred""",
)
def phone_error_rate(spark, sf):
    r = m.distance_rate(px.px_pred(spark, sf), "hyp", "ref")
    return r.select("distance", "ref_length", F.round("rate", 6).alias("rate"), "n")


@query(
    "word_error_rate",
    f"""WITH {P}, s AS (
  SELECT trial_id, string_agg(chr(64 + CAST(substr(ref, 7) AS INTEGER)), '' ORDER BY word_idx) AS r,
         string_agg(chr(64 + CAST(substr(hyp, 7) AS INTEGER)), '' ORDER BY word_idx) AS h FROM px_pred GROUP BY trial_id)
SELECT CAST(sum(levenshtein(h, r)) AS BIGINT) AS distance, CAST(sum(length(r)) AS BIGINT) AS n_words,
       round(sum(levenshtein(h, r)) / sum(length(r))::DOUBLE, 6) AS wer FROM s""",
)
def word_error_rate(spark, sf):
    return m.word_error_rate(px.px_pred(spark, sf)).select("distance", "n_words", F.round("wer", 6).alias("wer"))


@query("word_accuracy", f"WITH {P} SELECT round(avg(CASE WHEN ref = hyp THEN 1.0 ELSE 0.0 END), 6) AS word_acc, count(*) AS n FROM px_pred")
def word_accuracy(spark, sf):
    hit = (F.col("ref") == F.col("hyp")).cast("double")
    return px.px_pred(spark, sf).agg(F.round(F.avg(hit), 6).alias("word_acc"), F.count(F.lit(1)).alias("n"))


# Date words from the brand number, so that every category occurs.
DATES_SQL = """(CASE CAST(substr({c}, 7) AS INTEGER) % 5 WHEN 0 THEN 'monday' WHEN 1 THEN 'march' WHEN 2 THEN 'nineteen_eighty'
  WHEN 3 THEN 'nineteen_eighty_two' ELSE 'two_thousand_' || substr({c}, 7) END)"""


def _date(c):
    n = F.substring(c, 7, 2)
    k = n.cast("int") % 5
    return (
        F.when(k == 0, "monday").when(k == 1, "march").when(k == 2, "nineteen_eighty").when(k == 3, "nineteen_eighty_two")
        .otherwise(F.concat(F.lit("two_thousand_"), n))
    )


@query(
    "error_taxonomy",
    f"""WITH {P}, d AS (SELECT word_idx AS slot, {DATES_SQL.format(c='ref')} AS r, {DATES_SQL.format(c='hyp')} AS h FROM px_pred),
k AS (SELECT slot, CASE WHEN r = h THEN 'correct' WHEN slot = 0 AND r = 'monday' THEN 'weekday' WHEN slot = 1 AND r = 'march' THEN 'month'
  WHEN slot = 2 THEN 'ordinal'
  WHEN slot = 3 OR starts_with(r, 'nineteen_') OR starts_with(r, 'two_thousand_') OR contains(r, 'thousand') THEN
    CASE WHEN h <> '' AND starts_with(r, h) THEN 'year_truncation' WHEN h <> '' AND starts_with(h, r) THEN 'year_overgen'
         WHEN h <> '' AND split_part(r, '_', 1) = split_part(h, '_', 1) THEN 'year_same_era' ELSE 'year_other' END
  ELSE 'other' END AS category FROM d)
SELECT slot, category, count(*) AS n FROM k GROUP BY ALL""",
)
def error_taxonomy(spark, sf):
    p = px.px_pred(spark, sf)
    return m.error_taxonomy(p.select("word_idx", _date("ref").alias("ref"), _date("hyp").alias("hyp")))


@query(
    "top_confusions",
    f"WITH {P} SELECT ref, hyp, count(*) AS n FROM px_pred WHERE ref <> hyp GROUP BY ALL ORDER BY n DESC, ref, hyp LIMIT 20",
)
def top_confusions(spark, sf):
    return m.top_confusions(px.px_pred(spark, sf), 20)


def _weights_sql(rows: str, seed: int, replicates: int) -> str:
    """CTE ``w``: the rows of ``rows`` (with their key ``k``) once per replicate, with weight ``w``."""
    u = "('0x' || substr(x, 1 + 4 * j, 4))::BIGINT"
    weight = " + ".join(f"(u >= {c})::BIGINT" for c in m.poisson_cuts())
    return f"""x AS (SELECT {rows}.*, b, sha256('{seed}:' || k || ':' || b) AS x FROM {rows}, range(0, {-(-replicates // m.DRAWS)}) t(b)),
u AS (SELECT * EXCLUDE (x), {u} AS u, b * {m.DRAWS} + j + 1 AS rep FROM x, range(0, {m.DRAWS}) t(j) WHERE b * {m.DRAWS} + j < {replicates}),
w AS (SELECT * EXCLUDE (u), {weight} AS w FROM u)"""


INTERVAL_SQL = """round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci95_low, round(quantile_cont(m, 0.975), 6) AS ci95_high, count(*) AS n_bootstrap"""


@query(
    "bootstrap_accuracy",
    f"""WITH {P}, h AS (SELECT (ref = hyp)::BIGINT AS s, trial_id || ':' || word_idx AS k FROM px_pred), {_weights_sql('h', 0, 200)},
mm AS (SELECT sum(s * w)::DOUBLE / sum(w)::DOUBLE AS m FROM w GROUP BY rep)
SELECT {INTERVAL_SQL} FROM mm""",
)
def bootstrap_accuracy(spark, sf):
    p = px.px_pred(spark, sf).withColumn("hit", (F.col("ref") == F.col("hyp")).cast("double"))
    b = m.bootstrap_ci(p, ["trial_id", "word_idx"], "hit", replicates=200, seed=0)
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean", "ci95_low", "ci95_high")], "n_bootstrap")


@query(
    "bootstrap_macro_f1",
    f"""WITH {P}, h AS (SELECT ref, hyp, trial_id || ':' || word_idx AS k FROM px_pred), {_weights_sql('h', 4, 50)},
e AS (SELECT rep, ref AS label, w AS a, CASE WHEN ref = hyp THEN w ELSE 0 END AS t FROM w UNION ALL SELECT rep, hyp, w, 0 FROM w),
g AS (SELECT rep, label, sum(a) AS a, sum(t) AS t FROM e GROUP BY ALL),
names AS (SELECT DISTINCT p_brand AS label FROM part),
mm AS (SELECT rep, sum(CASE WHEN a > 0 THEN 2 * t / a::DOUBLE ELSE 0 END) / (SELECT count(*) FROM names) AS m FROM g
       WHERE label IN (SELECT label FROM names) GROUP BY rep)
SELECT {INTERVAL_SQL} FROM mm""",
)
def bootstrap_macro_f1(spark, sf):
    labels = px.table(spark, sf, "part").select(F.col("p_brand").alias("label")).distinct()
    b = m.bootstrap_macro_f1_ci(px.px_pred(spark, sf), ["trial_id", "word_idx"], labels, replicates=50, seed=4)
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean", "ci95_low", "ci95_high")], "n_bootstrap")


@query(
    "bootstrap_pooled_runs",
    f"""WITH {P}, h AS (SELECT word_idx, trial_id % 5 AS run, (ref = hyp)::BIGINT AS s, trial_id % 5 || ':' || trial_id || ':' || word_idx AS k FROM px_pred),
r AS (SELECT word_idx, count(*) AS n_runs, avg(a) AS run_mean, stddev_pop(a) AS run_std FROM (SELECT word_idx, run, avg(s) AS a FROM h GROUP BY ALL) GROUP BY ALL),
{_weights_sql('h', 2, 40)},
mm AS (SELECT word_idx, sum(s * w)::DOUBLE / nullif(sum(w), 0)::DOUBLE AS m FROM w GROUP BY word_idx, rep HAVING sum(w) > 0)
SELECT word_idx, n_runs, round(run_mean, 6) AS run_mean, round(run_std, 6) AS run_std, {INTERVAL_SQL} FROM mm JOIN r USING (word_idx) GROUP BY ALL""",
)
def bootstrap_pooled_runs(spark, sf):
    p = px.px_pred(spark, sf).withColumn("hit", (F.col("ref") == F.col("hyp")).cast("double")).withColumn("run", F.col("trial_id") % 5)
    b = m.pooled_summary(p, "run", ["trial_id", "word_idx"], "hit", replicates=40, seed=2, groups=["word_idx"])
    return b.select("word_idx", "n_runs", *[F.round(c, 6).alias(c) for c in ("run_mean", "run_std", "mean", "ci95_low", "ci95_high")], "n_bootstrap")


@query(
    "multiseed_summary",
    f"""WITH {P}, r AS (SELECT trial_id % 5 AS run_seed, avg(CASE WHEN ref = hyp THEN 1.0 ELSE 0.0 END) AS acc, avg(conf) AS conf
  FROM px_pred GROUP BY ALL)
SELECT count(*) AS n_seeds, round(avg(acc), 6) AS acc_mean, round(stddev_pop(acc), 6) AS acc_std, round(avg(conf), 6) AS conf_mean,
       round(stddev_pop(conf), 6) AS conf_std FROM r""",
)
def multiseed_summary(spark, sf):
    hit = (F.col("ref") == F.col("hyp")).cast("double")
    runs = px.px_pred(spark, sf).groupBy((F.col("trial_id") % 5).alias("run_seed")).agg(F.avg(hit).alias("acc"), F.avg("conf").alias("conf"))
    s = m.multiseed_summary(runs, ["acc", "conf"])
    return s.select("n_seeds", *[F.round(c, 6).alias(c) for c in ("acc_mean", "acc_std", "conf_mean", "conf_std")])


@query(
    "latency_percentiles",
    """WITH p AS (SELECT event_type AS stage, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms,
  quantile_cont(value, 0.99) AS p99_ms, avg(value) AS mean_ms, count(*) AS n FROM events GROUP BY ALL)
SELECT stage, round(p50_ms, 4) AS p50_ms, round(p95_ms, 4) AS p95_ms, round(p99_ms, 4) AS p99_ms, round(mean_ms, 6) AS mean_ms, n,
       round(sum(p95_ms) OVER (), 3) AS total_p95_ms, sum(p95_ms) OVER () <= 500 AS within_budget FROM p""",
)
def latency_percentiles(spark, sf):
    e = px.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    p = m.latency_percentiles(e)
    rounds = {"p50_ms": 4, "p95_ms": 4, "p99_ms": 4, "mean_ms": 6, "total_p95_ms": 3}
    return p.select("stage", *[F.round(c, d).alias(c) for c, d in rounds.items()], "n", "within_budget")


@query(
    "best_run",
    f"""WITH {P}, r AS (SELECT trial_id % 3 AS study, ref AS run, avg(CASE WHEN ref = hyp THEN 1.0 ELSE 0.0 END) AS acc FROM px_pred GROUP BY ALL)
SELECT study, run, round(acc, 6) AS acc FROM r QUALIFY row_number() OVER (PARTITION BY study ORDER BY acc DESC, run) = 1""",
)
def best_run(spark, sf):
    hit = (F.col("ref") == F.col("hyp")).cast("double")
    runs = px.px_pred(spark, sf).groupBy((F.col("trial_id") % 3).alias("study"), F.col("ref").alias("run")).agg(F.avg(hit).alias("acc"))
    return m.best_run(runs, "acc", "run", ["study"]).withColumn("acc", F.round("acc", 6))
