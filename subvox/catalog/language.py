"""Queries over the trial language model."""

from __future__ import annotations

from pyspark.sql import functions as F

from subvox.catalog.registry import query
from subvox.operators import lm
from subvox.operators.metrics import slot_report
from subvox.plans import proxies as px

LM_SQL = f"""{px.PX_TRIALS_SQL},
cut AS (SELECT CAST(trunc(0.8 * max(trial_id)) AS BIGINT) AS c FROM px_trials),
words AS (SELECT trial_id, word_idx AS slot, label AS word,
                 lag(label, 1) OVER w AS prev, lag(label, 2) OVER w AS prev2, trial_id < (SELECT c FROM cut) AS train
          FROM px_trials WINDOW w AS (PARTITION BY trial_id ORDER BY word_idx)),
sc AS (SELECT slot, word, count(*) AS n FROM words WHERE train GROUP BY ALL),
lm_slot AS (SELECT slot, word, ln((n + 0.1::DOUBLE) / (sum(n) OVER (PARTITION BY slot) + 0.1::DOUBLE * count(*) OVER (PARTITION BY slot))) AS logp,
                   count(*) OVER (PARTITION BY slot) AS v FROM sc),
bc AS (SELECT prev, word, count(*) AS n FROM words WHERE train AND prev IS NOT NULL GROUP BY ALL),
lm_bigram AS (SELECT prev, word, ln((n + 0.1::DOUBLE) / (sum(n) OVER (PARTITION BY prev) + 0.1::DOUBLE * count(*) OVER (PARTITION BY prev))) AS logp FROM bc),
tc AS (SELECT prev2, prev, word, count(*) AS n FROM words WHERE train AND prev2 IS NOT NULL GROUP BY ALL),
lm_trigram AS (SELECT prev2, prev, word, ln((n + 0.1::DOUBLE) / (sum(n) OVER (PARTITION BY prev2, prev)
                      + 0.1::DOUBLE * count(*) OVER (PARTITION BY prev2, prev))) AS logp FROM tc)"""

SCORED_SQL = f"""{LM_SQL},
ctx AS (SELECT DISTINCT slot, prev2, prev FROM words WHERE NOT train),
scored AS (
  SELECT c.slot, c.prev2, c.prev, s.word,
         s.logp + CASE WHEN c.prev IS NULL THEN 0 ELSE coalesce(b.logp, ln(0.1::DOUBLE)) END
                + CASE WHEN c.prev2 IS NULL THEN 0 ELSE coalesce(t.logp, ln(0.1::DOUBLE)) END AS score
  FROM ctx c JOIN lm_slot s ON s.slot = c.slot
  LEFT JOIN lm_bigram b ON b.prev = c.prev AND b.word = s.word
  LEFT JOIN lm_trigram t ON t.prev2 = c.prev2 AND t.prev = c.prev AND t.word = s.word),
best AS (SELECT slot, prev2, prev, word AS hyp FROM scored
         QUALIFY row_number() OVER (PARTITION BY slot, prev2, prev ORDER BY round(score, 6) DESC, word) = 1),
guess AS (SELECT w.trial_id, w.slot, w.word AS ref, b.hyp FROM words w
          LEFT JOIN best b ON b.slot = w.slot AND b.prev2 IS NOT DISTINCT FROM w.prev2 AND b.prev IS NOT DISTINCT FROM w.prev
          WHERE NOT w.train)"""


def fitted(spark, sf):
    """Trials, the first held-out trial number and the model fit on the trials before it."""
    trials = px.px_trials(spark, sf)
    top = px.table(spark, sf, "lineitem").agg(F.max("l_orderkey").alias("t")).first()["t"]
    cut = int(0.8 * top)
    return trials, cut, lm.fit_trial_lm(trials, max_trial=cut, date_slots=False)


def held_out(spark, sf):
    trials, cut, model = fitted(spark, sf)
    out = lm.predict_teacher_forced(trials.where(F.col("trial_id") >= cut).select("trial_id", "word_idx", "label"), model)
    return out.withColumnRenamed("label", "ref")


@query("lm_slot", f"WITH {LM_SQL} SELECT CAST(slot AS BIGINT) AS slot, word, round(logp, 6) AS logp FROM lm_slot")
def lm_slot(spark, sf):
    return fitted(spark, sf)[2].slot.select("slot", "word", F.round("logp", 6).alias("logp"))


@query("lm_bigram", f"WITH {LM_SQL} SELECT prev, word, round(logp, 6) AS logp FROM lm_bigram")
def lm_bigram(spark, sf):
    return fitted(spark, sf)[2].bigram.select("prev", "word", F.round("logp", 6).alias("logp"))


@query("lm_trigram", f"WITH {LM_SQL} SELECT prev2, prev, word, round(logp, 6) AS logp FROM lm_trigram")
def lm_trigram(spark, sf):
    return fitted(spark, sf)[2].trigram.select("prev2", "prev", "word", F.round("logp", 6).alias("logp"))


@query("lm_score", f"WITH {SCORED_SQL} SELECT slot, prev2, prev, word, round(score, 5) AS lm_score FROM scored")
def lm_score(spark, sf):
    trials, cut, model = fitted(spark, sf)
    known = lm.with_history(trials.where(F.col("trial_id") >= cut)).withColumn("slot", F.col("word_idx"))
    contexts = known.select("slot", "prev2", "prev").distinct()
    scored = lm.lm_score(lm.slot_candidates(contexts, model), model)
    return scored.select("slot", "prev2", "prev", "word", F.round("lm_score", 5).alias("lm_score"))


@query("held_out_guesses", f"WITH {SCORED_SQL} SELECT trial_id, slot, ref, hyp FROM guess")
def held_out_guesses(spark, sf):
    return held_out(spark, sf).select("trial_id", "slot", "ref", "hyp")


@query(
    "held_out_slot_report",
    f"""WITH {SCORED_SQL} SELECT slot, count(*) AS n, count(*) FILTER (ref = hyp) AS n_correct,
  count(*) - count(*) FILTER (ref = hyp) AS n_errors,
  round((count(*) - count(*) FILTER (ref = hyp)) / count(*)::DOUBLE, 6) AS error_rate FROM guess GROUP BY slot""",
)
def held_out_slot_report(spark, sf):
    report = slot_report(held_out(spark, sf))
    return report.withColumn("n_correct", F.coalesce("n_correct", F.lit(0))).withColumn("error_rate", F.round("error_rate", 6))


@query(
    "slot_candidates",
    f"""WITH {LM_SQL}, lex AS (SELECT DISTINCT p_brand AS word FROM part),
items AS (SELECT DISTINCT slot FROM (SELECT slot FROM words UNION ALL SELECT slot + 1000 FROM words)),
seen AS (SELECT DISTINCT slot, word FROM words WHERE train)
SELECT i.slot, s.word FROM items i JOIN seen s ON s.slot = i.slot
UNION ALL SELECT i.slot, l.word FROM items i, lex l WHERE i.slot NOT IN (SELECT slot FROM seen)""",
)
def slot_candidates(spark, sf):
    trials, _, model = fitted(spark, sf)
    both = F.explode(F.array(F.col("word_idx"), F.col("word_idx") + 1000)).alias("slot")
    items = trials.select(both).distinct()
    lexicon = px.table(spark, sf, "part").select(F.col("p_brand").alias("word")).distinct()
    return lm.slot_candidates(items, model, lexicon)
