"""Queries over splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from subvox.catalog.registry import query
from subvox.operators import splits as sp
from subvox.plans import proxies as px
from subvox.session import cut_lineage

VAL_SQL = "CASE WHEN n <= 1 THEN 0 ELSE least(greatest(1, CAST(round_even(n * CAST('{f}' AS DOUBLE), 0) AS BIGINT)), n - 1) END"


def spans(spark, sf):
    """The spans, written once: a split reads its events several times."""
    return cut_lineage(px.px_spans(spark, sf))


@query(
    "split_stratified",
    f"""WITH {px.PX_SPANS_SQL}, r AS (
  SELECT *, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY md5('1337:' || session_id || ':' || event_id)) AS rn FROM px_spans)
SELECT session_id, event_id, label, CASE WHEN rn <= {VAL_SQL.format(f="0.25")} THEN 'val' ELSE 'train' END AS split FROM r""",
)
def split_stratified(spark, sf):
    s = sp.split_stratified(spans(spark, sf), ["session_id", "event_id"], 0.25, 1337)
    return s.select("session_id", "event_id", "label", "split")


@query(
    "split_grouped",
    f"""WITH {px.PX_TRIALS_SQL},
c AS (SELECT trial_id, label, count(*) AS k FROM px_trials GROUP BY ALL),
d AS (SELECT trial_id, label FROM c QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY k DESC, label) = 1),
r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n,
             row_number() OVER (PARTITION BY label ORDER BY md5('7:' || trial_id)) AS rn FROM d),
g AS (SELECT trial_id, CASE WHEN rn <= {VAL_SQL.format(f="0.2")} THEN 'val' ELSE 'train' END AS split FROM r)
SELECT trial_id, word_idx, label, split FROM px_trials JOIN g USING (trial_id)""",
)
def split_grouped(spark, sf):
    s = sp.split_grouped(cut_lineage(px.px_trials(spark, sf)), ["trial_id"], 0.2, 7)
    return s.select("trial_id", "word_idx", "label", "split")


BLOCKED = f"{px.PX_TRIALS_SQL}, b AS (SELECT trial_id // 500 AS session_id, trial_id % 500 AS trial, word_idx, label FROM px_trials)"


def blocked(spark, sf):
    """Trials numbered inside sessions of 500."""
    t = px.px_trials(spark, sf)
    return t.select(F.floor(F.col("trial_id") / 500).alias("session_id"), (F.col("trial_id") % 500).alias("trial"), "word_idx", "label")


@query(
    "split_official",
    f"""WITH {BLOCKED} SELECT session_id, trial, word_idx,
  CASE WHEN trial < 370 THEN 'train' WHEN trial < 400 THEN 'val' ELSE 'test' END AS split FROM b WHERE trial < 500""",
)
def split_official(spark, sf):
    return sp.split_official(blocked(spark, sf), "trial").select("session_id", "trial", "word_idx", "split")


MERGED = f"{px.PX_TRIALS_SQL}, b AS (SELECT trial_id % 7 AS session_id, trial_id // 7 AS trial, word_idx FROM px_trials)"


@query(
    "split_merged",
    f"""WITH {MERGED}, m AS (SELECT *, max(trial) OVER (PARTITION BY session_id) AS top, session_id = 3 AS marked FROM b),
s AS (SELECT session_id, trial, word_idx,
  CASE WHEN marked OR top >= 500 THEN CASE WHEN trial < 370 OR trial >= 500 THEN 'train' WHEN trial < 400 THEN 'val' ELSE 'test' END
       WHEN trial < 370 THEN 'train' WHEN trial < 400 THEN 'val' WHEN trial < 500 THEN 'test' END AS split FROM m)
SELECT session_id, trial, word_idx, split FROM s WHERE split IS NOT NULL""",
)
def split_merged(spark, sf):
    t = px.px_trials(spark, sf).select(
        (F.col("trial_id") % 7).alias("session_id"), F.floor(F.col("trial_id") / 7).alias("trial"), "word_idx"
    )
    t = t.withColumn("split_mode", F.when(F.col("session_id") == 3, "sim_transfer_merged").otherwise(""))
    return sp.split_merged(t, ["session_id"], "trial").select("session_id", "trial", "word_idx", "split")


@query(
    "resolve_split",
    f"""WITH {px.PX_SPANS_SQL}, r AS (
  SELECT *, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY md5('5:' || session_id || ':' || event_id)) AS rn FROM px_spans)
SELECT label, CASE WHEN rn <= {VAL_SQL.format(f="0.1")} THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM r GROUP BY ALL""",
)
def resolve_split(spark, sf):
    s = sp.resolve_split(spans(spark, sf), "auto", key=["session_id", "event_id"], fraction=0.1, seed=5)
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_trials",
    f"""WITH {BLOCKED}, t AS (SELECT DISTINCT session_id, trial FROM b WHERE trial < 370),
r AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n,
             row_number() OVER (PARTITION BY session_id ORDER BY md5('11:' || session_id || ':' || trial)) AS rn FROM t),
k AS (SELECT session_id, trial FROM r WHERE rn <= greatest(1, CAST(round_even(n * CAST('0.3' AS DOUBLE), 0) AS BIGINT)))
SELECT session_id, trial, word_idx, label FROM b JOIN k USING (session_id, trial)""",
)
def sample_trials(spark, sf):
    return sp.sample_trials(blocked(spark, sf), 0.3, 11, ["session_id"], "trial")


@query(
    "sample_events",
    f"""WITH {px.PX_SPANS_SQL}
SELECT session_id, event_id, label FROM px_spans
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY md5('3:' || session_id || ':' || event_id)) <= 20""",
)
def sample_events(spark, sf):
    return sp.sample_events(spans(spark, sf), 20, 3, ["session_id", "event_id"]).select("session_id", "event_id", "label")
