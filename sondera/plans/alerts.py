"""Queries of onset rules, calibrated alerts, jittered onsets and composite recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.operators import guardrail, retrieval, windows
from sondera.plans.corpus import _DOC_BITS
from sondera.plans.graphs import _CAND, candidates
from sondera.plans.kernels import kernel_sql
from sondera.plans.registry import query
from sondera.plans.signals import _ORD, _Q, METRICS, SIG, r6, signals
from sondera.session import store, table

MOVES = guardrail.offsets(40, 7_200_000)
LOOKBACK = 14_400_000


@query(
    SIG
    + f""", r AS (SELECT id, coherence >= 0.6 AND entropy <= 0.5 AND stability >= 0.2 AS guard, coalesce(coherence >= lag(coherence) OVER w + 0.0005, false) AS ramp, coalesce(entropy <= lag(entropy) OVER w - 0.0005, false) AS drop FROM sig WINDOW w AS ({_ORD}))
  SELECT guard, ramp, drop, count(*) AS n, round(any_value(guard::INT * 0.6 + ramp::INT * 0.2 + drop::INT * 0.2), 6) AS confidence FROM r GROUP BY ALL"""
)
def onset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by the rules that hold and their confidence."""
    r = guardrail.rule_scores(signals(spark, sf_dir), "instrument", ["window_start", "id"], min_coh=0.6, max_ent=0.5, min_stab=0.2)
    return r.groupBy("guard", "ramp", "drop").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("confidence"), 6).alias("confidence"))


@query(
    SIG
    + f""", s AS (SELECT instrument, row_number() OVER ({_ORD}) - 1 AS step, count(*) OVER (PARTITION BY instrument) AS n, lambda_hazard, rupture, entropy FROM sig),
  t AS (SELECT instrument, least(0.95, coalesce(max(lambda_hazard) FILTER (WHERE step <= n // 10), 0) + 0.0015) AS th, coalesce(avg(lambda_hazard) FILTER (WHERE step <= n // 10), 0) AS mh, coalesce(max(entropy) FILTER (WHERE step <= n // 10), 0) + 0.01 AS te, coalesce(avg(entropy) FILTER (WHERE step <= n // 10), 0) AS me FROM s GROUP BY instrument),
  a AS (SELECT s.instrument, any_value(th) AS th, any_value(mh) AS mh, any_value(te) AS te, any_value(me) AS me, count_if(lambda_hazard >= th OR entropy >= te) AS n_alerts, min(step) FILTER (WHERE lambda_hazard >= th OR entropy >= te) AS first_alert, min(step) FILTER (WHERE rupture >= 0.98) AS first_failure FROM s JOIN t USING (instrument) GROUP BY s.instrument)
  SELECT instrument, round(th, 6) AS threshold_lambda_hazard, round(mh, 6) AS mean_lambda_hazard, round(te, 6) AS threshold_entropy, round(me, 6) AS mean_entropy, n_alerts, first_alert, first_failure, CASE WHEN first_alert IS NOT NULL AND first_failure IS NOT NULL THEN greatest(0, first_failure - first_alert) END AS lead FROM a"""
)
def calibrated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts above what the first tenth of each instrument's windows reached, and their lead."""
    w = Window.partitionBy("instrument").orderBy("window_start", "id")
    s = signals(spark, sf_dir).withColumn("step", F.row_number().over(w).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("instrument")))
    m = {"lambda_hazard": guardrail.PADDING["lambda_hazard"], "entropy": (0.01, None)}
    a = guardrail.calibrated_alerts(s, "instrument", "step", F.expr("n div 10"), F.col("rupture") >= 0.98, m)
    return a.select("instrument", *r6(*(f"{k}_{c}" for c in m for k in ("threshold", "mean"))), "n_alerts", "first_alert", "first_failure", "lead")


@query(
    SIG
    + f""", o AS (SELECT instrument, max(window_start) AS onset FROM sig GROUP BY instrument), m AS (SELECT 0 AS i, 0::BIGINT AS m UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, {v})" for i, v in enumerate(MOVES, 1))})),
  d AS (SELECT o.instrument, m.i, avg((coherence >= 0.6)::INT) AS d FROM o JOIN sig USING (instrument), m WHERE window_start >= onset + m.m - {LOOKBACK} AND window_start < onset + m.m GROUP BY ALL),
  f AS (SELECT o.instrument, m.i, coalesce(d.d, 0) AS d FROM o CROSS JOIN m LEFT JOIN d ON d.instrument = o.instrument AND d.i = m.i), b AS (SELECT instrument, d AS observed FROM f WHERE i = 0)
  SELECT b.instrument AS entity, round(any_value(observed), 6) AS observed, round((count_if(f.d >= observed) + 1) / {len(MOVES) + 1}.0, 6) AS p FROM b JOIN f ON f.instrument = b.instrument AND f.i > 0 GROUP BY b.instrument"""
)
def jitter_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherent share before each instrument's last window, against onsets moved by up to two hours."""
    s = signals(spark, sf_dir)
    o = s.groupBy("instrument").agg(F.max("window_start").alias("onset"))
    rows = s.join(o, "instrument").withColumn("flag", F.col("coherence") >= 0.6)
    return guardrail.jitter_p(rows, "instrument", "window_start", "onset", "flag", lookback=LOOKBACK, moves=MOVES).select("entity", *r6("observed", "p"))


@query(
    SIG
    + f""", o AS (SELECT instrument, max(window_start) AS onset FROM sig GROUP BY instrument),
  r AS (SELECT o.instrument, floor((o.onset - s.window_start - 1) / 3600000)::INT AS bin, avg((s.coherence >= 0.6)::INT) AS d FROM sig s JOIN o USING (instrument) WHERE s.window_start < o.onset AND s.window_start >= o.onset - 3600000 * 12 GROUP BY ALL),
  l AS (SELECT *, lag(d) OVER (PARTITION BY instrument ORDER BY bin DESC) AS p FROM r) SELECT instrument AS entity, count(*) AS n_bins, bool_and(p IS NULL OR d >= p) AS monotonic FROM l GROUP BY instrument"""
)
def lead_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the coherent share never falls from hour to hour before an instrument's last window."""
    s = signals(spark, sf_dir)
    o = s.groupBy("instrument").agg(F.max("window_start").alias("onset"))
    rows = s.join(o, "instrument").select(F.col("instrument").alias("entity"), "onset", "window_start", (F.col("coherence") >= 0.6).alias("flag"))
    d = guardrail.density_bins(rows, F.col("onset"), "window_start", 3_600_000, 12)
    rises = F.coalesce(F.col("density") >= F.lag("density").over(Window.partitionBy("entity").orderBy(F.desc("bin"))), F.lit(True))
    return d.withColumn("rises", rises).groupBy("entity").agg(F.count(F.lit(1)).alias("n_bins"), F.bool_and("rises").alias("monotonic"))


_TRIGGER = "theme store"
_DIST = " + ".join(f"(s.{m} - c.{m}) * (s.{m} - c.{m})" for m in METRICS)


@query(
    _Q
    + ", "
    + _CAND.strip().removeprefix("WITH ")
    + f""", seeds AS (SELECT DISTINCT w AS id FROM (SELECT unnest(window_ids) AS w FROM cand WHERE string = '{_TRIGGER}') SEMI JOIN sig ON sig.id = w),
  o AS (SELECT id, id AS k0, lead(id) OVER w AS k1, lead(id, 2) OVER w AS k2 FROM sig WHERE signature IS NOT NULL WINDOW w AS ({_ORD})),
  asked AS (SELECT DISTINCT key FROM (SELECT unnest([k0, k1, k2]) AS key FROM o SEMI JOIN seeds ON seeds.id = o.id) WHERE key IS NOT NULL), own AS (SELECT DISTINCT qgram FROM grams SEMI JOIN asked USING (key)),
  sh AS (SELECT key AS id FROM grams JOIN own USING (qgram) GROUP BY key ORDER BY count(*) DESC, key LIMIT 200),
  c AS (SELECT {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM sig SEMI JOIN seeds USING (id)), ne AS (SELECT s.id FROM sig s, c WHERE sqrt({_DIST}) <= 0.2 ORDER BY sqrt({_DIST}), s.id LIMIT 200),
  f AS (SELECT id FROM seeds UNION SELECT id FROM sh UNION SELECT id FROM ne), r AS (SELECT id, coherence, entropy, CASE WHEN coherence >= 0.6 AND entropy <= 0.4 AND stability >= 0.2 THEN 'foreground' ELSE 'deferred' END AS route FROM sig SEMI JOIN f USING (id)),
  k AS (SELECT route, row_number() OVER (PARTITION BY route ORDER BY coherence DESC, entropy, id) AS rank, id FROM r) SELECT route, rank, id FROM k WHERE rank <= CASE WHEN route = 'foreground' THEN 100 ELSE 300 END"""
)
def seen_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows recalled by a string: its own, those that share q-grams and the nearest to the centroid, routed."""
    s = store(signals(spark, sf_dir))
    seeds = candidates(spark, sf_dir).where(F.col("string") == _TRIGGER).select(F.explode("window_ids").alias("id")).distinct()
    return retrieval.seen(s, store(s.select("id").join(seeds, "id", "left_semi")), entity="instrument", order=["window_start", "id"], dims=METRICS, min_coh=0.6, max_ent=0.4, min_stab=0.2)


@query(
    _DOC_BITS.replace("kb AS (SELECT doc_id AS key", "raw AS (SELECT doc_id")
    + """, nb AS (SELECT doc_id, count(*) AS n FROM raw GROUP BY doc_id), st AS (SELECT doc_id, unnest(range(0, (n - 64) // 64 + 1)) AS w FROM nb WHERE n >= 64),
  kb AS (SELECT st.doc_id::VARCHAR || '#' || st.w AS key, raw.i - 64 * st.w AS i, raw.b FROM st JOIN raw ON raw.doc_id = st.doc_id AND raw.i // 64 = st.w)"""
    + ", "
    + kernel_sql()
    + " SELECT split_part(key, '#', 1)::BIGINT AS doc_id, count(*) AS n_windows, round(avg(coherence), 6) AS coherence, round(avg(1 - rupture), 6) AS stability, round(avg(entropy), 6) AS entropy, round(max(lambda_hazard), 6) AS max_hazard FROM kern GROUP BY 1"
)
def bit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 bits, step 64, of every document under the full kernel, by document."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    w = windows.bit_windows(docs, "doc_id", "data", bits=64, step=64, kernel="full")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"), *(F.round(F.avg(c), 6).alias(c) for c in ("coherence", "stability", "entropy")), F.round(F.max("lambda_hazard"), 6).alias("max_hazard"))
