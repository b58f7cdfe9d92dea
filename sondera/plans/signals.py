"""Queries over signals: dilution, q-grams, routes, calibration, alerts and repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.functions import chance, kernel
from sondera.functions.scores import apply_filter, foreground, normalize_signals, stream_route, throttle
from sondera.operators import dilution, guardrail, retrieval
from sondera.plans.registry import query
from sondera.session import latest, store, table

METRICS = ("coherence", "stability", "entropy", "rupture", "lambda_hazard")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an id, metrics flat and defaulted, the signature trimmed and in lower case (blank is null)."""
    s = latest(normalize_signals(table(spark, sf_dir, "signals")), "id", "ingested_at")
    sig = F.lower(F.regexp_replace("signature", r"[ \t\n\x0B\f\r]+", ""))
    return s.withColumn("signature", F.when(sig != "", sig)).drop("ingested_at", "ts")


_N = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
SIG = f"""
WITH sig AS (
  SELECT id, instrument, window_start, window_end, nullif(lower(regexp_replace(signature, '\\s+', '', 'g')), '') AS signature, repetition_count,
    coalesce({_N('metrics.coherence')}, 0) AS coherence, coalesce({_N('metrics.stability')}, 0) AS stability, coalesce({_N('metrics.entropy')}, 1) AS entropy, coalesce({_N('metrics.rupture')}, 0) AS rupture,
    coalesce({_N('lambda_hazard')}, {_N('metrics.lambda_hazard')}, {_N('metrics.rupture')}, 0) AS lambda_hazard
  FROM signals QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1
)"""
_ORD = "PARTITION BY instrument ORDER BY window_start, id"


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(
    SIG
    + f""", nx AS (SELECT signature AS s, lead(signature) OVER ({_ORD}) AS t FROM sig), c AS (SELECT s, t, count(*) AS n FROM nx WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
  a AS (SELECT s AS signature, count(*) AS n_next, sum(n)::BIGINT AS total, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY s)
  SELECT signature, n_next, total, round(CASE WHEN n_next > 1 THEN h / log2(n_next) ELSE 0 END, 6) AS path FROM a"""
)
def path_dilution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dilution.path_dilution(signals(spark, sf_dir), "instrument", ["window_start", "id"], "signature").select("signature", "n_next", "total", *r6("path"))


_PAIRS = """
WITH pr AS (SELECT unnest(window_ids) AS window_id, lower(trim(text)) AS token FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY loaded_at DESC) = 1) WHERE text IS NOT NULL)"""


def window_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, token): candidate strings by the windows that hold them."""
    c = latest(table(spark, sf_dir, "candidates"), "cand_id", "loaded_at").where("text is not null")
    return c.select(F.explode("window_ids").alias("window_id"), F.lower(F.trim("text")).alias("token"))


@query(_PAIRS + " SELECT window_id AS window, count(DISTINCT token) AS n_tokens, CASE WHEN count(DISTINCT token) > 1 THEN 1.0 ELSE 0.0 END AS signal FROM pr WHERE window_id IS NOT NULL GROUP BY window_id")
def signal_dilution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dilution.signal_dilution(window_tokens(spark, sf_dir), "window_id", "token").select("window", "n_tokens", *r6("signal"))


@query(
    _PAIRS
    + """, k AS (SELECT window_id, token, count(*) AS k FROM pr WHERE window_id IS NOT NULL GROUP BY ALL)
  SELECT window_id AS window, count(*) AS n_tokens, round(CASE WHEN count(*) > 1 THEN (log2(sum(k)) - sum(k * log2(k)) / sum(k)) / log2(count(*)) ELSE 0 END, 6) AS signal FROM k GROUP BY window_id"""
)
def signal_dilution_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dilution.signal_dilution(window_tokens(spark, sf_dir), "window_id", "token", weighted=True).select("window", "n_tokens", *r6("signal"))


_SEM = (
    SIG
    + ", "
    + _PAIRS.strip().removeprefix("WITH ")
    + """, sp AS (SELECT s.signature AS s, p.token AS t FROM pr p JOIN sig s ON s.id = p.window_id WHERE s.signature IS NOT NULL),
  j AS (SELECT s, t, count(*) AS n FROM sp GROUP BY ALL), tt AS (SELECT sum(n) AS t FROM j),
  hs AS (SELECT log2(any_value(t)) - sum(n * log2(n)) / any_value(t) AS h FROM (SELECT s, sum(n) AS n FROM j GROUP BY s), tt),
  ht AS (SELECT log2(any_value(tt.t)) - sum(n * log2(n)) / any_value(tt.t) AS h FROM (SELECT t, sum(n) AS n FROM j GROUP BY t) q, tt),
  hj AS (SELECT log2(any_value(tt.t)) - sum(n * log2(n)) / any_value(tt.t) AS h FROM j, tt)
  SELECT tt.t::BIGINT AS n, round(greatest(0, hs.h + ht.h - hj.h), 6) AS mutual_information, round(hs.h, 6) AS h_signature, round(ht.h, 6) AS h_token, round(1 - greatest(0, hs.h + ht.h - hj.h) / least(hs.h, ht.h), 6) AS semantic FROM tt, hs, ht, hj"""
)


@query(_SEM)
def semantic_dilution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select("id", "signature")
    pairs = window_tokens(spark, sf_dir).join(s, F.col("window_id") == s["id"])
    return dilution.semantic_dilution(pairs, "signature", "token").select("n", *r6("mutual_information", "h_signature", "h_token", "semantic"))


@query(
    SIG
    + f""", nx AS (SELECT id, signature AS s, lead(signature) OVER ({_ORD}) AS t FROM sig), c AS (SELECT s, t, count(*) AS n FROM nx WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
  a AS (SELECT s, CASE WHEN count(*) > 1 THEN (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) ELSE 0 END AS p FROM c GROUP BY s),
  w AS (SELECT coalesce(p, 0) AS p FROM sig LEFT JOIN a ON a.s = sig.signature)
  SELECT count(*) AS n, round(avg(p), 6) AS mean_path, round(max(p), 6) AS max_path, round(median(p), 6) AS median_path, round(greatest(0, least(1, 1 - avg(p))), 6) AS clarity FROM w"""
)
def dilution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    d = dilution.path_dilution(s, "instrument", ["window_start", "id"], "signature")
    p = F.coalesce("path", F.lit(0.0))
    w = s.select("signature").join(d.select("signature", "path"), "signature", "left").select(p.alias("p"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_path"), F.round(F.max("p"), 6).alias("max_path"), F.round(F.percentile("p", 0.5), 6).alias("median_path"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.avg("p"))), 6).alias("clarity"))


_Q = (
    SIG
    + f""", g AS (SELECT instrument AS entity, id AS key, list(signature) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS g, lead(id) OVER w IS NULL AS last, row_number() OVER w AS rn
  FROM sig WHERE signature IS NOT NULL WINDOW w AS ({_ORD})), grams AS (SELECT entity, key, array_to_string(g, '|') AS qgram FROM g WHERE len(g) = 3 OR (last AND rn < 3))"""
)


@query(_Q + " SELECT qgram, count(*) AS n, min(key) AS first_key FROM grams GROUP BY qgram")
def signature_qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = retrieval.signature_qgrams(signals(spark, sf_dir).where("signature is not null"), "instrument", ["window_start", "id"], "signature", "id")
    return g.groupBy("qgram").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


@query(_Q + ", seeds AS (SELECT DISTINCT qgram FROM grams WHERE entity = (SELECT min(entity) FROM grams)) SELECT key, count(*) AS hits FROM grams JOIN seeds USING (qgram) GROUP BY key ORDER BY hits DESC, key LIMIT 200")
def qgram_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that share q-grams with the first instrument's."""
    g = store(retrieval.signature_qgrams(signals(spark, sf_dir).where("signature is not null"), "instrument", ["window_start", "id"], "signature", "id"))
    first = g.agg(F.min("entity").alias("entity"))
    return retrieval.qgram_hits(g, g.join(F.broadcast(first), "entity"))


@query(
    SIG
    + """, r AS (SELECT id, coherence, entropy, CASE WHEN coherence >= 0.8 AND entropy <= 0.4 AND stability >= 0.5 THEN 'foreground' ELSE 'deferred' END AS route FROM sig),
  k AS (SELECT route, row_number() OVER (PARTITION BY route ORDER BY coherence DESC, entropy, id) AS rank, id FROM r)
  SELECT route, rank, id FROM k WHERE rank <= CASE WHEN route = 'foreground' THEN 100 ELSE 300 END"""
)
def seen_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.route(signals(spark, sf_dir), min_coh=0.8, max_ent=0.4, min_stab=0.5)


@query(SIG + ", p AS (SELECT quantile_cont(entropy, 0.35) AS q FROM sig) SELECT id, signature, coherence, entropy FROM sig, p WHERE coherence >= 0.8 AND entropy <= p.q")
def metric_filter_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that satisfy "coh>=0.8,ent<=P35"."""
    return apply_filter(signals(spark, sf_dir), "coh>=0.8,ent<=P35").select("id", "signature", "coherence", "entropy")


@query(
    SIG
    + """ SELECT metric, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM (
  SELECT 'coherence' AS metric, coherence AS v FROM sig UNION ALL SELECT 'stability', stability FROM sig UNION ALL SELECT 'entropy', entropy FROM sig UNION ALL SELECT 'rupture', rupture FROM sig UNION ALL SELECT 'lambda_hazard', lambda_hazard FROM sig) GROUP BY metric"""
)
def router_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated percentiles of each metric."""
    s = signals(spark, sf_dir)
    qs = F.array(*(F.lit(x) for x in (0.05, 0.5, 0.95)))
    row = s.agg(*(F.percentile(m, qs).alias(m) for m in METRICS))
    long = row.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("p")) for m in METRICS))))
    return long.select("metric", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))))


_GRID = """, g AS (SELECT (row_number() OVER (ORDER BY c, e, s) - 1)::INT AS config, c AS min_coh, e AS max_ent, s AS min_stab FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS c), (SELECT unnest([0.2, 0.4, 0.6]::DOUBLE[]) AS e), (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS s)),
  cov AS (SELECT config, min_coh, max_ent, min_stab, count(*) AS n, sum(CASE WHEN coherence >= min_coh AND entropy <= max_ent AND stability >= min_stab THEN 1 ELSE 0 END)::BIGINT AS covered FROM sig, g GROUP BY ALL)"""


def _grid(spark: SparkSession) -> DataFrame:
    return guardrail.threshold_grid(spark, [0.5, 0.6, 0.7, 0.8], [0.2, 0.4, 0.6], [0.3, 0.5, 0.7])


@query(SIG + _GRID + " SELECT config, min_coh, max_ent, min_stab, n, covered FROM cov")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guardrail.coverage_grid(signals(spark, sf_dir), _grid(spark))


@query(
    SIG
    + _GRID
    + """, k AS (SELECT *, covered / n AS coverage, covered / n BETWEEN 0.05 AND 0.15 AS inside FROM cov)
  SELECT config, min_coh, max_ent, min_stab, round(coverage, 6) AS coverage, inside FROM k ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE least(abs(coverage - 0.05), abs(coverage - 0.15)) END, coverage, config LIMIT 1"""
)
def router_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = guardrail.choose_thresholds(guardrail.coverage_grid(signals(spark, sf_dir), _grid(spark)), 0.05, 0.15)
    return chosen.select("config", "min_coh", "max_ent", "min_stab", *r6("coverage"), "inside")


@query(
    SIG
    + """ SELECT instrument, count(*) AS n, sum(CASE WHEN coherence >= 0.7 AND entropy <= 0.4 AND stability >= 0.4 THEN 1 ELSE 0 END)::BIGINT AS covered, round(avg(CASE WHEN coherence >= 0.7 AND entropy <= 0.4 AND stability >= 0.4 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM sig GROUP BY instrument"""
)
def foreground_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = foreground(0.7, 0.4, 0.4)
    return signals(spark, sf_dir).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("covered"), F.round(F.avg(ok.cast("double")), 6).alias("coverage"))


@query(SIG + f" SELECT id, count(*) OVER w AS repetitions, min(window_start) OVER w AS first_seen FROM sig WHERE signature IS NOT NULL WINDOW w AS (PARTITION BY instrument, signature ORDER BY window_start RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW)")
def repetition_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each signature came within six hours, and since when."""
    w = Window.partitionBy("instrument", "signature").orderBy("window_start").rangeBetween(-21_600_000, 0)
    return signals(spark, sf_dir).where("signature is not null").select("id", F.count(F.lit(1)).over(w).alias("repetitions"), F.min("window_start").over(w).alias("first_seen"))


@query(SIG + " SELECT signature, count(*) AS n, round(avg(coherence), 6) AS coherence, round(avg(lambda_hazard), 6) AS lambda_hazard FROM sig WHERE signature IS NOT NULL GROUP BY signature ORDER BY n DESC, signature LIMIT 8")
def signature_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = signals(spark, sf_dir).where("signature is not null").groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coherence"), 6).alias("coherence"), F.round(F.avg("lambda_hazard"), 6).alias("lambda_hazard"))
    return g.orderBy(F.desc("n"), "signature").limit(8)


@query(
    SIG
    + """, m AS (SELECT median(lambda_hazard) AS h, median(coherence) AS c FROM sig)
  SELECT lambda_hazard > h AS high_hazard, coherence > c AS high_coherence, count(*) AS n FROM sig, m GROUP BY ALL"""
)
def contingency_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    m = s.agg(F.percentile("lambda_hazard", 0.5).alias("h"), F.percentile("coherence", 0.5).alias("c"))
    return s.join(F.broadcast(m)).groupBy((F.col("lambda_hazard") > F.col("h")).alias("high_hazard"), (F.col("coherence") > F.col("c")).alias("high_coherence")).agg(F.count(F.lit(1)).alias("n"))


@query(
    SIG
    + """, k AS (SELECT coherence AS a, lambda_hazard AS b, rank() OVER (ORDER BY coherence) + (count(*) OVER (PARTITION BY coherence) - 1) / 2.0 AS ra, rank() OVER (ORDER BY lambda_hazard) + (count(*) OVER (PARTITION BY lambda_hazard) - 1) / 2.0 AS rb FROM sig)
  SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(covar_samp(a, b), 6) AS covariance, round(corr(ra, rb), 6) AS spearman FROM k"""
)
def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of coherence and hazard; ranks come from counts of distinct values, not from a sort of all rows."""
    s = store(signals(spark, sf_dir).select("id", F.col("coherence").alias("a"), F.col("lambda_hazard").alias("b")))
    from sondera.operators.prefix import running_total

    def ranks(c: str) -> DataFrame:
        placed = running_total(s.groupBy(c).agg(F.count(F.lit(1)).alias("k")), [c], "k", "before")
        return placed.select(c, (F.col("before") + (F.col("k") + 1) / 2).alias(f"r{c}"))

    k = s.join(ranks("a"), "a").join(ranks("b"), "b")
    return k.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("a", "b"), 6).alias("pearson"), F.round(F.covar_samp("a", "b"), 6).alias("covariance"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


@query(
    SIG
    + """, b AS (SELECT unnest(range(1, 21)) AS bin), c AS (SELECT greatest(1, least(20, ceil(lambda_hazard * 20)))::BIGINT AS bin, count(*) AS n, sum(CASE WHEN coherence >= 0.5 THEN 1 ELSE 0 END) AS k FROM sig WHERE lambda_hazard BETWEEN 0 AND 1 GROUP BY 1)
  SELECT b.bin, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN round(k / n, 6) END AS admitted FROM b LEFT JOIN c USING (bin)"""
)
def hazard_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and admission rate in 20 hazard bins, right-closed, empty ones kept."""
    bins = spark.range(1, 21).withColumnRenamed("id", "bin")
    b = F.greatest(F.lit(1), F.least(F.lit(20), F.ceil(F.col("lambda_hazard") * 20))).cast("long")
    c = signals(spark, sf_dir).where("lambda_hazard between 0 and 1").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("coherence") >= 0.5).cast("double")), 6).alias("admitted"))
    return bins.join(F.broadcast(c), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "admitted")


@query(
    SIG
    + f""", f AS (SELECT instrument, window_start, id, coherence >= 0.6 AND entropy <= 0.5 AS ok FROM sig), g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER ({_ORD} ROWS UNBOUNDED PRECEDING) AS grp, lag(id, 2) OVER ({_ORD}) AS first FROM f),
  p AS (SELECT *, row_number() OVER (PARTITION BY instrument, grp ORDER BY window_start, id) AS pos FROM g WHERE ok) SELECT instrument AS entity, first AS onset, id AS emitted FROM p WHERE pos % 3 = 0"""
)
def onset_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows of high coherence and low entropy on end."""
    rule = (F.col("coherence") >= 0.6) & (F.col("entropy") <= 0.5)
    return guardrail.onsets(signals(spark, sf_dir), "instrument", ["window_start", "id"], "id", rule, 3)


@query(
    SIG
    + f""", s AS (SELECT instrument, row_number() OVER ({_ORD}) - 1 AS step, lambda_hazard, rupture FROM sig), a AS (SELECT instrument AS entity, count(*) AS n, sum(CASE WHEN lambda_hazard >= 0.9 THEN 1 ELSE 0 END)::BIGINT AS n_alerts, min(CASE WHEN lambda_hazard >= 0.9 THEN step END) AS first_alert, min(CASE WHEN rupture >= 0.95 THEN step END) AS failure FROM s GROUP BY instrument)
  SELECT entity, n, n_alerts, first_alert, failure, CASE WHEN first_alert <= failure THEN failure - first_alert END AS lead FROM a"""
)
def first_alert_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("instrument").orderBy("window_start", "id")
    s = signals(spark, sf_dir).withColumn("step", F.row_number().over(w).cast("long") - 1)
    return guardrail.alert_leads(s, "instrument", "step", F.col("lambda_hazard") >= 0.9, F.col("rupture") >= 0.95)


_AL = SIG + """, al AS (SELECT DISTINCT instrument AS entity, window_start AS t FROM sig WHERE lambda_hazard >= 0.95), fa AS (SELECT DISTINCT instrument AS entity, window_start AS t FROM sig WHERE rupture >= 0.97)"""


@query(
    _AL
    + """ SELECT f.entity, f.t AS failure, coalesce(max(a.t) FILTER (WHERE a.t <= f.t), min(a.t) FILTER (WHERE a.t > f.t)) AS alert, f.t - coalesce(max(a.t) FILTER (WHERE a.t <= f.t), min(a.t) FILTER (WHERE a.t > f.t)) AS lead
  FROM fa f LEFT JOIN al a USING (entity) GROUP BY f.entity, f.t"""
)
def lead_time_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    return guardrail.lead_times(s.where("lambda_hazard >= 0.95"), s.where("rupture >= 0.97"), "instrument", "window_start")


@query()
def greedy_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    return guardrail.greedy_alignment(s.where("lambda_hazard >= 0.95"), s.where("rupture >= 0.97"), "instrument", "window_start", 3_600_000)


@query(
    SIG
    + f""", k AS (SELECT instrument, id, greatest(rupture, lambda_hazard) AS score, row_number() OVER (PARTITION BY instrument ORDER BY greatest(rupture, lambda_hazard) DESC, id) AS rank, count(*) OVER (PARTITION BY instrument) AS n FROM sig)
  SELECT instrument, rank, id, round(score, 6) AS score FROM k WHERE rank <= greatest(1, ceil(n * 0.05))"""
)
def alert_fraction_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 % of each instrument's windows with the highest rupture or hazard, one at least."""
    s = signals(spark, sf_dir)
    sizes = s.groupBy("instrument").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * 0.05)).alias("top"))
    score = F.greatest("rupture", "lambda_hazard")
    rank = F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("score"), "id"))
    return s.withColumn("score", score).withColumn("rank", rank).join(sizes, "instrument").where("rank <= top").select("instrument", "rank", "id", *r6("score"))


def _comb_sql() -> str:
    return (
        SIG
        + f""", s AS (SELECT instrument, row_number() OVER ({_ORD}) - 1 AS i, lambda_hazard FROM sig),
  a AS (SELECT instrument, count(*) AS n, sum(CASE WHEN lambda_hazard >= 0.9 THEN 1 ELSE 0 END)::BIGINT AS k FROM s GROUP BY instrument),
  l AS (SELECT *, greatest(1, n // 20) AS m FROM a), t AS (SELECT l.*, (SELECT sum(ln((n - m - j) / (n - j))) FROM (SELECT unnest(range(0, k)) AS j)) AS lm FROM l WHERE k > 0 AND k <= n - m)
  SELECT l.instrument, l.n, l.k, l.m, round(CASE WHEN l.k <= 0 THEN 0 WHEN l.k > l.n - l.m THEN 1 ELSE 1 - exp(t.lm) END, 6) AS p FROM l LEFT JOIN t ON t.instrument = l.instrument"""
    )


@query(_comb_sql())
def permutation_p_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that as many random windows as there are alerts reach the last twentieth of an instrument's windows."""
    a = signals(spark, sf_dir).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lambda_hazard") >= 0.9).alias("k"))
    a = a.withColumn("m", F.greatest(F.lit(1), F.expr("n div 20")))
    return a.select("instrument", "n", "k", "m", F.round(chance.permutation_p(F.col("n"), F.col("k"), F.col("m")), 6).alias("p"))


@query(
    SIG
    + """, c AS (SELECT instrument, avg(CASE WHEN coherence >= 0.7 THEN 1.0 ELSE 0.0 END) AS cov, count(*) AS n FROM sig GROUP BY instrument), d AS (SELECT split_part(instrument, '_', 1) AS domain, cov, n FROM c),
  s AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cov) - 1 AS i, count(*) OVER (PARTITION BY domain) AS k FROM d)
  SELECT domain, count(*) AS n_traces, round(sum(cov * n) / sum(n), 6) AS weighted_coverage, round(avg(cov), 6) AS mean_coverage, round(coalesce(1.96 * stddev_samp(cov) / sqrt(count(*)), 0), 6) AS ci95, round(min(cov), 6) AS min_coverage, round(max(cov), 6) AS max_coverage, round(max(CASE WHEN i = k // 2 THEN cov END), 6) AS upper_median FROM s GROUP BY domain"""
)
def domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by domain: weighted and plain mean, 95 % interval, range, upper median."""
    c = signals(spark, sf_dir).groupBy("instrument").agg(F.avg((F.col("coherence") >= 0.7).cast("double")).alias("cov"), F.count(F.lit(1)).alias("n"))
    d = c.select(F.split_part("instrument", F.lit("_"), F.lit(1)).alias("domain"), "cov", "n")
    w = Window.partitionBy("domain").orderBy("cov")
    d = d.withColumn("i", F.row_number().over(w) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("domain")))
    x = F.col("cov")
    return d.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_traces"), F.round(F.sum(x * F.col("n")) / F.sum("n"), 6).alias("weighted_coverage"), F.round(F.avg(x), 6).alias("mean_coverage"),
        F.round(F.coalesce(1.96 * F.stddev_samp(x) / F.sqrt(F.count(F.lit(1))), F.lit(0.0)), 6).alias("ci95"), F.round(F.min(x), 6).alias("min_coverage"), F.round(F.max(x), 6).alias("max_coverage"),
        F.round(F.max(F.when(F.col("i") == F.expr("k div 2"), x)), 6).alias("upper_median"),
    )


@query(
    SIG
    + """, o AS (SELECT instrument AS entity, max(window_start) AS onset FROM sig GROUP BY instrument),
  r AS (SELECT o.entity, floor((o.onset - s.window_start - 1) / 3600000)::INT AS bin, s.coherence >= 0.6 AS flag FROM sig s JOIN o ON o.entity = s.instrument WHERE s.window_start < o.onset AND s.window_start >= o.onset - 3600000 * 12)
  SELECT entity, bin, count(*) AS n, round(avg(flag::INT), 6) AS density FROM r GROUP BY entity, bin"""
)
def lead_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of coherent windows in each of the twelve hours before an instrument's last window."""
    s = signals(spark, sf_dir)
    o = s.groupBy("instrument").agg(F.max("window_start").alias("onset"))
    rows = s.join(o, "instrument").select(F.col("instrument").alias("entity"), "onset", "window_start", (F.col("coherence") >= 0.6).alias("flag"))
    return guardrail.density_bins(rows, F.col("onset"), "window_start", 3_600_000, 12).select("entity", "bin", "n", *r6("density"))


@query(
    SIG
    + f""", t AS (SELECT id, signature, instrument, row_number() OVER ({_ORD}) AS i, count(*) OVER (PARTITION BY instrument) AS n FROM sig WHERE signature IS NOT NULL), m AS (SELECT signature, i > n * 0.92 AS recent FROM t),
  z AS (SELECT signature, count_if(recent) AS recent, count_if(NOT recent) AS history FROM m GROUP BY signature), tot AS (SELECT count_if(recent) AS r, count_if(NOT recent) AS h FROM m)
  SELECT signature, recent, history, round((recent / r) / (history / h), 6) AS lift FROM z, tot WHERE recent > 0 AND history > 0"""
)
def signature_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of each signature in the last 8 % of its instruments' windows against before."""
    s = signals(spark, sf_dir).where("signature is not null")
    w = Window.partitionBy("instrument").orderBy("window_start", "id")
    m = s.select("signature", (F.row_number().over(w) > F.count(F.lit(1)).over(Window.partitionBy("instrument")) * F.lit(0.92)).alias("new"))
    m = store(m.groupBy("signature").agg(F.count_if("new").alias("recent"), F.count_if(~F.col("new")).alias("history")))
    total = m.agg(F.sum("recent").alias("r"), F.sum("history").alias("h"))
    lift = (F.col("recent") / F.col("r")) / (F.col("history") / F.col("h"))
    return m.where("recent > 0 and history > 0").join(F.broadcast(total)).select("signature", "recent", "history", F.round(lift, 6).alias("lift"))


@query(SIG + f" SELECT id, lag(signature) OVER w AS prev_signature, lead(signature) OVER w AS next_signature, round(lambda_hazard - lag(lambda_hazard, 3) OVER w, 6) AS trend FROM sig WINDOW w AS ({_ORD})")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures before and after each window, and the hazard's change over four rows."""
    w = Window.partitionBy("instrument").orderBy("window_start", "id")
    return signals(spark, sf_dir).select("id", F.lag("signature").over(w).alias("prev_signature"), F.lead("signature").over(w).alias("next_signature"), F.round(F.col("lambda_hazard") - F.lag("lambda_hazard", 3).over(w), 6).alias("trend"))


@query(
    SIG
    + """, p AS (SELECT signature, regexp_extract(signature, '^c([0-9]+(?:\\.[0-9]+)?)_s([0-9]+(?:\\.[0-9]+)?)_e([0-9]+(?:\\.[0-9]+)?)$', ['c', 's', 'e']) AS x FROM sig WHERE signature IS NOT NULL)
  SELECT printf('c%.2f_s%.2f_e%.2f', floor(x.c::DOUBLE / 0.25) * 0.25, floor(x.s::DOUBLE / 0.25) * 0.25, floor(x.e::DOUBLE / 0.25) * 0.25) AS bucket, count(*) AS n FROM p WHERE x.c <> '' GROUP BY ALL"""
)
def signature_rebucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures floored to quarters."""
    b = kernel.rebucket(F.col("signature"))
    return signals(spark, sf_dir).where(kernel.signature_parts(F.col("signature")).isNotNull()).select(b.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_UP = lambda c: f"greatest(0, {c})"


@query(
    SIG
    + f""", t AS (SELECT id, {_UP("coherence")} AS c, {_UP("stability")} AS s, {_UP("entropy")} AS e, {_UP("lambda_hazard")} AS l, lag(coherence) OVER w AS pc, lag(stability) OVER w AS ps FROM sig WINDOW w AS ({_ORD}))
  SELECT id, round(greatest(0, least(1, least(1.5, (c + s) / 2) * (1 - least(1, e / 5)) * (1 - least(1, l)) / (1 + CASE WHEN pc IS NULL THEN 0 ELSE abs(c - {_UP("pc")}) + abs(s - {_UP("ps")}) END))), 6) AS size FROM t"""
)
def position_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("instrument").orderBy("window_start", "id")
    s = signals(spark, sf_dir).withColumns({f"{c}_before": F.lag(c).over(w) for c in ("coherence", "stability")})
    size = throttle(F.col("coherence"), F.col("stability"), F.col("entropy"), F.col("lambda_hazard"), F.col("coherence_before"), F.col("stability_before"))
    return s.select("id", F.round(size, 6).alias("size"))


@query(SIG + " SELECT CASE WHEN rupture > 0.55 OR lambda_hazard > 0.60 OR entropy > 0.70 THEN 'deferred' ELSE 'foreground' END AS route, count(*) AS n FROM sig GROUP BY 1")
def stream_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stream_route(F.col("rupture"), F.col("lambda_hazard"), F.col("entropy"))
    return signals(spark, sf_dir).groupBy(r.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(
    SIG
    + """, b AS (SELECT min(lambda_hazard) AS lo, max(lambda_hazard) AS hi FROM sig) SELECT least(9, floor((lambda_hazard - lo) / (hi - lo) * 10))::INT AS bin, count(*) AS n, round(avg(CASE WHEN coherence >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM sig, b GROUP BY 1"""
)
def admission_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission rate over ten equal-width hazard bins between least and greatest."""
    s = signals(spark, sf_dir)
    b = s.agg(F.min("lambda_hazard").alias("lo"), F.max("lambda_hazard").alias("hi"))
    ix = F.least(F.lit(9), F.floor((F.col("lambda_hazard") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10)).cast("int")
    return s.join(F.broadcast(b)).groupBy(ix.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("coherence") >= 0.5).cast("double")), 6).alias("rate"))


@query(
    SIG
    + """, c AS (SELECT avg(coherence) AS c, avg(stability) AS s, avg(entropy) AS e, avg(rupture) AS r, avg(lambda_hazard) AS l FROM sig)
  SELECT round(c, 6) AS coherence, round(s, 6) AS stability, round(e, 6) AS entropy, round(r, 6) AS rupture, round(l, 6) AS lambda_hazard FROM c"""
)
def window_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).agg(*(F.round(F.avg(m), 6).alias(m) for m in METRICS))
