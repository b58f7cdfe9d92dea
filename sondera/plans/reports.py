"""Queries of column statistics, splits, rankings and small tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions import chance
from sondera.operators import reports
from sondera.plans.graphs import _CAND, candidates
from sondera.plans.market import bars
from sondera.plans.market import _C as _BARS
from sondera.plans.registry import query
from sondera.plans.signals import SIG, signals
from sondera.session import store, table


@query(
    """SELECT "column", n, n_numeric, round(mean, 6) AS mean, round(sd, 6) AS sd FROM (SELECT 'value' AS "column", count(value) AS n, count(value) AS n_numeric, avg(value) AS mean, stddev_samp(value) AS sd FROM events
  UNION ALL SELECT 'user_id', count(user_id), count(user_id), avg(user_id), stddev_samp(user_id) FROM events UNION ALL SELECT 'event_type', count(event_type), count(try_cast(event_type AS DOUBLE)), avg(try_cast(event_type AS DOUBLE)), stddev_samp(try_cast(event_type AS DOUBLE)) FROM events)"""
)
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.column_stats(table(spark, sf_dir, "events"), ["value", "user_id", "event_type"])
    return s.select("column", "n", "n_numeric", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_MD5 = lambda c: f"('0x' || substr(md5({c}::VARCHAR || ':0'), 1, 8))::BIGINT % 10000"


@query(f"WITH s AS (SELECT DISTINCT doc_id, {_MD5('doc_id')} < 3000 AS test FROM doc_labels) SELECT count_if(test) AS n_test, count_if(NOT test) AS n_dev, count(*) - count(DISTINCT doc_id) AS n_both FROM s")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of two splits, and those in both: none."""
    s = store(reports.hash_split(table(spark, sf_dir, "doc_labels").select("doc_id"), "doc_id", 0.3))
    test, dev = (s.where(F.col("split") == k).select("doc_id").distinct() for k in ("test", "dev"))
    sizes = [d.agg(F.count(F.lit(1)).alias(c)) for d, c in ((test, "n_test"), (dev, "n_dev"))]
    return sizes[0].join(sizes[1]).join(reports.overlap(test, dev, "doc_id").withColumnRenamed("n", "n_both"))


@query(
    _BARS
    + """, b AS (SELECT instrument, timestamp_ms, coalesce(close >= lag(close) OVER (PARTITION BY instrument ORDER BY timestamp_ms), false)::INT AS up FROM c), s AS (SELECT instrument, timestamp_ms, avg(up) OVER (PARTITION BY instrument ORDER BY timestamp_ms ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM b)
  SELECT instrument, timestamp_ms, round(m, 6) AS smooth, round_even(m, 0)::INT AS bit FROM s"""
)
def smoothed_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend bits smoothed over five bars."""
    from pyspark.sql import Window

    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    b = bars(spark, sf_dir).withColumn("up", F.coalesce(F.col("close") >= F.lag("close").over(w), F.lit(False)).cast("int"))
    return reports.smoothed(b, "instrument", ["timestamp_ms"], "up").select("instrument", "timestamp_ms", F.round("smooth", 6).alias("smooth"), "bit")


@query(
    SIG
    + """, f AS (SELECT instrument, id, window_start AS t FROM sig WHERE rupture >= 0.97), b AS (SELECT instrument, window_start AS t, id AS near FROM sig WHERE lambda_hazard >= 0.95)
  SELECT f.id, arg_min(b.near, (abs(f.t - b.t), b.t)) AS near FROM f LEFT JOIN b USING (instrument) GROUP BY f.id"""
)
def nearest_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert window nearest in time to each failing one of the same instrument."""
    s = signals(spark, sf_dir)
    f = s.where("rupture >= 0.97").select("instrument", "id", F.col("window_start").alias("t"))
    b = s.where("lambda_hazard >= 0.95").select("instrument", F.col("window_start").alias("t"), F.col("id").alias("near"))
    return reports.nearest_in_time(f, b, "instrument", "t", "near").select("id", "near")


@query(
    _CAND
    + """, u AS (SELECT 'structural' AS ranking, cand_id, round(patternability, 6) AS score FROM cand UNION ALL SELECT 'semantic', cand_id, round(connector, 6) FROM cand UNION ALL SELECT 'combined', cand_id, round(0.5 * patternability + 0.5 * connector, 6) FROM cand)
  SELECT ranking, row_number() OVER (PARTITION BY ranking ORDER BY score DESC NULLS LAST, cand_id) AS rank, cand_id FROM u QUALIFY rank <= 20"""
)
def bridge_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bridge_ranking(candidates(spark, sf_dir), "cand_id", "patternability", "connector", 20)


@query(
    SIG
    + """, k AS (SELECT instrument, id, row_number() OVER (PARTITION BY instrument ORDER BY window_start, id) AS a, row_number() OVER (PARTITION BY instrument ORDER BY lambda_hazard DESC, window_start, id) AS b FROM sig) SELECT instrument, id FROM k WHERE a <= 4 OR b <= 2"""
)
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four windows of an instrument and its two of highest hazard."""
    return reports.evidence(signals(spark, sf_dir), "instrument", ["window_start", "id"], "lambda_hazard", 4, 2).select("instrument", "id")


@query(SIG + " SELECT instrument, count(*) AS n, sum(CASE WHEN rupture < 0.3 AND entropy < 0.4 THEN 1 ELSE 0 END)::BIGINT AS n_decisive FROM sig GROUP BY instrument")
def decisive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count_if(reports.decisive(F.col("rupture"), F.col("entropy"))).alias("n_decisive"))


@query(
    SIG
    + """, r AS (SELECT avg((lambda_hazard >= 0.9)::INT) AS p FROM sig), i AS (SELECT instrument, count(*) AS n, sum((lambda_hazard >= 0.9)::INT)::BIGINT AS k FROM sig GROUP BY instrument),
  e AS (SELECT instrument, n, k, p, unnest(range(0, n + 1)) AS j FROM i, r), t AS (SELECT instrument, n, k, sum(CASE WHEN j >= k THEN exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)) ELSE 0 END) AS q FROM e GROUP BY ALL)
  SELECT instrument, n, k, round(least(1, q), 6) AS p FROM t"""
)
def alert_binomial_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of as many alerts as an instrument has, at the rate of all."""
    s = signals(spark, sf_dir)
    rate = s.agg(F.avg((F.col("lambda_hazard") >= 0.9).cast("double")).alias("rate"))
    i = s.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lambda_hazard") >= 0.9).alias("k")).join(F.broadcast(rate))
    return i.select("instrument", "n", "k", F.round(chance.binomial_tail(F.col("n"), F.col("k"), F.col("rate")), 6).alias("p"))


@query(
    "WITH t AS (SELECT DISTINCT query_window_id, window_id, list_sort(tokens) AS tokens FROM twin_suggestions WHERE len(list_filter(tokens, lambda x: contains(lower(x), 'storm') OR contains(lower(x), 'ward'))) > 0) SELECT query_window_id, window_id, array_to_string(tokens[1:5], ', ') AS headline FROM t"
)
def twin_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twins with a keyword among their tokens, under a headline."""
    t = reports.keyword_filter(table(spark, sf_dir, "twin_suggestions"), "tokens", ["storm", "ward"])
    return t.select("query_window_id", "window_id", "headline").distinct()


@query(
    r"SELECT doc_id, 'doc://' || regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS uri FROM documents"
)
def doc_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", reports.doc_uri(F.col("path")).alias("uri"))


@query(_CAND + " SELECT string, sum(occurrences)::BIGINT AS occurrences FROM cand WHERE string LIKE '%gate%' AND patternability >= 0.3 GROUP BY string")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that hold a text, above a floor of pattern."""
    c = candidates(spark, sf_dir).where(F.col("string").contains("gate") & (F.col("patternability") >= 0.3))
    return c.groupBy("string").agg(F.sum("occurrences").alias("occurrences"))


@query(
    SIG
    + """, v AS (SELECT coherence AS x, lambda_hazard AS y, count(*) AS k FROM sig WHERE coherence IS NOT NULL AND lambda_hazard IS NOT NULL GROUP BY ALL),
  s AS (SELECT sum(CASE WHEN a.y < b.y THEN a.k * b.k WHEN a.y > b.y THEN -a.k * b.k ELSE 0 END) AS s FROM v a JOIN v b ON a.x < b.x),
  t AS (SELECT (SELECT sum(k) FROM v) AS n, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(k) AS t FROM v GROUP BY x)) AS tx, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(k) AS t FROM v GROUP BY y)) AS ty)
  SELECT n::BIGINT AS n, round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS tau FROM s, t"""
)
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of coherence and hazard, exact over all rows."""
    return reports.kendall(signals(spark, sf_dir), "coherence", "lambda_hazard").select("n", F.round("tau", 6).alias("tau"))
