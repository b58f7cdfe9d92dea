"""Queries that run as streams over everything that is there, and give what the batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions.scores import normalize_signals
from sondera.plans.registry import query
from sondera.streaming import operators as ops

LATE = "3650 days"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops.read_parquet_stream(spark, f"{sf_dir}/events.parquet")
    return e.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


@query("""SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) // 1000000 AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of each day and type from a windowed stream."""
    s = ops.tumbling(_events(spark, sf_dir), "ts", "1 day", LATE, ["event_type"], "value")
    return ops.run_available(s, mode="complete").select("event_type", F.unix_seconds("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, (epoch_us(ts) // 43200000000 - k) * 43200 AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day-long window that starts every twelve hours."""
    s = ops.sliding(_events(spark, sf_dir), "ts", "1 day", "12 hours", LATE, ["event_type"])
    return ops.run_available(s, mode="complete").select("event_type", F.unix_seconds("window_start").alias("window_start"), "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) // 1000000 AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, a gap of six hours between two."""
    s = ops.sessions(_events(spark, sf_dir), "ts", "6 hours", LATE, ["user_id"])
    return ops.run_available(s, mode="complete").select("user_id", F.unix_seconds("session_start").alias("session_start"), "n")


@query("SELECT instrument, count(DISTINCT id) AS n FROM signals GROUP BY instrument")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each instrument from a stream in which some are delivered more than once."""
    s = ops.read_parquet_stream(spark, f"{sf_dir}/signals.parquet").select("id", "instrument", F.col("ingested_at").alias("at"))
    return ops.run_available(ops.deduplicated(s, ["id"], "at", LATE)).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


_NN = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


@query(
    f"SELECT CASE WHEN coalesce({_NN('metrics.rupture')}, 0) > 0.55 OR coalesce({_NN('lambda_hazard')}, {_NN('metrics.lambda_hazard')}, {_NN('metrics.rupture')}, 0) > 0.60 OR coalesce({_NN('metrics.entropy')}, 1) > 0.70 THEN 'deferred' ELSE 'foreground' END AS route, count(*) AS n FROM signals GROUP BY 1"
)
def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries by route, decided as they arrive."""
    s = normalize_signals(ops.read_parquet_stream(spark, f"{sf_dir}/signals.parquet")).select("id", "rupture", "lambda_hazard", "entropy")
    return ops.run_available(ops.routed(s, "rupture", "lambda_hazard", "entropy")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.read_parquet_stream(spark, f"{sf_dir}/signals.parquet").dropDuplicates(["id"])


@query(
    """WITH u AS (SELECT DISTINCT id, instrument, window_start, signature FROM signals WHERE signature IS NOT NULL), g AS (SELECT list(signature) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS g FROM u WINDOW w AS (PARTITION BY instrument ORDER BY window_start, id))
  SELECT array_to_string(g, '|') AS qgram, count(*) AS n FROM g WHERE len(g) = 3 GROUP BY 1"""
)
def stream_qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q-grams from keyed state that holds the last two signatures of an instrument."""
    s = ops.qgrams(_signatures(spark, sf_dir), "instrument", "window_start", "signature", "id")
    return ops.run_available(s).groupBy("qgram").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH u AS (SELECT DISTINCT id, instrument, window_start, signature FROM signals WHERE signature IS NOT NULL)
  SELECT id AS key, count(*) OVER w AS repetitions, min(window_start) OVER w AS first_seen FROM u WINDOW w AS (PARTITION BY instrument, signature ORDER BY window_start RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW)"""
)
def stream_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetitions within six hours from the rows that the stream wrote before."""
    s = ops.read_parquet_stream(spark, f"{sf_dir}/signals.parquet")
    return ops.repetitions(s, "instrument", "window_start", "signature", "id", 21_600_000).select("key", "repetitions", "first_seen")
