"""Queries over events as ticks: candles, as-of joins, sessions, telemetry and back-tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.operators import market, telemetry
from sondera.plans.kernels import kernel_sql
from sondera.plans.registry import query
from sondera.session import store, table

HOUR = 3600
_C = """
WITH t AS (SELECT event_type AS instrument, (epoch_us(ts) // 3600000000) * 3600000 AS timestamp_ms, ts, event_id, value FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT instrument, timestamp_ms, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM t GROUP BY ALL)"""
_W = "PARTITION BY instrument ORDER BY timestamp_ms"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.candles(table(spark, sf_dir, "events"), "event_type", "ts", "value", HOUR)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(_C + " SELECT instrument, timestamp_ms, open, high, low, close, volume FROM c")
def resample_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir)


@query(
    _C
    + f""", q AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER ({_W}) AS step FROM c) SELECT instrument, count(*) AS n, count_if(step = 0) AS duplicates, count_if(step > 0 AND step <> 3600000) AS gaps, count_if(high < greatest(open, close, low) OR low > least(open, close, high) OR least(open, high, low, close) <= 0) AS insane FROM q GROUP BY instrument"""
)
def candle_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.quality(bars(spark, sf_dir), HOUR * 1000)


@query(
    _C
    + f""", b AS (SELECT instrument, timestamp_ms, coalesce(close >= lag(close) OVER w AND NOT (high - low < lag(high - low) OVER w AND volume < lag(volume) OVER w), false)::INT AS bit FROM c WINDOW w AS ({_W})) SELECT instrument, timestamp_ms, bit FROM b"""
)
def candle_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.with_bits(bars(spark, sf_dir)).select("instrument", "timestamp_ms", "bit")


@query(
    _C
    + f""", r AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM c WINDOW w AS ({_W}))
  SELECT instrument, timestamp_ms, round(tr, 6) AS tr, round(avg(tr) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS atr FROM r"""
)
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.true_range(bars(spark, sf_dir)).select("instrument", "timestamp_ms", *r6("tr", "atr"))


@query(
    _C
    + f""", r AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM c WINDOW w AS ({_W})),
  a AS (SELECT instrument, timestamp_ms, avg(tr) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM r),
  e AS (SELECT event_type AS instrument, event_id, epoch_us(ts) // 1000 AS timestamp_ms FROM events)
  SELECT e.instrument, e.event_id, round(coalesce(a.atr, (SELECT arg_min(f.atr, f.timestamp_ms) FROM a f WHERE f.instrument = e.instrument)), 6) AS atr
  FROM e ASOF LEFT JOIN a ON a.instrument = e.instrument AND a.timestamp_ms <= e.timestamp_ms"""
)
def asof_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average true range at each event: the last bar's not after it, else the next one's."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), "event_id", F.floor(market.micros("ts") / 1000).cast("long").alias("timestamp_ms"))
    a = market.true_range(bars(spark, sf_dir)).select("instrument", "timestamp_ms", "atr")
    return market.as_of(e, a, "instrument", "timestamp_ms", "atr").select("instrument", "event_id", *r6("atr"))


@query(
    _C
    + f""", r AS (SELECT instrument, timestamp_ms, close / lag(close) OVER ({_W}) - 1 AS ret FROM c), e AS (SELECT *, sum(ret) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS equity FROM r WHERE ret IS NOT NULL),
  p AS (SELECT *, greatest(0, max(equity) OVER ({_W} ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
  SELECT instrument, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(avg(ret) * sqrt(count(*)) / stddev_samp(ret), 6) AS sharpe, round(max(peak - equity), 6) AS max_drawdown, round(252 * avg(ret) / max(peak - equity), 6) AS calmar FROM p GROUP BY instrument"""
)
def equity_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    r = bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where("ret is not null")
    d = market.drawdown(r, "instrument", ["timestamp_ms"], "ret")
    n = F.count(F.lit(1))
    return d.groupBy("instrument").agg(n.alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"), F.round(F.avg("ret") * F.sqrt(n) / F.stddev_samp("ret"), 6).alias("sharpe"), F.round(F.max("drawdown"), 6).alias("max_drawdown"), F.round(252 * F.avg("ret") / F.max("drawdown"), 6).alias("calmar"))


@query(
    _C
    + f""", n AS (SELECT instrument, timestamp_ms, close - lag(close, 1) OVER w AS mom, lead(close) OVER w / close - 1 AS nxt FROM c WINDOW w AS ({_W}))
  SELECT instrument, count(*) AS n, round(avg(CASE WHEN mom >= 0 THEN nxt ELSE -nxt END), 6) AS baseline FROM n WHERE mom IS NOT NULL AND nxt IS NOT NULL GROUP BY instrument"""
)
def baseline_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean next return taken in the direction of the last change."""
    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    n = bars(spark, sf_dir).select("instrument", (F.col("close") - F.lag("close").over(w)).alias("mom"), (F.lead("close").over(w) / F.col("close") - 1).alias("nxt")).dropna()
    return n.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("mom") >= 0, F.col("nxt")).otherwise(-F.col("nxt"))), 6).alias("baseline"))


def _session_sql() -> str:
    parts = []
    for name, (a, b) in market.SESSIONS.items():
        inside = f"m >= {a} AND m < {b}" if a <= b else f"(m >= {a} OR m < {b})"
        parts.append(f"SELECT '{name}' AS session, count(*) AS n, round(avg(value), 6) AS mean_value FROM m WHERE {inside}")
    return "WITH m AS (SELECT hour(ts) * 60 + minute(ts) AS m, value FROM events) " + " UNION ALL ".join(parts)


@query(_session_sql())
def session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside each trading session, one of which wraps past midnight."""
    e = table(spark, sf_dir, "events")
    inside = [F.when(market.in_session(F.col("ts"), a, b), F.lit(name)) for name, (a, b) in market.SESSIONS.items()]
    return e.select(F.explode(F.array_compact(F.array(*inside))).alias("session"), "value").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    """WITH r AS (SELECT event_type, user_id % 7 AS grp, value FROM events)
  SELECT event_type, grp, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd FROM r GROUP BY ROLLUP (event_type, grp)"""
)
def rollup_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("grp"), "value")
    return r.rollup("event_type", "grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_samp("value"), 6).alias("sd"))


_T = "PARTITION BY event_type ORDER BY ts, event_id"


@query(
    f"""WITH a AS (SELECT event_id, event_type, ts, value, value - coalesce(lag(value) OVER w, value) AS d1, median(value) OVER (w ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS med,
    coalesce(stddev_samp(value) OVER (w ROWS BETWEEN 150 PRECEDING AND 150 FOLLOWING), 0) AS sd FROM events WINDOW w AS ({_T})),
  b AS (SELECT *, abs(value - med) AS dev FROM a), c AS (SELECT *, d1 - coalesce(lag(d1) OVER w, d1) AS d2, dev - coalesce(lag(dev) OVER w, dev) AS dr FROM b WINDOW w AS ({_T}))
  SELECT concat_ws(' ', CASE WHEN d1 > 0 THEN 'UP' END, CASE WHEN d2 > 0 THEN 'ACCEL' END, CASE WHEN dr > 0 THEN 'RANGEEXP' END, CASE WHEN sd > 0 AND value > med THEN 'ZPOS' END) AS tokens, count(*) AS n FROM c GROUP BY ALL"""
)
def struct_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry tokens of each event type's value series."""
    b = telemetry.structure_bits(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    return b.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, (epoch_us(ts) // 3600000000) * 3600 AS bucket, round(quantile_cont(value, 0.5), 6) AS value FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def resample_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.resample(table(spark, sf_dir, "events").where("ts is not null"), ["event_type"], "ts", "value", HOUR, "median").select("event_type", "bucket", *r6("value"))


@query(
    """WITH h AS (SELECT event_type, (epoch_us(ts) // 3600000000) * 3600 AS bucket, avg(value) AS v FROM events GROUP BY ALL), g AS (SELECT event_type, unnest(range(lo, hi + 1, 3600)) AS bucket FROM (SELECT event_type, min(bucket) AS lo, max(bucket) AS hi FROM h GROUP BY event_type)),
  j AS (SELECT g.event_type, g.bucket, h.v FROM g LEFT JOIN h USING (event_type, bucket)),
  k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN bucket END IGNORE NULLS) OVER p AS tp, last_value(v IGNORE NULLS) OVER p AS vp, first_value(CASE WHEN v IS NOT NULL THEN bucket END IGNORE NULLS) OVER n AS tn, first_value(v IGNORE NULLS) OVER n AS vn FROM j
    WINDOW p AS (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_type, bucket, round(coalesce(v, vp + (bucket - tp) / (tn - tp) * (vn - vp)), 6) AS value FROM k"""
)
def resample_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means on a full grid, empty hours on the line between their neighbours."""
    h = telemetry.resample(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", HOUR)
    grid = h.groupBy("event_type").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select("event_type", F.explode(F.sequence("lo", "hi", F.lit(HOUR).cast("long"))).alias("bucket"))
    return telemetry.interpolate(grid.join(h, ["event_type", "bucket"], "left"), ["event_type"], "bucket", "value").select("event_type", "bucket", *r6("value"))


@query(
    """WITH e AS (SELECT event_id, ts, user_id, value FROM events), w AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS win_id, user_id, ts AS a, ts + INTERVAL 1 HOUR AS b FROM events WHERE event_type = 'signup')
  SELECT e.event_id, arg_min(w.a, w.a) AS window_start FROM e JOIN w ON w.user_id = e.user_id AND e.ts >= w.a AND e.ts < w.b GROUP BY e.event_id"""
)
def interval_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hour-long window of a user's signup that holds each of the user's events."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    w = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id"), F.col("ts").alias("a"))
    # Time is cut into hours: a window touches two, so the range join becomes an equi-join.
    hour = lambda c: F.floor(market.micros(c) / (HOUR * 1_000_000)).cast("long")
    w = w.select("user_id", "a", F.explode(F.array(hour("a"), hour("a") + 1)).alias("h"))
    j = e.withColumn("h", hour("ts")).join(w, ["user_id", "h"]).where((F.col("ts") >= F.col("a")) & (market.micros("ts") < market.micros("a") + HOUR * 1_000_000))
    return j.groupBy("event_id").agg(F.min("a").alias("window_start"))


@query(
    """WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + 600000000 AS e FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + 600000000 AS e FROM events WHERE event_type = 'error')
  SELECT a.event_id AS click_id, count(*) AS n_overlaps FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND a.e > b.s GROUP BY a.event_id"""
)
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error spans of ten minutes that overlap each click span of the same user, joined by ten-minute cells."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", market.micros("ts").alias("s"))
    width = 600_000_000
    cell = F.floor(F.col("s") / width).cast("long")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("s").alias("sa"), cell.alias("cell"))
    b = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("s").alias("sb"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    return a.join(b, ["user_id", "cell"]).where((F.col("sa") < F.col("sb") + width) & (F.col("sa") + width > F.col("sb"))).groupBy("click_id").agg(F.count(F.lit(1)).alias("n_overlaps"))


@query("SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def _candle_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.repetitions(market.candle_signals(bars(spark, sf_dir)), 24 * HOUR * 1000)


#: s(instrument, timestamp_ms, price, metrics, signature, window_index, repetition_count, repetition_first_seen_ms, atr) of the hourly bars.
_SIGNALS = (
    _C
    + f""", cb AS (SELECT instrument, timestamp_ms, close, high, low, coalesce(close >= lag(close) OVER w AND NOT (high - low < lag(high - low) OVER w AND volume < lag(volume) OVER w), false)::INT AS bit, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY instrument) AS n FROM c WINDOW w AS ({_W})),
  wd AS (SELECT *, greatest(1, width // 32) AS step FROM (SELECT DISTINCT instrument, least(n, CASE WHEN n >= 256 THEN 128 WHEN n > 24 THEN greatest(12, n - least(8, n // 4)) WHEN n >= 12 THEN 12 ELSE greatest(9, n) END) AS width FROM cb)),
  en AS (SELECT cb.instrument, pos AS e, timestamp_ms, close, width, (pos + 1 - width) // step AS k FROM cb JOIN wd USING (instrument) WHERE pos + 1 >= width AND (pos + 1 - width) % step = 0),
  kb AS (SELECT en.instrument || '#' || k AS key, cb.pos - (e - width + 1) AS i, cb.bit AS b FROM en JOIN cb ON cb.instrument = en.instrument AND cb.pos BETWEEN e - width + 1 AND e), """
    + kernel_sql()
    + f""", tr AS (SELECT instrument, timestamp_ms, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM cb WINDOW w AS ({_W})),
  av AS (SELECT instrument, timestamp_ms, avg(tr) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM tr),
  s0 AS (SELECT en.instrument, en.timestamp_ms, close AS price, coherence, 1 - rupture AS stability, entropy, rupture, lambda_hazard, printf('c%.2f_s%.2f_e%.2f', coherence, 1 - rupture, entropy) AS signature, k AS window_index, atr
    FROM en JOIN kern ON key = en.instrument || '#' || k JOIN av ON av.instrument = en.instrument AND av.timestamp_ms = en.timestamp_ms),
  s AS (SELECT *, count(*) OVER w AS repetition_count, min(timestamp_ms) OVER w AS repetition_first_seen_ms FROM s0 WINDOW w AS (PARTITION BY instrument, signature ORDER BY timestamp_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW))"""
)
_FIELDS = ("coherence", "stability", "entropy", "rupture", "lambda_hazard")


@query(_SIGNALS + " SELECT instrument, timestamp_ms, price, " + ", ".join(f"round({f}, 6) AS {f}" for f in _FIELDS) + ", signature, window_index, repetition_count, repetition_first_seen_ms FROM s")
def candle_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window over the trend bits of every instrument's hourly bars."""
    s = _candle_signals(spark, sf_dir)
    return s.select("instrument", "timestamp_ms", "price", *r6(*_FIELDS), "signature", "window_index", "repetition_count", "repetition_first_seen_ms")


#: Parameter sets of the back-test queries, in the order of market.PARAMS.
GRID = [
    (0, 1, 0.3, 0.1, 0.0, 1.0, None, None, "momentum", "unit", 3, None, None, None, None),
    (1, 1, 0.6, 0.1, 0.0, 1.0, None, None, "momentum", "unit", 8, 0.25, None, None, None),
    (2, 2, 0.3, 0.1, 0.2, 0.99, None, None, "momentum", "throttle", 8, None, "ATR", 1.0, 2.0),
    (3, 2, 0.6, 0.1, 0.0, 1.0, 480, 990, "momentum", "unit", 8, None, "BPS", 500.0, 900.0),
    (4, 1, 0.6, 0.1, 0.0, 1.0, 1320, 420, "mean_reversion", "throttle", None, 0.3, "ATR", 0.5, 0.5),
    (5, 1, 0.6, 0.3, 0.1, 1.0, None, None, "mean_reversion", "unit", 5, None, "BPS", 0.0, 400.0),
]


def _value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_TRADES = (
    _SIGNALS.replace("WITH t AS", "WITH RECURSIVE t AS", 1)
    + ", ps("
    + ", ".join(x.split()[0] for x in market.PARAMS.split(", "))
    + ") AS (VALUES "
    + ", ".join("(" + ", ".join(_value(x) for x in g) + ")" for g in GRID)
    + f"""), q AS (SELECT *, row_number() OVER w AS rn, price - lag(price) OVER w AS delta, lag(coherence) OVER w AS pc, lag(stability) OVER w AS ps FROM s WINDOW w AS ({_W})),
  z AS (SELECT *, greatest(0, least(1, (coherence + stability) / 2 * (1 - least(1, entropy / 5)) * (1 - least(1, lambda_hazard)) / (1 + coalesce(abs(coherence - pc) + abs(stability - ps), 0)))) AS thr, (timestamp_ms // 60000) % 1440 AS m FROM q),
  g AS (SELECT z.instrument, p.params, rn, timestamp_ms AS ms, price, lambda_hazard AS lam, coalesce(horizon, 1000000000) AS horizon, coalesce(hazard_exit, 1e9) AS hx, targets, coalesce(sl, 0) AS psl, coalesce(tp, 0) AS ptp, atr,
    CASE WHEN mode = 'unit' THEN 1.0 ELSE thr END AS size, CASE WHEN delta IS NULL OR abs(delta) < 1e-9 THEN 0 WHEN (delta > 0) = (direction = 'momentum') THEN 1 ELSE -1 END AS side,
    repetition_count >= min_rep AND lambda_hazard <= max_hazard AND coherence >= min_coh AND stability >= min_stab AND entropy <= max_ent
      AND (session_start IS NULL OR CASE WHEN session_start <= session_end THEN m >= session_start AND m < session_end ELSE m >= session_start OR m < session_end END) AS elig FROM z, ps p),
  st AS (
    SELECT DISTINCT instrument, params, 0::BIGINT AS rn, false AS open, 0::BIGINT AS since, 0.0::DOUBLE AS entry, 0 AS side, 0.0::DOUBLE AS size, NULL::DOUBLE AS sl, NULL::DOUBLE AS tp, 0 AS bars, NULL::VARCHAR AS reason, 0::BIGINT AS x_at, 0.0::DOUBLE AS x_entry, 0 AS x_side, 0.0::DOUBLE AS x_size, 0 AS x_bars, 0::BIGINT AS ms, 0.0::DOUBLE AS price FROM g
    UNION ALL
    SELECT instrument, params, rn, still OR enter, CASE WHEN still THEN since ELSE ms END, CASE WHEN still THEN entry ELSE price END, CASE WHEN still THEN side ELSE nside END, CASE WHEN still THEN size ELSE nsize END,
      CASE WHEN still THEN sl WHEN targets IS NULL THEN NULL WHEN targets = 'BPS' AND (psl > 0 OR ptp > 0) THEN price - nside * CASE WHEN psl > 0 THEN price * psl / 10000 ELSE price * 0.01 END WHEN targets = 'ATR' AND atr > 0 THEN price - nside * atr * greatest(0.0001, psl) ELSE price * 0.99 END,
      CASE WHEN still THEN tp WHEN targets IS NULL THEN NULL WHEN targets = 'BPS' AND (psl > 0 OR ptp > 0) THEN price + nside * CASE WHEN ptp > 0 THEN price * ptp / 10000 ELSE price * 0.01 END WHEN targets = 'ATR' AND atr > 0 THEN price + nside * atr * greatest(0.0001, ptp) ELSE price * 1.01 END,
      CASE WHEN still THEN bars + 1 WHEN enter THEN 1 ELSE 0 END, rs, since, entry, side, size, bars, ms, price
    FROM (SELECT *, open AND rs IS NULL AS still, NOT (open AND rs IS NULL) AND elig AND nside <> 0 AND nsize > 0 AS enter FROM (
      SELECT st.instrument, st.params, g.rn, st.open, st.since, st.entry, st.side, st.size, st.sl, st.tp, st.bars, g.ms, g.price, g.elig, g.side AS nside, g.size AS nsize, g.targets, g.psl, g.ptp, g.atr,
        CASE WHEN NOT st.open THEN NULL WHEN st.bars >= g.horizon THEN 'exit_horizon' WHEN g.lam > g.hx THEN 'hazard_exit' WHEN st.side * g.price <= st.side * st.sl THEN 'stop_loss' WHEN st.side * g.price >= st.side * st.tp THEN 'take_profit' END AS rs
      FROM st JOIN g ON g.instrument = st.instrument AND g.params = st.params AND g.rn = st.rn + 1) a) b
  ), lastrow AS (SELECT instrument, max(rn) AS rn FROM q GROUP BY instrument),
  trades AS (SELECT instrument, params, x_at AS entry_ms, ms AS exit_ms, x_entry AS entry, price AS exit, x_side AS direction, x_size AS size, x_bars AS bars, x_side * (price - x_entry) / x_entry * x_size AS ret, reason FROM st WHERE reason IS NOT NULL
    UNION ALL SELECT st.instrument, params, since, ms, entry, price, side, size, bars, side * (price - entry) / entry * size, 'close_eod' FROM st JOIN lastrow l ON l.instrument = st.instrument AND l.rn = st.rn WHERE open)"""
)


def _trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Signals with atr, and their trades under every parameter set."""
    s = _candle_signals(spark, sf_dir)
    a = market.true_range(bars(spark, sf_dir)).select("instrument", "timestamp_ms", "atr")
    s = store(market.as_of(s, a, "instrument", "timestamp_ms", "atr"))
    return s, store(market.simulate_trades(s, spark.createDataFrame(GRID, market.PARAMS)))


@query(_TRADES + " SELECT instrument, params::INT AS params, entry_ms, exit_ms, entry, exit, direction, round(size, 6) AS size, bars, round(ret, 6) AS ret, reason FROM trades")
def trade_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of each instrument under each parameter set."""
    t = _trades(spark, sf_dir)[1]
    return t.select("instrument", "params", "entry_ms", "exit_ms", "entry", "exit", "direction", *r6("size"), "bars", *r6("ret"), "reason")


@query(
    _TRADES
    + """, tt AS (SELECT params, instrument AS who, instrument, entry_ms, exit_ms, ret, bars FROM trades UNION ALL SELECT params, 'all', instrument, entry_ms, exit_ms, ret, bars FROM trades),
  e AS (SELECT *, sum(ret) OVER w AS eq FROM tt WINDOW w AS (PARTITION BY params, who ORDER BY exit_ms, entry_ms, instrument ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, max(eq) OVER (PARTITION BY params, who ORDER BY exit_ms, entry_ms, instrument ROWS UNBOUNDED PRECEDING) - eq AS dd FROM e),
  u AS (SELECT params, who, count(*) AS n, avg((ret > 0)::INT) AS win_rate, avg(ret) AS mean_ret, avg(ret) FILTER (WHERE ret > 0) AS aw, avg(-ret) FILTER (WHERE ret < 0) AS al, stddev_samp(ret) AS sd, sqrt(avg(ret * ret) FILTER (WHERE ret < 0)) AS down, coalesce(sum(ret) FILTER (WHERE ret > 0), 0) AS win, coalesce(sum(-ret) FILTER (WHERE ret < 0), 0) AS loss, max(dd) AS dd, avg(bars) AS bars FROM d GROUP BY params, who),
  bs AS (SELECT instrument, avg(CASE WHEN delta IS NULL OR abs(delta) < 1e-9 THEN 0 WHEN delta > 0 THEN 1 ELSE -1 END * coalesce((nxt - price) / price, 0)) AS b FROM (SELECT *, lead(price) OVER (PARTITION BY instrument ORDER BY timestamp_ms) AS nxt FROM q) GROUP BY instrument)
  SELECT u.params::INT AS params, who AS instrument, n, round(win_rate, 6) AS win_rate, round(mean_ret, 6) AS mean_ret, round(coalesce(aw / al, 0), 6) AS payoff, round(CASE WHEN sd > 0 THEN mean_ret * sqrt(n) / sd ELSE 0 END, 4) AS sharpe, round(CASE WHEN down > 1e-9 THEN mean_ret * sqrt(n) / down ELSE 0 END, 4) AS sortino,
    CASE WHEN loss > 1e-9 THEN round(win / loss, 4) WHEN win > 1e-9 THEN 'infinity'::DOUBLE ELSE 0 END AS profit_factor, round(dd, 6) AS max_drawdown, round(CASE WHEN dd > 1e-9 THEN 252 * mean_ret / dd ELSE 0 END, 4) AS calmar, round(bars, 6) AS mean_bars, round(mean_ret - CASE WHEN direction = 'momentum' THEN 1 ELSE -1 END * b, 6) AS alpha
  FROM u JOIN ps USING (params) LEFT JOIN bs ON bs.instrument = who"""
)
def backtest_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by parameter set and instrument, and of each set's portfolio (instrument 'all', without alpha)."""
    s, t = _trades(spark, sf_dir)
    m = store(market.summary(t, ["params", "instrument"]).unionByName(market.summary(t.withColumn("instrument", F.lit("all")), ["params", "instrument"])))
    side = F.when(F.col("params").isin([g[0] for g in GRID if g[8] == "momentum"]), 1).otherwise(-1)
    b = market.baselines(s)
    m = m.join(b, "instrument", "left").withColumn("alpha", F.col("mean_ret") - side * F.col("baseline"))
    return m.select("params", "instrument", "n", *r6("win_rate", "mean_ret", "payoff"), *(F.round(c, 4).alias(c) for c in ("sharpe", "sortino", "profit_factor")), *r6("max_drawdown"), F.round("calmar", 4).alias("calmar"), *r6("mean_bars", "alpha"))


@query(
    _SIGNALS
    + f""", r AS (SELECT instrument, CASE WHEN close > 0 AND lag(close) OVER ({_W}) > 0 THEN ln(close / lag(close) OVER ({_W})) END AS r FROM c), sg AS (SELECT instrument, coalesce(stddev_samp(r), 0) AS sigma FROM r GROUP BY instrument),
  dt AS (SELECT instrument, rupture, greatest(0.000001, (timestamp_ms - lag(timestamp_ms) OVER ({_W})) / 1000.0) AS dt, lag(timestamp_ms) OVER ({_W}) AS p FROM s), lm AS (SELECT instrument, sum(rupture) / sum(dt) * 60 AS rate FROM dt WHERE p IS NOT NULL GROUP BY instrument)
  SELECT instrument, round(sigma, 6) AS sigma, round(greatest(0, least(1, 1 - exp(-coalesce(rate, 0)))), 6) AS lambda FROM sg LEFT JOIN lm USING (instrument)"""
)
def manifold_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of returns and chance of a rupture a minute of each instrument."""
    return market.manifold_coefficients(bars(spark, sf_dir), _candle_signals(spark, sf_dir)).select("instrument", *r6("sigma", "lambda"))


@query()
def return_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of each instrument's mean return by resampling, and the chance that it is not above 0."""
    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    r = bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    return market.bootstrap(r, "instrument", "ret", "timestamp_ms")
