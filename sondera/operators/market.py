"""Candles, trend bits, windows over them, back-tests and their summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions.kernel import FIELDS, kernel_rows
from sondera.functions.scores import throttle
from sondera.operators.prefix import place_in_group
from sondera.session import fits, small

# Session presets in UTC minutes of the day.
SESSIONS = {"LDN": (480, 990), "NY": (780, 1260), "TKO": (0, 540), "SYD": (1320, 420)}


def in_session(ts: Column, start: int, end: int) -> Column:
    """Whether a time of day lies in [start, end) minutes; a start after the end wraps past midnight."""
    m = F.hour(ts) * 60 + F.minute(ts)
    return (m >= start) & (m < end) if start <= end else (m >= start) | (m < end)


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a zoneless or UTC timestamp column, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def candles(ticks: DataFrame, instrument: str, ts: str, price: str, seconds: int) -> DataFrame:
    """Open, high, low, close and volume (ticks) of each bar of ``seconds``; empty bars have no row."""
    bar = (F.floor(micros(ts) / (seconds * 1_000_000)) * seconds * 1000).cast("long")
    return ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(instrument).alias("instrument"), bar.alias("timestamp_ms")).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def quality(c: DataFrame, cadence_ms: int) -> DataFrame:
    """(instrument, n, duplicates, gaps, insane): repeated times, steps other than the cadence, bars whose prices contradict each other."""
    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    step = F.col("timestamp_ms") - F.lag("timestamp_ms").over(w)
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")) | (F.least("open", "high", "low", "close") <= 0)
    return c.withColumn("step", step).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("step") == 0).alias("duplicates"), F.count_if((F.col("step") > 0) & (F.col("step") != cadence_ms)).alias("gaps"), F.count_if(bad).alias("insane"))


def with_bits(c: DataFrame) -> DataFrame:
    """A bit a bar: 1 if the close did not fall, but 0 where range and volume both shrink; the first bar is 0."""
    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    rng = F.col("high") - F.col("low")
    shrinks = (rng < F.lag(rng).over(w)) & (F.col("volume") < F.lag("volume").over(w))
    up = (F.col("close") >= F.lag("close").over(w)) & ~shrinks
    return c.withColumn("bit", F.coalesce(up, F.lit(False)).cast("int"))


def window_rule(n: int) -> tuple[int, int]:
    """Width and step of windows over n bars."""
    width = 128 if n >= 256 else (max(12, n - min(8, n // 4)) if n > 24 else (12 if n >= 12 else max(9, n)))
    width = min(width, n) if n else 0
    return width, max(1, width // 32)


SIGNALS = "instrument string, timestamp_ms long, price double, coherence double, stability double, entropy double, rupture double, lambda_hazard double, signature string, window_index long"
#: Windows of an instrument that one task reads.
STRETCH = 8_192


def _signals(stretch: int):
    def run(t: pa.Table) -> pa.Table:
        """Signals of the windows that end in one stretch; the bars before it that they hold are there too."""
        t = t.sort_by("at").combine_chunks()
        n, own = t["n"][0].as_py(), t["stretch"][0].as_py()
        width, step = window_rule(n)
        at, bits = np.asarray(t["at"]), np.asarray(t["bit"])
        # The bar at place e - 1 ends window (e - width) / step.
        ends = np.flatnonzero((at + 1 >= width) & ((at + 1 - width) % step == 0) & (at // stretch == own)) if width else np.zeros(0, np.int64)
        m = kernel_rows(np.lib.stride_tricks.sliding_window_view(bits, width)[ends - width + 1]) if len(ends) else {f: np.zeros(0) for f in FIELDS}
        s = 1 - m["rupture"]
        names = [f"c{a:.2f}_s{b:.2f}_e{c:.2f}" for a, b, c in zip(m["coherence"], s, m["entropy"], strict=True)]
        cols = [t["instrument"].take(pa.array(ends)), t["timestamp_ms"].take(pa.array(ends)), t["close"].take(pa.array(ends)), m["coherence"], s, m["entropy"], m["rupture"], m["lambda_hazard"], pa.array(names, pa.string()), (at[ends] + 1 - width) // step]
        return pa.table([c if isinstance(c, pa.ChunkedArray | pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in SIGNALS.split(", ")])

    return run


def candle_signals(c: DataFrame, *, keep: int | None = None) -> DataFrame:
    """Windowed kernel metrics of each instrument's bits, all windows or the last ``keep``.

    Bars are numbered within their instrument and cut into stretches that share the bars before their edge, so an instrument of any
    length spans many tasks. An instrument of few bars has narrower windows.
    """
    bits = with_bits(c).select(F.col("instrument").cast("string").alias("instrument"), "timestamp_ms", F.col("close").cast("double").alias("close"), "bit")
    placed = place_in_group(bits, "instrument", ["timestamp_ms"], "at")
    placed = placed.join(small(placed.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))), "instrument")
    # A window is 128 bars at most.
    reach = F.sequence(F.floor(F.col("at") / STRETCH), F.floor((F.col("at") + 128) / STRETCH))
    out = placed.withColumn("stretch", F.explode(reach)).groupBy("instrument", "stretch").applyInArrow(_signals(STRETCH), SIGNALS)
    if keep is None:
        return out
    last = F.max("window_index").over(Window.partitionBy("instrument"))
    return out.withColumn("_last", last).where(F.col("window_index") > F.col("_last") - keep).drop("_last").withColumn("window_index", F.row_number().over(Window.partitionBy("instrument").orderBy("window_index")).cast("long") - 1)


def repetitions(s: DataFrame, lookback_ms: int) -> DataFrame:
    """Signals with how often and since when the signature came within the lookback."""
    w = Window.partitionBy("instrument", "signature").orderBy("timestamp_ms").rangeBetween(-lookback_ms, 0)
    return s.withColumn("repetition_count", F.count(F.lit(1)).over(w)).withColumn("repetition_first_seen_ms", F.min("timestamp_ms").over(w))


def true_range(c: DataFrame, n: int = 14) -> DataFrame:
    """Bars with true range and its mean over the last n."""
    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    prev = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return c.withColumn("tr", tr).withColumn("atr", F.avg("tr").over(w.rowsBetween(-(n - 1), 0)))


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """``left`` with the last non-null ``value`` of ``right`` not after it, else the first one after; by key, one shuffle."""
    cols = [c for c in left.columns if c != value]
    # Rows of both sides in one sort: no interval join.
    r = right.select(by, on, F.col(value).alias("_v"), F.lit(0).alias("_side"), *(F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c in cols and c not in (by, on)))
    u = left.select(*cols, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side")).unionByName(r)
    w = Window.partitionBy(by).orderBy(on, "_side")
    back = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Read backwards, so that both frames grow row by row.
    down = Window.partitionBy(by).orderBy(F.desc(on), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.last("_v", ignorenulls=True).over(down)
    return u.withColumn(value, F.coalesce(back, ahead)).where("_side = 1").drop("_v", "_side")


def drawdown(returns: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows with cumulative equity, its running maximum and the fall from it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = returns.withColumn("equity", F.sum(value).over(w))
    return e.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(w))).withColumn("drawdown", F.col("peak") - F.col("equity"))


TRADES = "instrument string, params int, entry_ms long, exit_ms long, entry double, exit double, direction int, size double, bars int, ret double, reason string"
#: Columns of a parameter set. Null horizon, hazard_exit, targets or session_start: no such rule. targets: 'ATR' or 'BPS'.
PARAMS = "params int, min_rep int, max_hazard double, min_coh double, min_stab double, max_ent double, session_start int, session_end int, direction string, mode string, horizon int, hazard_exit double, targets string, sl double, tp double"
REASONS = np.array(["exit_horizon", "hazard_exit", "stop_loss", "take_profit", "close_eod"])


class Desk:
    """Open positions of every parameter set in one instrument, fed row by row in the order of time."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, n = p, len(p["params"])
        self.open = np.zeros(n, bool)
        self.entry, self.sl, self.tp, self.size = (np.zeros(n) for _ in range(4))
        self.at, self.side, self.bars = (np.zeros(n, np.int64) for _ in range(3))
        self.last: tuple | None = None

    def _close(self, which: np.ndarray, reason: np.ndarray, name: str, ms: int, price: float) -> list[tuple]:
        i = np.flatnonzero(which)
        ret = self.side[i] * (price - self.entry[i]) / self.entry[i] * self.size[i]
        self.open[i] = False
        return [(name, int(self.p["params"][j]), int(self.at[j]), ms, float(self.entry[j]), price, int(self.side[j]), float(self.size[j]), int(self.bars[j]), float(r), str(REASONS[reason[j]])) for j, r in zip(i.tolist(), ret, strict=True)]

    def row(self, name: str, ms: int, price: float, delta: float, atr: float, hazard: float, size: float, eligible: np.ndarray) -> list[tuple]:
        """Trades that this row closes. Exits come first (horizon, hazard, stop, target), then an entry may follow."""
        p, out = self.p, []
        self.last = (name, ms, price)
        if self.open.any():
            up = self.side > 0
            tests = [self.bars >= p["horizon"], hazard > p["hazard_exit"], np.where(up, price <= self.sl, price >= self.sl), np.where(up, price >= self.tp, price <= self.tp)]
            reason = np.select(tests, range(4), -1)
            leave = self.open & (reason >= 0)
            if leave.any():
                out = self._close(leave, reason, name, ms, price)
        # A flat or missing earlier price opens nothing.
        if not np.isnan(delta) and abs(delta) >= 1e-9:
            own = np.where(p["unit"], 1.0, size)
            enter = ~self.open & eligible & (own > 0)
            if enter.any():
                side = np.where(p["reverts"], -1, 1) * (1 if delta > 0 else -1)
                # A hundredth of the price where a target has no measure.
                far = price * 0.01
                bps, ranged = p["targets"] == 2, (p["targets"] == 1) & (atr > 0)
                down = np.where(bps, np.where(p["sl"] > 0, price * p["sl"] / 10_000, far), np.where(ranged, atr * np.maximum(1e-4, p["sl"]), far))
                gain = np.where(bps, np.where(p["tp"] > 0, price * p["tp"] / 10_000, far), np.where(ranged, atr * np.maximum(1e-4, p["tp"]), far))
                # A position without earlier stop is at the price less or plus these on either side.
                sl = np.where(ranged | bps, price - side * down, price * 0.99)
                tp = np.where(ranged | bps, price + side * gain, price * 1.01)
                none = p["targets"] == 0
                sl, tp = np.where(none, np.where(side > 0, -np.inf, np.inf), sl), np.where(none, np.where(side > 0, np.inf, -np.inf), tp)
                both = bps & (p["sl"] <= 0) & (p["tp"] <= 0)
                sl, tp = np.where(both, price * 0.99, sl), np.where(both, price * 1.01, tp)
                for a, v in ((self.entry, price), (self.sl, sl), (self.tp, tp), (self.size, own), (self.at, ms), (self.side, side), (self.bars, 0)):
                    a[enter] = v[enter] if isinstance(v, np.ndarray) else v
                self.open |= enter
        self.bars[self.open] += 1
        return out

    def end(self) -> list[tuple]:
        return self._close(self.open.copy(), np.full(len(self.open), 4), *self.last) if self.last else []


def _simulate(params: list[dict]):
    p = {c.split()[0]: [r[c.split()[0]] for r in params] for c in PARAMS.split(", ")}
    num = lambda c, none: np.array([none if v is None else v for v in p[c]], float)
    sets = {
        "params": np.array(p["params"]), "horizon": num("horizon", np.inf), "hazard_exit": num("hazard_exit", np.inf), "sl": num("sl", 0.0), "tp": num("tp", 0.0),
        "unit": np.array([m == "unit" for m in p["mode"]]), "reverts": np.array([d == "mean_reversion" for d in p["direction"]]), "targets": np.array([{"ATR": 1, "BPS": 2}.get(t, 0) for t in p["targets"]]),
    }
    limits = {c: num(c, 0.0) for c in ("min_rep", "max_hazard", "min_coh", "min_stab", "max_ent")}
    start, stop = num("session_start", np.nan), num("session_end", np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        desk, name = None, None
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in TRADES.split(", ")]
        fields = [x.split()[0] for x in TRADES.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], fields)

        for b in batches:
            v = {c: np.asarray(b[c].cast(pa.float64()).fill_null(np.nan)) for c in ("price", "delta", "atr", "lambda_hazard", "size", "repetition_count", "coherence", "stability", "entropy")}
            ms = np.asarray(b["timestamp_ms"])
            minute = (ms // 60_000) % 1440
            m = minute[:, None]
            inside = np.isnan(start) | np.where(start <= stop, (m >= start) & (m < stop), (m >= start) | (m < stop))
            eligible = inside & (v["repetition_count"][:, None] >= limits["min_rep"]) & (v["lambda_hazard"][:, None] <= limits["max_hazard"]) & (v["coherence"][:, None] >= limits["min_coh"])
            eligible &= (v["stability"][:, None] >= limits["min_stab"]) & (v["entropy"][:, None] <= limits["max_ent"])
            out: list[tuple] = []
            for i, who in enumerate(b["instrument"].to_pylist()):
                if desk is None or who != name:
                    out += desk.end() if desk else []
                    desk, name = Desk(sets), who
                out += desk.row(who, int(ms[i]), float(v["price"][i]), float(v["delta"][i]), float(v["atr"][i]), float(v["lambda_hazard"][i]), float(v["size"][i]), eligible[i])
            yield packed(out)
        if desk:
            yield packed(desk.end())

    return run


def simulate_trades(s: DataFrame, params: DataFrame, *, lookback: int = 1) -> DataFrame:
    """Trades of each (instrument, parameter set).

    s: signals with price, metrics, repetition_count and, for ATR targets, atr. params: a stated table of PARAMS, all of it used; it
    must fit a broadcast (else ValueError). The direction is that of the price against ``lookback`` rows before, or against it
    for 'mean_reversion'; a missing or equal price opens nothing. Mode 'unit' takes size 1, else the throttle's. State runs along
    time, so an instrument's rows pass through one task in order, batch by batch, all parameter sets at once; none is held.
    """
    names = [x.split()[0] for x in PARAMS.split(", ")]
    params = params.select(*names)
    if not fits(params):
        raise ValueError("the parameter sets are too many for one pass; give them in parts")
    sets = [r.asDict() for r in params.collect()]
    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    before = lambda c: F.lag(c).over(w)
    size = throttle(F.col("coherence"), F.col("stability"), F.col("entropy"), F.col("lambda_hazard"), before("coherence"), before("stability"))
    rows = s if "atr" in s.columns else s.withColumn("atr", F.lit(None).cast("double"))
    rows = rows.select("instrument", "timestamp_ms", "price", (F.col("price") - F.lag("price", lookback).over(w)).alias("delta"), "atr", "lambda_hazard", size.alias("size"), "repetition_count", "coherence", "stability", "entropy")
    return rows.repartition("instrument").sortWithinPartitions("instrument", "timestamp_ms").mapInArrow(_simulate(sets), TRADES)


def baselines(s: DataFrame, *, lookback: int = 1) -> DataFrame:
    """(instrument, baseline): mean next return taken in the direction of the last change; flat, first and last rows count as 0."""
    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    delta = F.col("price") - F.lag("price", lookback).over(w)
    side = F.when(F.abs(delta) < 1e-9, 0).when(delta > 0, 1).when(delta < 0, -1).otherwise(0)
    ahead = F.coalesce((F.lead("price").over(w) - F.col("price")) / F.col("price"), F.lit(0.0))
    return s.select("instrument", (side * ahead).alias("b")).groupBy("instrument").agg(F.avg("b").alias("baseline"))


def summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Count, win rate, mean, payoff, Sharpe, Sortino, profit factor, drawdown, Calmar and bars held of returns by key.

    Ratios without a divisor are 0, a profit without loss is an infinite factor. Drawdown runs over the trades in the order of exit.
    """
    r = F.col("ret")
    w = Window.partitionBy(*keys).orderBy("exit_ms", "entry_ms", "instrument").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("_e", F.sum(r).over(w)).withColumn("_d", F.max("_e").over(w) - F.col("_e"))
    win, loss = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0))
    down = F.sqrt(F.avg(F.when(r < 0, r * r)))
    ratio = lambda a, b, least=0.0: F.coalesce(F.when(b > least, a / b), F.lit(0.0))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean_ret"), ratio(F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, -r))).alias("payoff"),
        ratio(F.avg(r) * F.sqrt(n), F.stddev_samp(r)).alias("sharpe"), ratio(F.avg(r) * F.sqrt(n), down, 1e-9).alias("sortino"),
        F.when(loss > 1e-9, win / loss).when(win > 1e-9, float("inf")).otherwise(0.0).alias("profit_factor"),
        F.max("_d").alias("max_drawdown"), ratio(252 * F.avg(r), F.max("_d"), 1e-9).alias("calmar"), F.avg("bars").alias("mean_bars"),
    )


#: Greatest uniform for 0, 1, 2 ... of a Poisson variable of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def poisson_weights(h: np.ndarray, draws: int) -> np.ndarray:
    """A Poisson weight of mean 1 for each row hash and draw: the same for a row wherever it is."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), "right")


def bootstrap(df: DataFrame, key: str, value: str, row: str, draws: int = 200) -> DataFrame:
    """(key, mean, low, high, p): 95 % interval of the mean by Poisson resampling, and the share of means not above 0.

    Each row gets its weights from a hash of key, ``row`` and value, so any partitioning gives the same result and only sums
    meet: no group is collected.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, g in pdf.groupby("k", dropna=False):
                sums, total = np.zeros(draws), np.zeros(draws)
                for lo in range(0, len(g), 4096):
                    w = poisson_weights(g["h"].to_numpy()[lo : lo + 4096].astype(np.int64).view(np.uint64), draws)
                    sums += g["v"].to_numpy(float)[lo : lo + 4096] @ w
                    total += w.sum(0)
                yield pd.DataFrame({"k": k, "draw": np.arange(draws), "s": sums, "w": total})

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), F.xxhash64(key, row, value).alias("h")).where("v is not null")
    means = rows.mapInPandas(run, "k string, draw int, s double, w double").groupBy("k", "draw").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.groupBy("k").agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p")).withColumnRenamed("k", key)


def manifold_coefficients(c: DataFrame, signals: DataFrame) -> DataFrame:
    """(instrument, sigma, lambda): deviation of log returns of neighbouring bars of positive close, and the chance of a rupture within a minute.

    signals: (instrument, timestamp_ms, rupture). Fewer than two returns give sigma 0; lambda is 1 - exp(-60 * sum of rupture / seconds)
    over all signals but the first, 0 with fewer than two.
    """
    w = Window.partitionBy("instrument").orderBy("timestamp_ms")
    prev = F.lag("close").over(w)
    ret = F.when((F.col("close") > 0) & (prev > 0), F.log(F.col("close") / prev))
    sigma = c.select("instrument", ret.alias("r")).groupBy("instrument").agg(F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sigma"))
    passed = (F.col("timestamp_ms") - F.lag("timestamp_ms").over(w)) / 1000
    step = F.when(passed.isNotNull(), F.greatest(F.lit(1e-6), passed))
    rate = signals.select("instrument", step.alias("dt"), "rupture").where("dt is not null").groupBy("instrument").agg((F.sum("rupture") / F.sum("dt") * 60).alias("rate"))
    lam = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp(-F.greatest(F.lit(0.0), F.coalesce("rate", F.lit(0.0))))))
    return sigma.join(rate, "instrument", "left").select("instrument", "sigma", lam.alias("lambda"))
