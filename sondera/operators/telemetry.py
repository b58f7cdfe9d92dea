"""Telemetry channels: rolling statistics, differences, structure bits, resampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.operators.market import micros
from sondera.operators.prefix import place_in_group


#: Rows of a channel that one task smooths.
STRETCH = 20_000


def rolling(values: np.ndarray, half: int, mean: int) -> tuple[np.ndarray, np.ndarray]:
    """Median over 2 * half + 1 centred rows and deviation over 2 * mean + 1, fewer at the ends; NaN values are left out.

    The median of an even number is the mean of the middle two. Fewer than two values deviate by 0.
    """
    n = len(values)
    view = lambda m: np.lib.stride_tricks.sliding_window_view(np.r_[np.full(m, np.nan), values, np.full(m, np.nan)], 2 * m + 1)
    med, sd = np.full(n, np.nan), np.zeros(n)
    for lo in range(0, n, 4096):
        w = np.sort(view(half)[lo : lo + 4096], axis=1)
        k = (~np.isnan(w)).sum(1)
        row = np.arange(len(w))
        med[lo : lo + 4096] = np.where(k > 0, (w[row, np.maximum(0, (k - 1) // 2)] + w[row, np.minimum(k // 2, 2 * half)]) / 2, np.nan)
    ok = ~np.isnan(values)
    x = np.where(ok, values - (values[ok].mean() if ok.any() else 0), 0)
    sums = [np.r_[0, np.cumsum(c)] for c in (ok, x, x * x)]
    lo, hi = np.maximum(0, np.arange(n) - mean), np.minimum(n, np.arange(n) + mean + 1)
    c, a, b = (s[hi] - s[lo] for s in sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = np.where(c > 1, np.sqrt(np.maximum(0, (b - a * a / c) / (c - 1))), 0.0)
    return med, sd


def difference(v: np.ndarray) -> np.ndarray:
    """Change from the row before, 0 for the first."""
    return np.diff(v, prepend=v[:1])


def structure_bits(df: DataFrame, channel: str, order: list[str], value: str, *, half_median: int = 30, half_deviation: int = 150) -> DataFrame:
    """Rows with d1, d2, med, dev and z, the bits up, accel, rangeexp and zpos and their tokens.

    up: the value rose; accel: the change grew; rangeexp: the distance from the rolling median grew; z: that signed distance over
    the rolling deviation, 0 where the values don't deviate; zpos: z is positive. Null and NaN values are no part of a window,
    have null numbers and no bits.

    A channel is cut into stretches of STRETCH rows that share the rows around their edges, so a channel of any
    length spans many tasks.
    """
    halo = max(half_median, half_deviation) + 2
    kinds = dict(df.dtypes)
    numbered = place_in_group(df.withColumn("_v", F.col(value).cast("double")), channel, order, "_at").withColumn("_own", F.floor(F.col("_at") / STRETCH))
    around = F.sequence(F.floor(F.greatest(F.col("_at") - halo, F.lit(0)) / STRETCH), F.floor((F.col("_at") + halo) / STRETCH))
    rows = numbered.withColumn("_stretch", F.explode(around))
    numbers, bits = ["d1", "d2", "med", "dev", "z"], ["up", "accel", "rangeexp", "zpos"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), *(f"{c} double" for c in numbers), *(f"{c} boolean" for c in bits)])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_at").combine_chunks()
        v = np.asarray(t["_v"].cast(pa.float64()).fill_null(np.nan)).astype(float)
        med, sd = rolling(v, half_median, half_deviation)
        d1 = difference(v)
        # The first row of all has no change; of a stretch's first rows only those of others are cut off.
        with np.errstate(divide="ignore", invalid="ignore"):
            dev = np.abs(v - med)
            z = np.where(sd > 0, (v - med) / np.where(sd > 0, sd, 1), np.where(np.isnan(v), np.nan, 0.0))
            d2 = difference(d1)
            flags = {"up": d1 > 0, "accel": d2 > 0, "rangeexp": difference(dev) > 0, "zpos": z > 0}
        own = pa.array(np.asarray(t["_own"]) == np.asarray(t["_stretch"]))
        null = lambda x: pa.array(x, mask=np.isnan(x))
        cols = {**{c: t[c] for c in kinds}, "d1": null(d1), "d2": null(d2), "med": null(med), "dev": null(dev), "z": null(z), **{c: pa.array(f) for c, f in flags.items()}}
        return pa.table(cols).filter(own)

    out = rows.groupBy(channel, "_stretch").applyInArrow(run, schema)
    return out.withColumn("tokens", F.concat_ws(" ", *(F.when(F.col(k), F.upper(F.lit(k))) for k in bits)))


def resample(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int, how: str = "mean") -> DataFrame:
    """Mean or median of each bucket of ``seconds`` from the epoch, with its start in seconds."""
    b = (F.floor(micros(ts) / 1_000_000 / seconds) * seconds).cast("long")
    agg = F.avg(value) if how == "mean" else F.percentile(value, 0.5)
    return df.groupBy(*keys, b.alias("bucket")).agg(agg.alias(value))


def fill_forward(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def interpolate(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Missing values replaced on the line between their neighbours in time; outer ones stay null."""
    w = Window.partitionBy(*keys).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    p = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_p", p).withColumn("_n", n)
    t = (F.col(at) - F.col("_p.t")) / F.nullif(F.col("_n.t") - F.col("_p.t"), F.lit(0.0))
    return rows.withColumn(value, F.coalesce(F.col(value).cast("double"), F.col("_p.v") + t * (F.col("_n.v") - F.col("_p.v")))).drop("_p", "_n")
