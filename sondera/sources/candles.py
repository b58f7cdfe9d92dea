"""Candles from CSV and JSON under any of their usual column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names under which a column may come, in order of preference.
ALIASES = {
    "timestamp": ["timestamp", "time", "datetime", "date", "t"],
    "open": ["open", "o"],
    "high": ["high", "h"],
    "low": ["low", "l"],
    "close": ["close", "c", "price"],
    "volume": ["volume", "vol", "v", "tick_volume"],
}


def _resolve(columns: list[str], name: str) -> str | None:
    lower = {c.lower(): c for c in columns}
    return next((lower[a] for a in ALIASES[name] if a in lower), None)


def read_candles_csv(spark: SparkSession, path: str, *, tz: str = "UTC", start: str | None = None, end: str | None = None, timestamp_col: str | None = None) -> DataFrame:
    """(timestamp_ms, open, high, low, close, volume) in UTC, both bounds included.

    Local times are read in ``tz``. Rows whose time or prices can't be read are dropped; a missing or
    unreadable volume is 0. Raises ValueError if a column is missing.
    """
    raw = spark.read.csv(path, header=True)
    names = {n: _resolve(raw.columns, n) for n in ALIASES}
    if timestamp_col:
        names["timestamp"] = timestamp_col
    missing = [n for n in ("timestamp", "open", "high", "low", "close") if names[n] is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    text = F.trim(F.col(names["timestamp"]))
    wall = F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "").cast("string"))
    zone = F.regexp_extract(text, r"(Z|[+-]\d\d:?\d\d)$", 1)
    # Wall clocks are turned into epoch numbers without the session's zone.
    local = F.unix_micros(F.from_utc_timestamp(wall, F.current_timezone()))
    shift = F.when(zone.isin("", "Z"), 0).otherwise((F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1))
    in_tz = F.unix_micros(F.from_utc_timestamp(F.to_utc_timestamp(wall, tz), F.current_timezone()))
    number = text.try_cast("double")
    epoch = F.when(number.isNotNull(), F.when(F.abs(number) < 1e11, number * 1000).otherwise(number))
    ms = F.coalesce(epoch, F.when(zone == "", in_tz / 1000).otherwise((local - shift.cast("long") * 60_000_000) / 1000)).cast("long")
    price = lambda n: F.col(names[n]).try_cast("double")
    volume = F.coalesce(price("volume"), F.lit(0.0)) if names["volume"] else F.lit(0.0)
    out = raw.select(ms.alias("timestamp_ms"), *(price(n).alias(n) for n in ("open", "high", "low", "close")), volume.alias("volume")).dropna(subset=["timestamp_ms", "open", "high", "low", "close"])
    for bound, keep in ((start, lambda b: F.col("timestamp_ms") >= b), (end, lambda b: F.col("timestamp_ms") <= b)):
        if bound is not None:
            out = out.where(keep(_epoch_ms(bound)))
    return out


def _epoch_ms(text: str) -> int:
    from datetime import UTC, datetime

    t = datetime.fromisoformat(text)
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1000)


def read_candles_json(spark: SparkSession, path: str) -> DataFrame:
    """Candles of a JSON array, {"candles": [...]} or JSON lines; short names and mid, bid or ask blocks are understood."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    body = F.coalesce(F.get_json_object("v", "$.candles"), F.when(F.col("v").startswith("["), F.col("v")), F.concat(F.lit("["), F.array_join(F.filter(F.split("v", r"\n"), lambda x: F.trim(x) != ""), ","), F.lit("]")))
    item = raw.select(F.explode(F.from_json(body, "array<string>")).alias("j"))
    get = lambda *paths: F.coalesce(*(F.get_json_object("j", f"$.{p}") for p in paths))
    price = lambda long, short: get(long, short, f"mid.{short}", f"bid.{short}", f"ask.{short}").try_cast("double")
    t = get("t", "timestamp", "time")
    n = t.try_cast("double")
    iso = F.unix_micros(F.try_to_timestamp(t)) / 1000
    ms = F.coalesce(F.when(F.abs(n) < 1e11, n * 1000).otherwise(n), iso).cast("long")
    out = item.select(ms.alias("timestamp_ms"), price("open", "o").alias("open"), price("high", "h").alias("high"), price("low", "l").alias("low"), price("close", "c").alias("close"), F.coalesce(get("volume", "v").try_cast("double"), F.lit(0.0)).alias("volume"))
    return out.dropna(subset=["timestamp_ms", "close"])


def time_slice(df: DataFrame, at: str, start: str, stop: str) -> DataFrame:
    """Rows of the half-open stretch [start, stop)."""
    return df.where((F.col(at) >= F.lit(start).cast("timestamp")) & (F.col(at) < F.lit(stop).cast("timestamp")))
