"""Scoring, defaulting, routing and filter expressions over window metrics."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("coherence", "stability", "entropy", "rupture", "lambda_hazard")
# Short names of metrics in filters.
ALIASES = {
    "c": "coherence", "coh": "coherence", "coherence": "coherence", "s": "stability", "stab": "stability", "stability": "stability", "e": "entropy", "ent": "entropy", "entropy": "entropy",
    "r": "rupture", "rup": "rupture", "rupture": "rupture", "lambda": "lambda_hazard", "λ": "lambda_hazard", "haz": "lambda_hazard", "hazard": "lambda_hazard", "lambda_hazard": "lambda_hazard",
    "pattern": "patternability", "patternability": "patternability", "connector": "connector",
}
CLAUSE = re.compile(r"^\s*([A-Za-z_λ]+)\s*(>=|<=|>|<)\s*([Pp]?)([0-9]*\.?[0-9]+)\s*$")


def clean_metric(c: Column, default: float | None = None) -> Column:
    """The value as double, null or NaN replaced by ``default``."""
    v = F.when(~F.isnan(c), c.cast("double"))
    return v if default is None else F.coalesce(v, F.lit(default))


def normalize_signals(signals: DataFrame) -> DataFrame:
    """Signals with flat metrics: missing ones 0, entropy 1; hazard falls back to the metric, then rupture, then 0."""
    m = {k: clean_metric(F.col(f"metrics.{k}")) for k in METRICS}
    lam = F.coalesce(clean_metric(F.col("lambda_hazard")), m["lambda_hazard"], m["rupture"], F.lit(0.0))
    keep = [c for c in signals.columns if c not in ("metrics", "lambda_hazard")]
    flat = [F.coalesce(m[k], F.lit(1.0 if k == "entropy" else 0.0)).alias(k) for k in METRICS[:4]]
    return signals.select(*keep, *flat, lam.alias("lambda_hazard"))


@dataclass(frozen=True)
class Clause:
    """One comparison of a metric with a number or a percentile of that metric."""

    metric: str
    op: str
    value: float
    is_percentile: bool


def parse_filter(text: str) -> dict[str, Clause]:
    """Clauses of a filter such as "coh>=0.8,ent<=P35"; of several for one metric the last holds.

    Raises ValueError on an unknown metric, an operator other than >=, <=, >, < or a percentile above 100.
    """
    out: dict[str, Clause] = {}
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        m = CLAUSE.match(part)
        if not m or m[1].lower() not in ALIASES:
            raise ValueError(f"cannot read the clause {part!r}")
        name, number = ALIASES[m[1].lower()], float(m[4])
        if m[3] and number > 100:
            raise ValueError(f"no such percentile: {part!r}")
        out[name] = Clause(name, m[2], number, bool(m[3]))
    return out


def apply_filter(df: DataFrame, text: str) -> DataFrame:
    """Rows that satisfy every clause; a null or NaN metric satisfies none. Percentiles are exact, interpolated, over ``df``."""
    clauses = parse_filter(text)
    cuts: dict[str, float | None] = {}
    wanted = [c for c in clauses.values() if c.is_percentile]
    if wanted:
        row = df.agg(*(F.percentile(clean_metric(F.col(c.metric)), c.value / 100).alias(c.metric) for c in wanted)).first()
        cuts = {c.metric: row[c.metric] for c in wanted}
    for c in clauses.values():
        bound = cuts[c.metric] if c.is_percentile else c.value
        v = clean_metric(F.col(c.metric))
        ops = {">=": v >= bound, "<=": v <= bound, ">": v > bound, "<": v < bound} if bound is not None else {}
        df = df.where(ops.get(c.op, F.lit(False)))
    return df


def foreground(min_coh: float, max_ent: float, min_stab: float) -> Column:
    return (F.col("coherence") >= min_coh) & (F.col("entropy") <= max_ent) & (F.col("stability") >= min_stab)


def stream_route(path: Column, signal: Column, semantic: Column) -> Column:
    """'deferred' where a dilution passes its limit, else 'foreground'."""
    # Limits of path, signal and semantic dilution.
    late = (F.coalesce(path, F.lit(0.0)) > 0.55) | (F.coalesce(signal, F.lit(0.0)) > 0.60) | (F.coalesce(semantic, F.lit(0.0)) > 0.70)
    return F.when(late, "deferred").otherwise("foreground")


def proposal_score(distance: Column, connector: Column, occurrences: Column) -> Column:
    # Weights of nearness, connector and rarity.
    return 0.55 / (1 + 3 * distance) + 0.30 * connector + 0.15 / (1 + F.log(occurrences + 1))


def throttle(c: Column, s: Column, e: Column, lam: Column, c_before: Column, s_before: Column) -> Column:
    """Position size between 0 and 1: mean of coherence and stability, cut by entropy, hazard and drift from the row before.

    Negative metrics count as 0; a row without one before has no drift.
    """
    up = lambda x: F.greatest(F.lit(0.0), x)
    # The greatest mean and the scale of entropy.
    size = F.least(F.lit(1.5), (up(c) + up(s)) / 2) * (1 - F.least(F.lit(1.0), up(e) / 5)) * (1 - F.least(F.lit(1.0), up(lam)))
    drift = F.when(c_before.isNotNull() & s_before.isNotNull(), F.abs(up(c) - up(c_before)) + F.abs(up(s) - up(s_before))).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), size / (1 + drift)))


def blend(value: Column, nudge: Column, weight: float) -> Column:
    """Linear nudge of a metric, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value + weight * nudge))
