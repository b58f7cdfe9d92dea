"""Threshold calibration, exact significance, lead times, onsets and alignment."""

from __future__ import annotations

import math
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.session import small


def quantile_grid(df: DataFrame, steps: dict[str, list[float]]) -> dict[str, list[float]]:
    """Exact interpolated quantiles of each column, all in one pass."""
    row = df.agg(*(F.percentile(c, F.array(*(F.lit(q) for q in qs))).alias(c) for c, qs in steps.items())).first()
    return {c: sorted({round(v, 12) for v in (row[c] or [])}) for c in steps}


def threshold_grid(spark: SparkSession, coh: list[float], ent: list[float], stab: list[float]) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(product(coh, ent, stab))]
    return spark.createDataFrame(rows, "config int, min_coh double, max_ent double, min_stab double")


def coverage_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """(config, thresholds, n, covered): rows that pass each threshold triple.

    The grid is a stated, bounded set; every row meets it after ranks are pre-counted: rows are first
    reduced to counts by which thresholds they pass, so the product runs over distinct lattice cells.
    """
    lists = grid.agg(F.sort_array(F.collect_set("min_coh")).alias("c"), F.sort_array(F.collect_set("max_ent")).alias("e"), F.sort_array(F.collect_set("min_stab")).alias("s")).first()
    # Place of a row among the thresholds of each metric; a null metric passes none.
    at_least = lambda v, cuts: F.coalesce(sum((v >= x).cast("int") for x in cuts), F.lit(0)) if cuts else F.lit(0)
    at_most = lambda v, cuts: F.coalesce(sum((v <= x).cast("int") for x in cuts), F.lit(0)) if cuts else F.lit(0)
    cells = df.select(at_least(F.col("coherence"), lists.c).alias("ci"), at_most(F.col("entropy"), lists.e).alias("ei"), at_least(F.col("stability"), lists.s).alias("si")).groupBy("ci", "ei", "si").agg(F.count(F.lit(1)).alias("n"))
    place = lambda c, cuts: F.array_position(F.array(*(F.lit(x) for x in cuts)), F.col(c)).cast("int")
    g = grid.select("*", place("min_coh", lists.c).alias("cp"), (F.lit(len(lists.e) + 1) - place("max_ent", lists.e)).alias("ep"), place("min_stab", lists.s).alias("sp"))
    passed = (F.col("ci") >= F.col("cp")) & (F.col("ei") >= F.col("ep")) & (F.col("si") >= F.col("sp"))
    return cells.join(small(g)).groupBy("config", "min_coh", "max_ent", "min_stab").agg(F.sum("n").alias("n"), F.sum(F.when(passed, F.col("n")).otherwise(0)).alias("covered"))


def choose_thresholds(covered: DataFrame, low: float, high: float) -> DataFrame:
    """The config of least coverage inside the band, else the nearest to it and then the least; ties by config."""
    cov = F.col("covered") / F.col("n")
    inside = cov.between(low, high)
    miss = F.least(F.abs(cov - low), F.abs(cov - high))
    ranked = covered.withColumn("coverage", cov).withColumn("inside", inside).withColumn("_m", F.when(inside, 0.0).otherwise(miss))
    return ranked.orderBy(F.desc("inside"), "_m", "coverage", "config").limit(1).drop("_m")


def exact_permutation_p(n: int, k: int, m: int) -> float:
    if m <= 0 or k <= 0:
        return 0.0
    return 1.0 - math.comb(n - m, k) / math.comb(n, k)


def onsets(rows: DataFrame, entity: str, order: list[str], key: str, rule: Column, streak: int) -> DataFrame:
    """(entity, onset, emitted): each time ``rule`` has held for ``streak`` rows on end; counting starts afresh after each.

    Gaps and islands: the row number within an island of true rows; every multiple of the streak emits.
    """
    w = Window.partitionBy(entity).orderBy(*order)
    flag = F.coalesce(rule, F.lit(False))
    marked = rows.select(F.col(entity).alias("entity"), *order, F.col(key).alias("key"), flag.alias("ok"))
    w = Window.partitionBy("entity").orderBy(*order)
    isl = marked.withColumn("grp", F.sum((~F.col("ok")).cast("int")).over(w)).withColumn("first", F.lag("key", streak - 1).over(w)).where("ok")
    pos = F.row_number().over(Window.partitionBy("entity", "grp").orderBy(*order))
    return isl.withColumn("pos", pos).where(F.col("pos") % streak == 0).select("entity", F.col("first").alias("onset"), F.col("key").alias("emitted"))


def alert_leads(rows: DataFrame, entity: str, at: str, alert: Column, failure: Column) -> DataFrame:
    """(entity, n, n_alerts, first_alert, failure, lead): the first alert, the first failure and the steps between."""
    g = rows.groupBy(F.col(entity).alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(alert).alias("n_alerts"), F.min(F.when(alert, F.col(at))).alias("first_alert"), F.min(F.when(failure, F.col(at))).alias("failure")
    )
    return g.withColumn("lead", F.when(F.col("first_alert") <= F.col("failure"), F.col("failure") - F.col("first_alert")))


def lead_times(alerts: DataFrame, failures: DataFrame, entity: str, at: str) -> DataFrame:
    """(entity, failure, alert, lead): for each failure the last alert not after it, else the next one (negative lead).

    One shuffle: alerts and failures are united and read off by running last and coming first values.
    """
    a = alerts.select(F.col(entity).alias("entity"), F.col(at).alias("t"), F.lit(0).alias("kind")).distinct()
    f = failures.select(F.col(entity).alias("entity"), F.col(at).alias("t"), F.lit(1).alias("kind")).distinct()
    w = Window.partitionBy("entity").orderBy("t", "kind")
    is_alert = F.when(F.col("kind") == 0, F.col("t"))
    before = F.last(is_alert, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy("entity").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    after = F.last(is_alert, ignorenulls=True).over(down)
    both = a.unionByName(f).withColumn("alert", F.coalesce(before, after))
    return both.where("kind = 1").select("entity", F.col("t").alias("failure"), "alert", (F.col("t") - F.col("alert")).alias("lead"))


def _match(tolerance: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, want, used, hit = sorted(left["t"].dropna()), sorted(right["t"].dropna()), set(), 0
        for x in found:
            best = min((y for y in want if y not in used and abs(y - x) <= tolerance), key=lambda y: (abs(y - x), y), default=None)
            if best is not None:
                used.add(best)
                hit += 1
        p, r = hit / len(found) if found else 0.0, hit / len(want) if want else 0.0
        return pd.DataFrame([(key[0], len(found), len(want), hit, p, r, 2 * p * r / (p + r) if p + r else 0.0)], columns=["entity", "n_alerts", "n_failures", "matched", "precision", "recall", "f1"])

    return run


def greedy_alignment(alerts: DataFrame, failures: DataFrame, entity: str, at: str, tolerance: int) -> DataFrame:
    """Greedy one-to-one matching of alerts to failures within a tolerance, per entity.

    Each alert in order takes the nearest free failure, the earlier of two as near. Sequential by
    definition, so it runs as one grouped function a trace; only distinct times reach it.
    """
    side = lambda d: d.select(F.col(entity).alias("entity"), F.col(at).cast("long").alias("t")).distinct()
    schema = "entity string, n_alerts long, n_failures long, matched long, precision double, recall double, f1 double"
    return side(alerts).groupBy("entity").cogroup(side(failures).groupBy("entity")).applyInPandas(_match(tolerance), schema)


def density_bins(alerts: DataFrame, onset: Column, at: str, width: int, bins: int) -> DataFrame:
    """(entity, bin, n, density): share of flagged rows in each of the ``bins`` stretches before an onset, bin 0 the last.

    alerts: (entity, onset, at, flag).
    """
    b = F.floor((onset - F.col(at) - 1) / width).cast("int")
    rows = alerts.where((F.col(at) < onset) & (F.col(at) >= onset - width * bins)).withColumn("bin", b)
    return rows.groupBy("entity", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("flag").cast("double")).alias("density"))


def rule_scores(rows: DataFrame, entity: str, order: list[str], *, min_coh: float, max_ent: float, min_stab: float, delta: float = 5e-4) -> DataFrame:
    """``rows`` with guard, ramp, drop and confidence.

    guard: the thresholds hold; ramp: coherence rose by ``delta`` since the row before; drop: entropy fell by it. Confidence adds up
    what holds.
    """
    w = Window.partitionBy(entity).orderBy(*order)
    guard = (F.col("coherence") >= min_coh) & (F.col("entropy") <= max_ent) & (F.col("stability") >= min_stab)
    ramp = F.coalesce(F.col("coherence") >= F.lag("coherence").over(w) + delta, F.lit(False))
    drop = F.coalesce(F.col("entropy") <= F.lag("entropy").over(w) - delta, F.lit(False))
    # Scores of the rules.
    confidence = guard.cast("int") * 0.6 + ramp.cast("int") * 0.2 + drop.cast("int") * 0.2
    return rows.withColumns({"guard": guard, "ramp": ramp, "drop": drop, "confidence": confidence})


# Margin above the baseline and ceiling of each calibrated metric.
PADDING = {"lambda_hazard": (0.0015, 0.95), "path": (0.05, 1.2), "signal": (0.01, None)}


def calibrated_alerts(rows: DataFrame, entity: str, step: str, event: Column, failure: Column, metrics: dict[str, tuple[float, float | None]] | None = None) -> DataFrame:
    """(entity, threshold_*, mean_*, n_alerts, first_alert, first_failure, lead) with thresholds from each entity's rows up to its event.

    A threshold is the greatest baseline value plus a margin, at most a ceiling; a row that reaches one of them alerts. An entity
    without baseline has 0 as its greatest and mean. Lead is not negative. One group and one join by entity.
    """
    metrics = metrics or PADDING
    base = F.col(step) <= event
    agg = []
    for m, (pad, top) in metrics.items():
        t = F.coalesce(F.max(F.when(base, F.col(m))), F.lit(0.0)) + pad
        agg += [(t if top is None else F.least(t, F.lit(top))).alias(f"threshold_{m}"), F.coalesce(F.avg(F.when(base, F.col(m))), F.lit(0.0)).alias(f"mean_{m}")]
    cuts = rows.groupBy(entity).agg(*agg)
    over = F.lit(False)
    for m in metrics:
        over = over | F.coalesce(F.col(m) >= F.col(f"threshold_{m}"), F.lit(False))
    names = [f"{k}_{m}" for m in metrics for k in ("threshold", "mean")]
    out = rows.join(cuts, entity).groupBy(entity, *names).agg(F.count_if(over).alias("n_alerts"), F.min(F.when(over, F.col(step))).alias("first_alert"), F.min(F.when(failure, F.col(step))).alias("first_failure"))
    gap = F.col("first_failure") - F.col("first_alert")
    return out.withColumn("lead", F.when(gap.isNotNull(), F.greatest(F.lit(0), gap)))


def offsets(n: int, jitter: int) -> list[int]:
    """n offsets spread over [-jitter, jitter], by a fixed rule."""
    return [(i * 7919) % (2 * jitter + 1) - jitter for i in range(1, n + 1)]


def jitter_p(rows: DataFrame, entity: str, at: str, onset: str, flag: str, *, lookback: int, moves: list[int]) -> DataFrame:
    """(entity, observed, p): share of flagged rows in the stretch before the onset, and how often a moved onset has as much.

    rows carry their entity's onset. p is (1 + moves with at least the observed share) / (1 + moves); an empty stretch has share 0. Rows
    beyond the reach of all moves are dropped before they are repeated.
    """
    far = max(map(abs, moves), default=0)
    near = rows.where((F.col(at) >= F.col(onset) - lookback - far) & (F.col(at) < F.col(onset) + far))
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in enumerate([0, *moves]))))
    r = near.select(F.col(entity).alias("entity"), F.col(at).alias("t"), F.col(onset).alias("o"), F.col(flag).cast("int").alias("f"), every.alias("j"))
    hit = r.where((F.col("t") >= F.col("o") + F.col("j.m") - lookback) & (F.col("t") < F.col("o") + F.col("j.m"))).groupBy("entity", F.col("j.i").alias("i")).agg(F.avg("f").alias("d"))
    observed = rows.select(F.col(entity).alias("entity")).distinct().join(hit.where("i = 0").select("entity", "d"), "entity", "left").select("entity", F.coalesce("d", F.lit(0.0)).alias("observed"))
    above = observed.join(hit.where("i > 0"), "entity", "left").groupBy("entity", "observed").agg(F.count_if(F.col("d") >= F.col("observed")).alias("k"), F.count("d").alias("held"))
    # Moves that meet no row have share 0.
    zero = F.when(F.col("observed") <= 0, len(moves) - F.col("held")).otherwise(0)
    return above.select("entity", "observed", ((F.col("k") + zero + 1) / (len(moves) + 1)).alias("p"))
