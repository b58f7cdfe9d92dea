"""Column statistics, splits, rankings, small tests and optimisation loops."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.operators import guardrail
from sondera.session import small, store

# Seconds of a granularity code.
GRANULARITY = {"S5": 5, "S10": 10, "S15": 15, "S30": 30, "M1": 60, "M2": 120, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D": 86400}


def granularity_seconds(c: Column) -> Column:
    """Seconds of a granularity code; null for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in GRANULARITY.items() for x in kv)), F.upper(c))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_numeric, mean, sd): a column's non-null values, those that read as numbers, and their mean and deviation."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("string").try_cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.count(v).alias(f"k{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("n_numeric"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def hash_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """``df`` with ``split``: 'test' for that share of keys by the MD5 of key and seed, else 'dev'; rows of one key stay together."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("split", F.when(place < int(share * 10_000), "test").otherwise("dev"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (n): keys in both sides, 0 for disjoint splits."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def smoothed(df: DataFrame, entity: str, order: list[str], value: str, half: int = 2) -> DataFrame:
    """``df`` with ``smooth``: the mean of the centred rows, and ``bit``: that mean rounded half to even."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("smooth", F.avg(value).over(w)).withColumn("bit", F.bround("smooth").cast("int"))


def majority(*bits: Column) -> Column:
    """1 where more than half of the bits are 1; nulls count as 0."""
    total = sum((F.coalesce(b.cast("int"), F.lit(0)) for b in bits), F.lit(0))
    return (total * 2 > len(bits)).cast("int")


def bits_to_prices(df: DataFrame, entity: str, order: list[str], bit: str, *, start: float = 100.0, step: float = 0.1) -> DataFrame:
    """``df`` with ``price``: a walk that rises by ``step`` for a 1 and falls for a 0."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("price", start + F.sum(F.when(F.col(bit) == 1, step).otherwise(-step)).over(w))


def nearest_in_time(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the row of ``right`` nearest in time, the earlier of two as near; one sort of both sides."""
    r = right.select(F.col(by).alias("_by"), F.col(at).alias("_t"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("_r"), F.lit(0).alias("_s"))
    cols = [F.col(c) for c in left.columns]
    u = left.select(F.col(by).alias("_by"), F.col(at).alias("_t"), F.lit(None).cast(dict(r.dtypes)["_r"]).alias("_r"), F.lit(1).alias("_s"), F.struct(*cols).alias("_l"))
    u = u.unionByName(r.withColumn("_l", F.lit(None).cast(dict(u.dtypes)["_l"])))
    up = Window.partitionBy("_by").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_by").orderBy(F.desc("_t"), F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_p", F.last("_r", ignorenulls=True).over(up)).withColumn("_n", F.last("_r", ignorenulls=True).over(down)).where("_s = 1")
    pick = F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull() | (F.col("_t") - F.col("_p.t") <= F.col("_n.t") - F.col("_t")), F.col("_p.v")).otherwise(F.col("_n.v"))
    return u.withColumn(value, pick).select("_l.*", value)


def bridge_ranking(df: DataFrame, key: str, structural: str, semantic: str, k: int) -> DataFrame:
    """(ranking, rank, key): the first k by structure, by meaning and by the mean of both; ties by key."""
    parts = None
    for name, score in (("structural", F.col(structural)), ("semantic", F.col(semantic)), ("combined", 0.5 * F.col(structural) + 0.5 * F.col(semantic))):
        # A limit keeps k rows of each task before the single sorted list.
        top = df.select(F.lit(name).alias("ranking"), F.round(score, 6).alias("score"), key).orderBy(F.desc("score"), key).limit(k)
        parts = top if parts is None else parts.unionByName(top)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("ranking").orderBy(F.desc("score"), key))).select("ranking", "rank", key)


def evidence(df: DataFrame, entity: str, order: list[str], score: str, first: int, top: int) -> DataFrame:
    """Rows that are among the first ``first`` of their entity or its ``top`` highest scores."""
    a = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    b = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(score), *order))
    return df.withColumn("_a", a).withColumn("_b", b).where((F.col("_a") <= first) | (F.col("_b") <= top)).drop("_a", "_b")


def decisive(path: Column, signal: Column) -> Column:
    """Whether a window decides: little dilution of path and signal."""
    return (path < 0.3) & (signal < 0.4)


def hashed_margin(vectors: DataFrame, factual: DataFrame, novelty: DataFrame, key: str) -> DataFrame:
    """(key, margin): dot product of sparse vectors (key, dim, value) with the factual centroid less that with the novelty one."""
    d = factual.select("dim", F.col("value").alias("w")).unionByName(novelty.select("dim", (-F.col("value")).alias("w"))).groupBy("dim").agg(F.sum("w").alias("w"))
    return vectors.join(small(d), "dim", "left").groupBy(key).agg(F.coalesce(F.sum(F.col("value") * F.col("w")), F.lit(0.0)).alias("margin"))


def centroid(vectors: DataFrame, n: int) -> DataFrame:
    """(dim, value): mean of n sparse vectors."""
    return vectors.groupBy("dim").agg((F.sum("value") / F.lit(max(1, n))).alias("value"))


def doc_uri(c: Column) -> Column:
    """A document's address from its name: lower case, every run of other characters one hyphen."""
    return F.concat(F.lit("doc://"), F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", ""))


def keyword_filter(twins: DataFrame, tokens: str, keywords: list[str]) -> DataFrame:
    """Twins that hold a keyword in some token, and a headline of their first five tokens in order."""
    wanted = F.array(*(F.lit(k.lower()) for k in keywords))
    hit = F.exists(tokens, lambda t: F.exists(wanted, lambda k: F.lower(t).contains(k)))
    return twins.where(hit).withColumn("headline", F.array_join(F.slice(F.array_sort(tokens), 1, 5), ", "))


def supporting(evidence_rows: DataFrame, uris: str, gold: str) -> DataFrame:
    """Evidence that cites one of the gold addresses."""
    return evidence_rows.where(F.arrays_overlap(uris, gold))


def trace_summary(steps: DataFrame, task: str, variant: str, order: list[str], passed: Column) -> DataFrame:
    """(task, variant, n_steps, n_passed, first_pass, n_regressions): steps of each run, when it first passed and how often it fell back."""
    w = Window.partitionBy(task, variant).orderBy(*order)
    p = F.coalesce(passed, F.lit(False))
    rows = steps.withColumn("_i", F.row_number().over(w)).withColumn("_p", p).withColumn("_fall", F.lag(p).over(w) & ~p)
    return rows.groupBy(task, variant).agg(F.count(F.lit(1)).alias("n_steps"), F.count_if("_p").alias("n_passed"), F.min(F.when(F.col("_p"), F.col("_i"))).alias("first_pass"), F.count_if("_fall").alias("n_regressions"))


def optimise_coverage(df: DataFrame, grid: DataFrame, targets: list[float], p_value: Callable[[dict], float], *, band: float = 0.02, alpha: float = 0.05) -> dict | None:
    """The first target whose chosen thresholds have p at most ``alpha``, else the one of least p.

    The grid is counted once; each target is a choice over its counts, and ``p_value`` tests it.
    """
    counted = [r.asDict() for r in guardrail.coverage_grid(df, grid).collect()]  # one row a config of the stated grid
    best = None
    for t in targets:
        def miss(r: dict, t: float = t) -> tuple:
            c = r["covered"] / r["n"]
            inside = t - band <= c <= t + band
            return (not inside, 0.0 if inside else min(abs(c - t + band), abs(c - t - band)), c, r["config"])

        if not counted:
            return None
        row = min(counted, key=miss)
        row = row | {"target": t, "coverage": row["covered"] / row["n"], "p": p_value(row)}
        if row["p"] <= alpha:
            return row
        if best is None or row["p"] < best["p"]:
            best = row
    return best


#: Rows of one range of a value in kendall.
RANGE = 200_000


def signed_pairs(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs in the same order less pairs in opposite order, by merging sorted halves; ties in either count as 0."""
    order = np.lexsort((y, x))
    x, y = x[order], np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    n, big = len(x), len(x) + 1
    here, out, width = np.arange(n), 0, 1
    while width < n:
        pair, right = here // (2 * width), (here // width) % 2 == 1
        keys = np.sort(pair[~right] * big + y[~right])
        p, q = pair[right] * big, pair[right] * big + y[right]
        less = np.searchsorted(keys, q, "left") - np.searchsorted(keys, p, "left")
        more = np.searchsorted(keys, p + big, "left") - np.searchsorted(keys, q, "right")
        out += int(less.sum()) - int(more.sum())
        width *= 2
    # Rows of equal x stand in the order of y: their pairs of other y were counted as in order.
    pairs = lambda *c: sum(int(k) * (int(k) - 1) // 2 for k in np.diff(np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in c], axis=0), True])))
    return out - pairs(x) + pairs(x, y) if n else 0


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, tau): Kendall's tau-b of all rows where neither value is null or NaN, exactly.

    Both values are cut into ranges of about RANGE rows; a frequent value is a range of its own. Pairs within a
    range of a are counted there, pairs of other ranges of a but one range of b there, and all others from
    the counts of both ranges, so no pair of rows is formed and no task holds more than a range.
    """
    value = lambda c: F.col(c).cast("double") + F.lit(0.0)
    rows = store(df.select(value(a).alias("x"), value(b).alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)"))
    n = rows.count()
    parts = max(1, math.ceil(n / RANGE))
    at = [i / parts for i in range(1, parts)]
    edges = [sorted(set(e)) for e in rows.approxQuantile(["x", "y"], at, 0.1 / parts)] if n and at else [[], []]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.asarray(batch[c]) for c in ("x", "y"))
            p, q = (np.searchsorted(e, v, "left") + np.searchsorted(e, v, "right") for e, v in zip(edges, (x, y), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x, y, p.astype(np.int64), q.astype(np.int64))], ["x", "y", "p", "q"])

    placed = store(rows.mapInArrow(place, "x double, y double, p long, q long"))

    def signed(c: str, d: str):
        return lambda t: pa.table({"s": [signed_pairs(np.asarray(t[c].combine_chunks()), np.asarray(t[d].combine_chunks()))]})

    def grid(t: pa.Table) -> pa.Table:
        p, q, k = (np.asarray(t[c].combine_chunks()) for c in ("p", "q", "k"))
        low, out = np.zeros(2 * parts + 1, np.int64), 0
        for i in np.unique(p):
            m = p == i
            own = np.zeros_like(low)
            own[q[m]] = k[m]
            below = np.r_[0, np.cumsum(low)[:-1]]
            above = low.sum() - below - low
            out += sum(int(w) * (int(u) - int(v)) for w, u, v in zip(own, below, above, strict=True))
            low = low + own
        return pa.table({"s": [out]})

    # In a range of one value every pair is a tie; odd ranges are the edges themselves.
    within = placed.where("p % 2 = 0").groupBy("p").applyInArrow(signed("x", "y"), "s long")
    across = placed.where("q % 2 = 0").select("p", "q", "y").groupBy("q").applyInArrow(signed("p", "y"), "s long")
    counts = placed.groupBy("p", "q").agg(F.count(F.lit(1)).alias("k")).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(grid, "s long")
    ties = lambda c, name: rows.groupBy(c).agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum((F.col("t") * (F.col("t") - 1) / 2).cast("long")), F.lit(0)).alias(name))
    one = within.unionByName(across).unionByName(counts).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s")).join(ties("x", "tx")).join(ties("y", "ty"))
    all_ = F.lit(n * (n - 1) // 2).cast("double")
    under = F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty")))
    return one.select(F.lit(n).cast("long").alias("n"), F.when(under > 0, F.col("s") / under).alias("tau"))
