"""Classifier, calibration and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.session import store


def confusion(pairs: DataFrame) -> DataFrame:
    """(expected, predicted, n)."""
    return pairs.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_class(c: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) of a confusion table; 0 where there is nothing to divide by."""
    c = store(c)
    ap = c.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("ap"), F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    pp = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("pp"))
    j = ap.join(pp, "label", "full").fillna(0, ["ap", "tp", "pp"])
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return j.select("label", share(F.col("tp"), F.col("pp")).alias("precision"), share(F.col("tp"), F.col("ap")).alias("recall"), share(2 * F.col("tp"), F.col("pp") + F.col("ap")).alias("f1"))


def macro_f1(c: DataFrame) -> DataFrame:
    return per_class(c).agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


def calibration(p: DataFrame, bins: int) -> DataFrame:
    """(n, brier, ece) of (prob, label) with equal-width bins."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("prob") * bins))
    g = p.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("conf"), F.avg("label").alias("acc"), F.sum((F.col("prob") - F.col("label")) ** 2).alias("sq"))
    return g.agg(F.sum("n").alias("n"), (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def sweep(p: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, f1) of (prob, y) for stated thresholds, in one pass."""
    counts = []
    for i, t in enumerate(thresholds):
        at = F.col("prob") >= t
        counts += [F.count_if(at & F.col("y")).alias(f"tp{i}"), F.count_if(at & ~F.col("y")).alias(f"fp{i}"), F.count_if(~at & F.col("y")).alias(f"fn{i}")]
    rows = [F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)]
    total = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return p.agg(*counts).select(F.inline(F.array(*rows))).withColumn("f1", F.when(total > 0, 2 * F.col("tp") / total).otherwise(0.0))


def ranking(run: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(n_queries, precision_at, recall_at, mrr, ndcg) of (q, d, rank) against (q, d)."""
    h = run.join(relevant.withColumn("hit", F.lit(True)), ["q", "d"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    n = relevant.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    top = F.col("hit") & (F.col("rank") <= k)
    per = h.groupBy("q").agg(F.count_if(top).alias("k"), F.max(F.when(F.col("hit"), 1 / F.col("rank"))).alias("rr"), F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    j = n.join(per, "q", "left").fillna(0, ["k", "rr", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k).cast("long"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return j.agg(F.count(F.lit(1)).alias("n_queries"), F.avg(F.col("k") / k).alias("precision_at"), F.avg(F.col("k") / F.col("n")).alias("recall_at"), F.avg("rr").alias("mrr"), F.avg(F.col("dcg") / ideal).alias("ndcg"))


