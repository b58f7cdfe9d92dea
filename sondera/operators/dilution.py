"""Dilution: how spread the continuations and contents of signatures are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy_of_counts(counts: Column, total: Column) -> Column:
    """A term -p log2 p of an entropy."""
    p = counts / total
    return -p * F.log2(p)


def path_dilution(events: DataFrame, entity: str, order: list[str], signature: str) -> DataFrame:
    """(signature, n_next, total, path): normalised entropy of what follows each signature within an entity.

    0 where at most one signature follows. One shuffle by entity for the successor; counts pre-aggregate.
    """
    nxt = F.lead(signature).over(Window.partitionBy(entity).orderBy(*order))
    pairs = events.select(F.col(signature).alias("signature"), nxt.alias("next")).where("signature is not null and next is not null").groupBy("signature", "next").agg(F.count(F.lit(1)).alias("n"))
    # Sum of n log2 n suffices: H = log2 T - (sum n log2 n) / T.
    agg = pairs.groupBy("signature").agg(F.count(F.lit(1)).alias("n_next"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    h = F.log2("total") - F.col("nl") / F.col("total")
    path = F.when(F.col("n_next") > 1, h / F.log2("n_next")).otherwise(0.0)
    return agg.select("signature", "n_next", "total", path.alias("path"))


def signal_dilution(pairs: DataFrame, window: str, token: str, *, weighted: bool = False) -> DataFrame:
    """(window, n_tokens, signal): normalised entropy of the tokens of a window; unweighted, a token counts once a window."""
    counts = pairs.where(F.col(window).isNotNull() & F.col(token).isNotNull()).groupBy(F.col(window).alias("window"), F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("k"))
    n = F.col("k") if weighted else F.lit(1)
    agg = counts.groupBy("window").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(n).alias("total"), F.sum(n * F.log2(n)).alias("nl"))
    h = F.log2("total") - F.col("nl") / F.col("total")
    return agg.select("window", "n_tokens", F.when(F.col("n_tokens") > 1, h / F.log2("n_tokens")).otherwise(0.0).alias("signal"))


def semantic_dilution(pairs: DataFrame, signature: str, token: str) -> DataFrame:
    """One row (n, mutual_information, h_signature, h_token, semantic): 1 - MI / min(H, H); 1 where either entropy is 0."""
    joint = pairs.where(F.col(signature).isNotNull() & F.col(token).isNotNull()).groupBy(F.col(signature).alias("s"), F.col(token).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    part = lambda keys, name: joint.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias(name))
    # Each is one row: MI = H(s) + H(t) - H(s, t) from sums of n log2 n.
    rows = part(["s"], "ns").join(part(["t"], "nt").select("nt")).join(part(["s", "t"], "nst").select("nst"))
    h = lambda c: F.log2("total") - F.col(c) / F.col("total")
    out = rows.select(F.coalesce("total", F.lit(0)).alias("n"), h("ns").alias("h_signature"), h("nt").alias("h_token"), h("nst").alias("hj"))
    mi = F.greatest(F.lit(0.0), F.col("h_signature") + F.col("h_token") - F.col("hj"))
    least = F.least("h_signature", "h_token")
    share = F.when(least > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mi / least))).otherwise(1.0)
    return out.select("n", mi.alias("mutual_information"), "h_signature", "h_token", share.alias("semantic"))
