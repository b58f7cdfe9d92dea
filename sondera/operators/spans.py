"""Span inventories: aggregates, contexts, blocked near-duplicates, membership and gating."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondera.functions.text import collapse_blanks
from sondera.session import meet_in_blocks, small, store


def normalise(c: Column) -> Column:
    return collapse_blanks(F.lower(c))


def span_id(c: Column) -> Column:
    """128-bit identity of a normalised span."""
    return F.md5(normalise(c).cast("binary"))


def explode_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name, n) of a map of counts."""
    return df.select(key, F.explode(column).alias("name", "n")).where("n is not null")


def to_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, counts map) of (key, name, n), names in order."""
    per = rows.groupBy(key, "name").agg(F.sum("n").alias("n"))
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("counts"))


def context_topk(df: DataFrame, key: str, contexts: str, k: int = 64) -> DataFrame:
    """(key, rank, text, count): the k contexts of each span by count, then text, both descending."""
    rows = df.select(key, F.inline(contexts))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), F.desc("text")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "text", "count")


def char_qgrams(c: Column, q: int = 3) -> Column:
    """Distinct q-grams of the text padded by q - 1 marks on both sides."""
    pad = F.lit("#" * (q - 1))
    s = F.concat(pad, c, pad)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (q - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(q))))


def near_duplicates(queries: DataFrame, base: DataFrame, *, key: str, text: str, k: int = 5, slack: int = 3, q: int = 3) -> DataFrame:
    """(query, rank, match, distance, overlap): spans that share a block with the query and nearly its length.

    Blocks are the first six characters, the last six and the first word, each with the length: a query asks for the
    lengths within ``slack``, so the union of equi-joins forms no other pair, and a block of many spans is paired block by block. A
    query whose blocks hold nothing, not even its own text, looks at all spans of such lengths instead, and if there are none at all
    spans. Ranked by q-gram overlap, then edit distance, then key; a span is no match of its own key. Null texts are left out.
    """
    t = F.col(text)
    blocks = F.array_distinct(F.array(F.concat(F.lit("p:"), F.substring(t, 1, 6)), F.concat(F.lit("s:"), F.right(t, F.lit(6))), F.concat(F.lit("w:"), F.substring_index(t, " ", 1))))
    side = lambda d, p: d.where(t.isNotNull()).select(F.col(key).alias(f"{p}k"), t.alias(f"{p}t"), F.length(t).alias("n"), blocks.alias("blocks"))
    near = lambda d: d.withColumn("n", F.explode(F.sequence(F.col("n") - slack, F.col("n") + slack)))
    ask, have = store(side(queries, "q")), store(side(base, "b"))
    in_block = lambda d: d.withColumn("block", F.explode("blocks")).drop("blocks")
    pair = ["qk", "qt", "bk", "bt"]
    first = store(meet_in_blocks(store(in_block(near(ask))), store(in_block(have)), ["block", "n"]).select(*pair).distinct())
    alone = store(ask.join(first.select("qk").distinct(), "qk", "left_anti"))
    found = first
    if alone.limit(1).count():
        second = store(meet_in_blocks(store(near(alone).drop("blocks")), have.drop("blocks"), ["n"]).select(*pair))
        last = alone.join(second.select("qk").distinct(), "qk", "left_anti").select("qk", "qt", F.lit(0).alias("all"))
        found = found.unionByName(second).unionByName(meet_in_blocks(store(last), have.select("bk", "bt", F.lit(0).alias("all")), ["all"]).select(*pair))
    cand = found.where(F.col("qk") != F.col("bk"))
    a, b = char_qgrams(F.col("qt"), q), char_qgrams(F.col("bt"), q)
    both = F.size(F.array_intersect(a, b))
    overlap = both / (F.size(a) + F.size(b) - both)
    s = cand.select(F.col("qk").alias("query"), F.col("bk").alias("match"), F.levenshtein("qt", "bt").alias("distance"), F.round(overlap, 6).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("overlap"), "distance", "match"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "match", "distance", "overlap")


def gate(spans: DataFrame, members: DataFrame, key: str, *, r_min: int = 1, lam: float = 0.55, sigma: float = 0.15, c_min: float = 0.0) -> DataFrame:
    """Spans with the member's figures and the four tests; a span without a member is blocked with entropy and hazard 1.

    members: (key, repetitions, lambda_hazard, semantic, coherence, entropy), one row a key.
    """
    j = spans.join(members, key, "left")
    d = {"repetitions": 0, "lambda_hazard": 1.0, "semantic": 0.0, "coherence": 0.0, "entropy": 1.0}
    for c, v in d.items():
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    tests = {"repeat_ok": F.col("repetitions") >= r_min, "hazard_ok": F.col("lambda_hazard") <= lam, "semantic_ok": F.col("semantic") >= sigma, "structural_ok": F.col("coherence") >= c_min}
    for c, v in tests.items():
        j = j.withColumn(c, v)
    return j.withColumn("admitted", F.col("repeat_ok") & F.col("hazard_ok") & F.col("semantic_ok") & F.col("structural_ok"))


def membership(probe: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Probe rows with ``member``: whether the key is in the base. A null key is no member."""
    return probe.join(small(base.select(key).distinct().withColumn("_m", F.lit(True))), key, "left").withColumn("member", F.coalesce("_m", F.lit(False))).drop("_m")


def hash_vector(tokens: DataFrame, key: str, token: str, dims: int = 8192) -> DataFrame:
    """(key, dim, value): sparse L2-normalised counts of hashed tokens."""
    c = tokens.select(key, (F.conv(F.substring(F.md5(F.col(token).cast("binary")), 1, 8), 16, 10).cast("long") % dims).cast("int").alias("dim")).groupBy(key, "dim").agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return c.select(key, "dim", (F.col("n") / norm).alias("value"))


def hash_embedding(c: Column, dims: int = 256) -> Column:
    """Deterministic pseudo-embedding: the SHA-256 digest tiled to ``dims``, scaled to [0, 1], centred, L2-normalised.

    '_' counts as a blank. A null text gives null.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(digest: pd.Series) -> pd.Series:
        raw = np.frombuffer(b"".join(d or bytes(32) for d in digest), np.uint8).reshape(len(digest), 32)[:, np.arange(dims) % 32] / 255
        v = raw - raw.mean(1, keepdims=True)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(norm > 0, norm, 1)
        return pd.Series([None if d is None else x for d, x in zip(digest, v, strict=True)])

    return embed(F.unhex(F.sha2(F.translate(c, "_", " ").cast("binary"), 256)))
