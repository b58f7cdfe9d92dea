"""Mergeable percentiles with a guaranteed relative error.

Values are counted in signed logarithmic buckets: bucket i of a sign holds the magnitudes in
(gamma^(i-1), gamma^i], gamma = (1 + error) / (1 - error); zero has its own bucket. Sketches are
tables of (group, sign, bucket, count): merging two is adding matching counts. A percentile read
from a sketch is within ``error`` of the true value, relative to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.session import meet, small, store


def _gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return (1 + error) / (1 - error)


def bucket(v: Column, error: float) -> Column:
    """Signed bucket as one ordered number struct (sign, ix): ix rises with the value."""
    ix = F.ceil(F.log(F.abs(v)) / F.lit(math.log(_gamma(error)))).cast("int")
    return F.struct(F.signum(v).cast("int").alias("sign"), F.when(v > 0, ix).when(v < 0, -ix).otherwise(0).alias("ix"))


def sketch(values: DataFrame, keys: list[str], *, value: str = "v", error: float = 0.01) -> DataFrame:
    """(keys, sign, ix, n, least, most) of the finite values; null, NaN and infinite ones are left out.

    Nothing of a question is in it, so any sketches of the same error merge. Null keys form groups like any
    other. An empty table gives an empty sketch.
    """
    v = F.col(value).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    b = bucket(v, error)
    return rows.groupBy(*keys, b["sign"].alias("sign"), b["ix"].alias("ix")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))


def merge(*sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch of all: matching buckets added. Any split of the rows gives the same result."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*keys, "sign", "ix").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def read(sketched: DataFrame, keys: list[str], percent: Column, *, error: float = 0.01) -> DataFrame:
    """(keys, pct, total, rank, estimate, sign, ix, n, before, least, most): for each group the bucket that holds rank ceil(pct / 100 * total).

    ``keys`` name a group whole: where a group is asked for several percents, its rows are repeated and the percent
    is one of the keys. The buckets of a group are bounded by the value range, however many rows it has.
    """
    g = _gamma(error)
    by = Window.partitionBy(*keys)
    run = sketched.withColumn("pct", percent).withColumn("total", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(by.orderBy("sign", "ix")))
    rank = F.greatest(F.ceil(F.col("pct") * F.col("total") / 100), F.lit(1))
    hit = run.withColumn("rank", rank).withColumn("before", F.col("upto") - F.col("n")).where("before < rank and rank <= upto")
    middle = F.col("sign") * F.lit(2.0) / (g + 1) * F.pow(F.lit(g), F.col("ix") * F.col("sign"))
    return hit.select(*dict.fromkeys([*keys, "pct"]), "total", "rank", middle.alias("estimate"), "sign", "ix", "n", "before", "least", "most")


def above(values: DataFrame, keys: list[str], limits: DataFrame, by: list[str], *, value: str = "v", least: int = 1, error: float = 0.01) -> DataFrame:
    """(keys, pct, lim, total, estimate) of the groups of ``least`` values at least whose percentile is above the limit, exactly.

    limits: (by, pct, lim), a small table without nulls; ``by`` are some of the keys; several percents and limits of one
    group are asked apart. The sketch decides wherever the bucket of the rank lies on one side of the limit. Only
    where the limit lies between the bucket's least and greatest value are that bucket's values counted,
    in a second pass over ``values``.
    """
    sketched = store(sketch(values, keys, value=value, error=error))
    asked = store(read(sketched.join(small(limits), by), [*keys, "pct", "lim"], F.col("pct"), error=error).where(F.col("total") >= least))
    out = [*keys, "pct", "lim", "total", "estimate"]
    # The value at the rank is above if the whole bucket is.
    sure = asked.where("least > lim").select(*out)
    open_ = asked.where("least <= lim and most > lim").select(*out, "sign", "ix", (F.col("rank") - F.col("before")).alias("place"))
    b = bucket(F.col(value).cast("double"), error)
    rows = meet(values.withColumns({"sign": b["sign"], "ix": b["ix"]}).select(*keys, "sign", "ix", F.col(value).cast("double").alias("_v")), open_, [*keys, "sign", "ix"])
    at_most = rows.groupBy(*out, "place").agg(F.count_if(F.col("_v") <= F.col("lim")).alias("below"))
    return sure.unionByName(at_most.where("below < place").select(*out))
