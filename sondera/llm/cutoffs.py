"""Cutoffs that keep a target fraction, by iterative histogram refinement.

No sort and no collection of scores: each round counts the values of every group into bins
between the group's bounds, finds the bin that holds the target rank and zooms into it, until
that bin holds one distinct value. Groups are refined together, one pass a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.session import cut, small


def refine_cutoffs(values: DataFrame, targets: DataFrame, *, bins: int = 2048) -> DataFrame:
    """(grp, metric, keep_permille, n, cutoff) for every target of a group with values.

    values: (grp, metric, v double), v read so that greater is better, neither null nor NaN.
    targets: (grp, metric, keep_permille), one row a pair; pairs of a null target and groups without
    values have no row. The cutoff is the value at position ceil(n * keep_permille / 1000) from
    the greatest, position 1 at least. Repeated rows count each time; remove deliveries before.
    Only the state, a row for each target, is materialised between rounds.
    """
    values = values.select("grp", "metric", "v")
    goal = targets.where("keep_permille is not null").select("grp", "metric", "keep_permille")
    start = values.join(small(goal), ["grp", "metric"]).groupBy("grp", "metric", "keep_permille").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rank = F.greatest(F.expr("cast((n * keep_permille + 999) div 1000 as long)"), F.lit(1))
    state = cut(start.withColumn("rank", F.least(rank, F.col("n"))))
    while state.where("lo < hi").limit(1).count():
        open_ = small(state.where("lo < hi").select("grp", "metric", "lo", "hi", "rank"))
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counted = values.join(open_, ["grp", "metric"]).where("v >= lo and v <= hi").groupBy("grp", "metric", "rank", place.alias("bin")).agg(F.count("v").alias("c"), F.min("v").alias("blo"), F.max("v").alias("bhi"))
        down = Window.partitionBy("grp", "metric").orderBy(F.desc("bin"))
        above = F.sum("c").over(down) - F.col("c")
        found = counted.withColumn("above", above).where("above < rank and rank <= above + c")
        found = found.select("grp", "metric", F.col("blo"), F.col("bhi"), (F.col("rank") - F.col("above")).alias("left"))
        state = cut(
            state.join(found, ["grp", "metric"], "left").select(
                "grp", "metric", "keep_permille", "n", F.coalesce("blo", "lo").alias("lo"), F.coalesce("bhi", "hi").alias("hi"), F.coalesce("left", "rank").alias("rank")
            )
        )
    return state.select("grp", "metric", "keep_permille", "n", F.col("lo").alias("cutoff"))
